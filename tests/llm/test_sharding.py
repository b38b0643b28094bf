import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import sharding as s


def brute(rows, widths, shards):
    """Shards by the same tree, cut in memory; a row is (size, dims, order)."""
    def grow(members, first, n):
        if n == 1:
            return [(i, first) for i in members]
        left = n // 2
        if not members:
            return []
        spread = [
            (max(rows[i][1][d] for i in members) - min(rows[i][1][d] for i in members))
            / (widths[d] or 1.0)
            for d in range(len(widths))
        ]
        dim = max(range(len(widths)), key=lambda d: (spread[d], d))
        ordered = sorted(members, key=lambda i: (rows[i][1][dim], rows[i][2]))
        goal = sum(rows[i][0] for i in members) * left / n
        before, cut = 0, 0
        for k, i in enumerate(ordered):
            if before + rows[i][0] / 2 <= goal:
                cut = k + 1
            before += rows[i][0]
        return grow(ordered[:cut], first, left) + grow(ordered[cut:], first + left, n - left)

    return dict(grow(list(range(len(rows))), 0, shards))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(400):
        text = None if i % 40 == 0 else "" if i % 41 == 0 else "é" * int(rnd.pareto(1.2) * 40 + 1)
        rows.append((i % 390, text, ["en", "de", None][i % 3], f"src{i % 9}", "x"))
    schema = "doc_id long, text string, lang string, source string, shard string"
    return spark.createDataFrame(rows, schema).coalesce(1)


def dims():
    return {
        "a_chars": F.char_length("text"),
        "b_lang": s.text_code(F.col("lang")),
        "c_source": s.text_code(F.col("source")),
    }


@pytest.mark.parametrize("shards", [1, 5, 24, 300])
def test_equal_to_brute_force(docs, shards):
    given = docs.collect()
    sizes = [len((r["text"] or "").encode()) + 8 for r in given]
    code = lambda x: int.from_bytes((x or "").encode()[:6].ljust(6, b"\0"), "big")
    place = [
        (float(len(r["text"]) if r["text"] is not None else 0), float(code(r["lang"])), float(code(r["source"])))
        for r in given
    ]
    rows = [(n, d, i) for i, (n, d) in enumerate(zip(sizes, place, strict=True))]
    widths = [max(d[k] for d in place) - min(d[k] for d in place) for k in range(3)]
    want = brute(rows, widths, shards)
    got = s.kd_shards(docs, dims(), shards=shards).collect()
    expected = sorted(
        (given[i]["doc_id"], sizes[i], zlib.crc32((given[i]["text"] or "").encode()), want[i])
        for i in range(len(given))
    )
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == expected
    for shard in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shards_are_balanced(docs):
    got = s.kd_shards(docs, dims(), target_bytes=2_000).collect()
    bytes_of = {}
    for r in got:
        bytes_of[r["shard"]] = bytes_of.get(r["shard"], 0) + r["size"]
    largest = max(r["size"] for r in got)
    mean = sum(bytes_of.values()) / len(bytes_of)
    assert max(bytes_of.values()) <= mean + 2 * largest


def test_empty_ties_and_nulls(docs, spark):
    assert s.kd_shards(docs.limit(0), dims(), shards=24).count() == 0
    same = spark.createDataFrame([(1, "x", None, None)] * 48, "doc_id long, text string, lang string, source string")
    counts = s.kd_shards(same, dims(), shards=24).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [2] * 24
    few = s.kd_shards(same.limit(3), dims(), shards=24).collect()
    assert len(few) == 3 and all(0 <= r["shard"] < 24 for r in few)


def test_plans_do_not_grow_with_the_shards(docs, monkeypatch):
    sizes, original = {}, s.freeze
    for shards in (16, 256):
        plans = []

        def noted(df, *given):
            plans.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
            return original(df, *given)

        with monkeypatch.context() as patch:
            patch.setattr(s, "freeze", noted)
            got = s.kd_shards(docs, dims(), shards=shards)
            sizes[shards] = max([*plans, len(got._jdf.queryExecution().optimizedPlan().toString())])
    assert sizes[256] < 1.5 * sizes[16]


def test_no_python_on_the_main_path(docs):
    plan = s.kd_shards(docs, dims(), shards=3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
