import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerwright.llm import collocations
from ledgerwright.llm.oracles import ORACLES
from ledgerwright.llm.queries import QUERIES
from ledgerwright.session import freeze

DATA = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_force(rows, least, longest=5, top=2000):
    counts, totals, parts = {}, Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    phrase = tuple(words[i : i + k])
                    counts[lang, phrase] = counts.get((lang, phrase), 0) + 1
    inner = set()
    for (lang, p), a in counts.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if a >= counts[lang, p[i : i + k]]:
                    inner.add((lang, p[i : i + k]))
    out = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least or (lang, p) in inner:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def found(docs, **settings):
    return sorted(tuple(r) for r in collocations.collocations(docs, **settings).select(COLUMNS).collect())


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "A", "bé", "x" * 300, "zz\x1c"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "! ", "\r", " \t"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(80)))
        if i % 3 == 0:
            text += " Once Upon a time there was; one"
        rows.append((text, rnd.choice(["en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", "fr"), (" .. ", None), rows[0], rows[0], ("a a a a a a", "de")]


@pytest.mark.parametrize("block, sent", [(40, 500_000), (40, 0), (1 << 20, 500_000)])
def test_equals_brute_force(spark, monkeypatch, block, sent):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "FREQUENT_SENT", sent)
    rows = corpus(120)
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr(
        "text", "lang", "1 as words", "2 as block", "3 as n"
    ).repartition(3)
    for least in (3, 10):
        want = brute_force(rows, least)
        assert want and max(len(r[2].split()) for r in want) == 5
        assert found(docs, min_count=least) == want
    assert found(docs, min_count=3, max_words=3, top=4) == brute_force(rows, 3, 3, 4)


def test_nothing_frequent(spark):
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert found(docs) == []
    assert found(docs.limit(0)) == []


def test_products_beyond_64_bits(spark):
    rows = spark.range(1).selectExpr(
        "'en' as lang", "9000000000000 as a", "90000000000000 as n",
        "array(10000000000000, 9000000000000) as starts", "array(9500000000000, 9000000000000) as ends",
    )
    cut = rows.select(collocations._lowest_cut(5).alias("cut")).first()["cut"]
    exact = 1000 * 9000000000000 * 90000000000000 // (10000000000000 * 9500000000000)
    assert cut.asDict() == {"score": exact, "k": 1, "l": 10000000000000, "r": 9500000000000}


def test_the_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    listed = ", ".join(COLUMNS)
    want = duck.execute(f"select {listed} from ({ORACLES['op12_collocations']})").fetchall()
    got = QUERIES["op12_collocations"](spark, DATA).select(COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_blocks_go_to_python_one_by_one(spark, monkeypatch):
    key, made = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def stored(df, label, *more):
        made.append((label, spark.conf.get(key)))
        return freeze(df, label, *more)

    before = spark.conf.get(key)
    monkeypatch.setattr(collocations, "freeze", stored)
    docs = spark.createDataFrame([("a b c a b c", "en")], "text string, lang string")
    collocations.collocations(docs, min_count=2).collect()
    rows = {size for label, size in made if label.startswith("occurrences")}
    assert rows == {"1"} and spark.conf.get(key) == before

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with collocations.one_block_a_batch(spark):
        seen = spark.range(5, numPartitions=1).mapInArrow(lengths, "n long").collect()
    assert [r.n for r in seen] == [1] * 5


def test_phrases_are_numbered_without_gaps(spark):
    rows = spark.range(0, 12, numPartitions=5).filter("id % 7 <> 3").selectExpr("id * 10 as x")
    numbered = collocations._numbered(rows.repartition(4), "numbered").collect()
    assert sorted(r.id for r in numbered) == list(range(10))
    assert sorted(r.x for r in numbered) == [10 * i for i in range(12) if i % 7 != 3]
    assert collocations._numbered(rows.limit(0), "numbered").count() == 0
    pairs = spark.createDataFrame(
        [(0, [5, (1 << 31) - 1], [7, (1 << 31) - 1], [2, 1]), (1, [(1 << 31) - 1], [(1 << 31) - 1], [3])],
        "block long, left array<long>, right array<long>, counts array<long>",
    )
    found = collocations._frequent(pairs, ["left", "right"], 2).collect()
    assert sorted(map(tuple, found)) == [(5, 7, 2), ((1 << 31) - 1, (1 << 31) - 1, 4)]


def test_stored_blocks_are_few_to_a_row_group(spark, monkeypatch):
    made = []

    def stored(df, label, *more):
        made.append((label, more))
        return freeze(df, label, *more)

    monkeypatch.setattr(collocations, "freeze", stored)
    docs = spark.createDataFrame([("a b c a b c", "en")], "text string, lang string")
    collocations.collocations(docs, min_count=2).collect()
    blocks = [more for label, more in made if label == "word-blocks" or label.startswith("occurrences")]
    assert len(blocks) > 2 and all(more == ("zstd", True) for more in blocks)

    def large(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                value = random.Random(i).randbytes(3 << 20)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([value])], names=["id", "value"])

    rows = spark.range(0, 12, numPartitions=1).mapInArrow(large, "id long, value binary")
    kept = freeze(rows, "large", "zstd", True)
    (name,) = [f.removeprefix("file://") for f in kept.inputFiles()]
    groups = [pq.ParquetFile(name).metadata.row_group(i).num_rows for i in range(pq.ParquetFile(name).num_row_groups)]
    assert sum(groups) == 12 and max(groups) <= 4
    assert [r.n for r in kept.selectExpr("id", "length(value) as n").collect()] == [3 << 20] * 12
