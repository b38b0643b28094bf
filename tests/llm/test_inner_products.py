import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import inner_products as ip

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, every, k):
    sound = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, *_ in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, qv in sound:
        if q % every == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(qv, cv, strict=False)), c) for c, cv in sound if c != q
            )
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])}
    return out


def run(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = ip.top_products(df, F.col("vec_id") % every == 0, k).collect()
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found}


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(ip, "BLOCK", 16)
    monkeypatch.setattr(ip, "QUERY_BLOCK", 8)


def quarter(rnd, scale=1.0):
    """A float that a single-precision column holds exactly."""
    return rnd.randrange(-4096, 4096) / 1024 * scale


def test_random_vectors(spark, small_blocks):
    rnd = random.Random(8)
    rows = []
    for i in range(200):
        scale = rnd.choice([0.25, 1, 4])
        rows.append((i, [quarter(rnd, scale) for _ in range(6)]))
    assert run(spark, rows) == brute(rows, 5, 5)


def test_ties_nulls_and_odd_lengths(spark, small_blocks):
    rows = [(i, [1.0, 0.5]) for i in range(30)]
    rows += [
        (100, None),
        (105, [1.0, None]),
        (110, [float("nan"), 1.0]),
        (115, [float("inf"), 1.0]),
        (120, []),
        (125, [2.0]),
        (130, [0.5, 0.5, 8.0]),
    ]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_few_and_none(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, [1.0])]) == set()
    assert run(spark, [(5, [1.0])]) == set()
    rows = [(5, [1.0]), (6, [2.0]), (7, [-3.0])]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(5, [1e12]), (6, [1e12])])
