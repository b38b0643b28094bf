"""Rank, running totals and quantiles against direct evaluation."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerwright.operators import ordered
from ledgerwright.operators.ordered import exact_quantiles, global_rank, running_totals


@pytest.fixture(scope="module")
def pairs(spark):
    seed = random.Random(3)
    rows = [(seed.randint(0, 3), float(seed.randint(0, 40)), seed.choice("ab")) for _ in range(900)]
    # A third of all rows shares one key.
    rows += [(1, 7.0, "a")] * 450
    return spark.createDataFrame(rows, "x int, y double, g string").repartition(8)


def test_rank_equals_the_window_function(pairs, many_blocks):
    window = Window.orderBy(F.desc("x"), F.desc("y"))
    got = global_rank(pairs, ["x", "y"], "rank")
    want = pairs.withColumn("rank", F.rank().over(window).cast("bigint"))
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert got.count() == want.count()


def test_ties_share_a_rank_and_leave_a_gap(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "id string, n int")
    assert [r.rank for r in global_rank(df, ["n"], "rank").orderBy("id").collect()] == [1, 1, 3]


def test_rank_with_null_keys_puts_them_last(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, None), (4, 9.0)], "id int, v double")
    rows = global_rank(df, ["v"], "rank").orderBy("id").collect()
    assert [r.rank for r in rows] == [2, 3, 3, 1]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_per_group(pairs, descending, many_blocks):
    got = {
        (r.g, r.y): (r.n, r.n_before, r.n_all)
        for r in running_totals(
            pairs, ["y"], {"n": F.count(F.lit(1))}, by=["g"], descending=descending
        ).collect()
    }
    rows = pairs.collect()
    for g in "ab":
        values = [r.y for r in rows if r.g == g]
        for v in set(values):
            before = sum(w > v if descending else w < v for w in values)
            assert got[(g, v)] == (values.count(v), before, len(values))


def test_quantiles_match_linear_interpolation(pairs, many_blocks):
    labels = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = exact_quantiles(pairs, ["x", "y"], labels, by=["g"]).collect()
    rows = pairs.collect()
    assert len(got) == 4
    for r in got:
        values = [getattr(s, r.feature) for s in rows if s.g == r.g]
        for label, p in labels.items():
            assert r[label] == pytest.approx(np.quantile(values, p))


def test_quantiles_ignore_nulls_and_follow_weights(spark):
    df = spark.createDataFrame([(1.0, 3), (9.0, 1), (None, 50)], "v double, w int")
    row = exact_quantiles(df, ["v"], {"median": 0.5, "top": 1.0}, weight="w").first()
    assert (row["median"], row["top"]) == (1.0, 9.0)


def plans_of(monkeypatch, build):
    """The plans of all tables that `build` stores, and of its result."""
    plans, original = [], ordered.freeze

    def noted(df, *given):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, *given)

    with monkeypatch.context() as patch:
        patch.setattr(ordered, "freeze", noted)
        result = build()
    return [*plans, result._jdf.queryExecution().executedPlan().toString()]


def test_no_plan_sorts_all_rows_in_one_partition(pairs, monkeypatch):
    plans = plans_of(monkeypatch, lambda: global_rank(pairs, ["x", "y"], "rank"))
    (plan,) = [p for p in plans if "Exchange SinglePartition" in p]
    # The only single-partition step runs over one row per block.
    single = plan.index("Exchange SinglePartition")
    assert "HashAggregate(keys=[_block" in plan[single : single + 400] or "SortAggregate(key=[_block" in plan[single : single + 400]
    assert plan.count("Exchange SinglePartition") == 1
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_a_run_of_equal_keys_over_several_ranges_shares_a_rank(spark, many_blocks):
    rows = [(float(i % 3), "x") for i in range(3000)] + [(1.0, None)] * 2000 + [(float("nan"), "n")] * 9
    df = spark.createDataFrame(rows, "v double, w string").repartition(5)
    got = global_rank(df, ["v", "w"], "rank")
    want = df.withColumn("rank", F.rank().over(Window.orderBy(F.desc("v"), F.desc("w"))).cast("bigint"))
    assert got.exceptAll(want).isEmpty() and got.count() == len(rows)
    sizes = df.sparkSession.read.parquet(_stored(got, "/ranges-")).groupBy("_block").count()
    # The 2000 equal rows are in several ranges.
    assert sizes.count() == 8 and sizes.agg(F.max("count")).first()[0] < 1500


def _stored(df, part):
    return next(f.rsplit("/", 1)[0] for f in df.inputFiles() if part in f)


def test_rank_shuffles_the_rows_once(pairs, monkeypatch):
    rows, ranges, starts, result = plans_of(monkeypatch, lambda: global_rank(pairs, ["x", "y"], "rank"))
    assert ranges.count("Exchange") == 1 and "rangepartitioning" in ranges
    # The rest moves one row per range, and no row meets another by its keys.
    assert "Exchange hashpartitioning(_block" in starts
    assert "SortMergeJoin" not in result and "BroadcastHashJoin" in result


@pytest.mark.parametrize("few, bins", [(0, 4096), (0, 3), (50, 4), (200_000, 4096)])
def test_narrowing_finds_the_exact_values(spark, monkeypatch, few, bins):
    monkeypatch.setattr(ordered, "FEW_VALUES", few)
    monkeypatch.setattr(ordered, "QUANTILE_BINS", bins)
    seed = random.Random(9)
    values = [10.0 ** seed.randint(-9, 9) * seed.choice([-1, 1]) for _ in range(150)]
    values += [5.0] * 90 + [seed.gauss(0, 1) for _ in range(150)] + [0.0, 1e300, -1e300, 5e-324]
    rows = [(None if i % 4 == 0 else "g", v, seed.randint(0, 3)) for i, v in enumerate(values)]
    rows += [("g", None, 5), ("h", None, 1), ("one", 7.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(3)
    labels = {f"q{i}": p for i, p in enumerate((0, 0.1, 0.25, 0.5, 0.9, 0.999, 1))}
    for weight in (None, "w"):
        got = {r.g: r for r in exact_quantiles(df, ["v"], labels, by=["g"], weight=weight).collect()}
        assert set(got) == {None, "g", "one"}
        for g, r in got.items():
            held = [v for h, v, w in rows if h == g and v is not None for _ in range(w if weight else 1)]
            for label, p in labels.items():
                assert r[label] == pytest.approx(np.quantile(held, p), rel=1e-12)


def test_infinite_values_and_nan_are_the_ends(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW_VALUES", 0)
    rows = [(float(x),) for x in ("-inf", "-inf", 1, 2, 3, "inf", "nan", "nan")]
    row = exact_quantiles(spark.createDataFrame(rows, "v double"), ["v"], {"a": 0.0, "b": 3 / 7, "c": 5 / 7, "d": 1.0}).first()
    assert (row.a, row.b, row.c) == (float("-inf"), 2.0, float("inf")) and np.isnan(row.d)


def test_quantiles_shuffle_bins_only(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW_VALUES", 0)
    df = spark.range(5000).withColumn("v", F.sqrt("id"))
    plans = plans_of(monkeypatch, lambda: exact_quantiles(df, ["v"], {"m": 0.5}))
    reading = [p for p in plans if "Range (0, 5000" in p]
    assert len(reading) >= 3
    for plan in reading:
        # Values are reduced where they are read, before any exchange.
        assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
        below = plan[plan.rindex("Exchange hashpartitioning") :]
        assert "partial_sum" in below and "Generate explode" in below
    assert exact_quantiles(df, ["v"], {"m": 0.5}).first().m == pytest.approx(
        np.quantile(np.sqrt(np.arange(5000)), 0.5)
    )
