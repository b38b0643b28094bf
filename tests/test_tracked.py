"""Builds that repeat nothing."""

import pytest
from pyspark.sql import functions as F

from ledgerwright import Products
from ledgerwright.plans.products import GROUPS
from ledgerwright.plans.tracked import TrackedBuild, ancestors, group_ancestors

MARTS = GROUPS["dashboard"]


@pytest.fixture(scope="module")
def raw(ledger):
    kinds = ["PAYMENT", "TRANSFER", "CASH_OUT"]
    rows = [
        {"step": s, "type": kinds[s % 3], "nameorig": f"C{s % 5}", "namedest": f"C{s % 4 + 9}", "amount": f"{s}.50",
         "isfraud": int(s % 9 == 1)}
        for s in range(1, 73)
    ]
    return ledger(*rows).cache()


def test_ancestors_follow_from_the_code(raw):
    p = Products(raw)
    assert ancestors(p, "mart_fraud_daily") == {
        "hourly", "fact", "enriched", "staged", "raw", "dim_simulation_day"
    }
    assert ancestors(p, "dim_transaction_type") == {"transaction_types", "raw"}
    for group in ("daily", "ml"):
        built = group_ancestors(p, [GROUPS[group][-1]])
        assert set(GROUPS[group]) - {"transaction_types", "dim_simulation_day", "dim_transaction_type"} <= built


def test_a_second_build_writes_nothing(raw, tmp_path):
    first = TrackedBuild(Products(raw), str(tmp_path))
    counts = {r.product: r.row_count for r in first.build(MARTS).collect()}
    assert set(MARTS) < set(first.written) and first.written.index("fact") < first.written.index("features")
    again = TrackedBuild(Products(raw.repartition(3)), str(tmp_path))
    assert {r.product: r.row_count for r in again.build(MARTS).collect()} == counts
    assert again.written == []
    for name in MARTS:
        df, _ = again.provided(name)
        assert df.count() == counts[name]


def test_a_changed_day_rebuilds_what_depends_on_it(raw, tmp_path):
    TrackedBuild(Products(raw), str(tmp_path)).build([*MARTS, "dim_transaction_type"])
    # The destination's balance is in the facts, but in none of the hourly totals.
    changed = raw.withColumn(
        "newbalancedest", F.when(F.col("step") == 30, "17.00").otherwise(F.col("newbalancedest"))
    )
    build = TrackedBuild(Products(changed), str(tmp_path))
    build.build([*MARTS, "dim_transaction_type"])
    assert {"fact", "features", "hourly"} <= set(build.written)
    # Written again with the same content, the totals end the chain.
    assert not {"dim_simulation_day", "mart_fraud_daily", "mart_fraud_by_transaction_type"} & set(build.written)
    assert "dim_transaction_type" not in build.written
    late = TrackedBuild(Products(changed.filter("step < 70")), str(tmp_path))
    late.build(MARTS)
    assert set(MARTS) <= set(late.written)
