"""Checks pass on clean products and report damaged rows."""

import pytest
from pyspark.sql import functions as F

from ledgerwright import Products
from ledgerwright.operators import checks
from ledgerwright.plans import profiles, training
from ledgerwright.plans.products import run_checks


@pytest.fixture(scope="module")
def products(ledger):
    rows = []
    for s in range(1, 743, 9):
        kind = ["TRANSFER", "CASH_OUT", "PAYMENT", "CASH_IN", "DEBIT"][s % 5]
        rows.append(
            {
                "step": s,
                "type": kind,
                "amount": f"{s * 3}.00",
                "nameorig": f"C{s % 4}",
                "namedest": "M1" if kind == "PAYMENT" else f"C{100 + s % 3}",
                "oldbalancedest": f"{s % 2 * 50}.00",
                "isfraud": int(kind == "TRANSFER"),
                "isflaggedfraud": int(kind == "TRANSFER" and s % 2),
            }
        )
    return Products(ledger(*rows))


def test_clean_products_pass_every_check(products):
    failures = run_checks(products).filter("failures > 0").collect()
    assert failures == []


def test_damaged_ledger_is_reported(ledger):
    raw = ledger(
        {"step": 0},
        {"type": "REFUND", "namedest": "X1", "amount": "-4.00"},
        {},
        {},
    )
    p = Products(raw)
    report = {(r.check_name, r.table_name): r.failures for r in run_checks(p).collect()}
    assert report[("negative_balances", "staged")] == 1
    assert report[("invalid_time", "enriched")] == 1
    assert report[("accepted_types", "fact")] == 1
    assert report[("accepted_destinations", "fact")] == 1
    assert report[("type_exists", "fact")] == 1
    assert report[("unique_id", "fact")] == 1
    # The unknown type has no family, so the behaviour mart and the dataset lack its row.
    assert report[("totals_preserved", "mart_transaction_behavior")] == 1
    assert report[("totals_preserved", "training_features")] == 1
    assert report[("splits_have_both_classes", "ml_dataset")] == 1


def test_generic_checks(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, None), (None, "z")], "k int, v string"
    )
    nulls = {(r.column_name, r.null_count) for r in checks.not_null(df, ["k", "v"]).collect()}
    assert nulls == {("k", 1), ("v", 1)}
    assert [r.k for r in checks.unique(df, ["k"]).collect()] == [1]
    assert [r.unexpected_value for r in checks.accepted_values(df, "v", ["a", "b"]).collect()] == [
        "z"
    ]
    parent = spark.createDataFrame([(1,)], "id int")
    orphans = checks.orphan_keys(df, "k", parent, "id").collect()
    assert [(r.orphan_key, r.row_count) for r in orphans] == [(2, 1)]
    assert checks.orphan_keys(df, "k", parent, "id", F.col("v") == "a").isEmpty()
    assert checks.is_empty(df).isEmpty() and not checks.is_empty(df.limit(0)).isEmpty()


def test_downsample_keeps_frauds_and_is_repeatable(spark):
    df = spark.range(4000).select(
        F.upper(F.md5(F.col("id").cast("string"))).alias("transaction_id"),
        (F.col("id") % 50 == 0).alias("is_fraud"),
    )
    first = training.downsample(df, F.col("is_fraud"))
    assert first.filter("is_fraud").count() == 80
    kept = first.filter("not is_fraud").count()
    assert 0.03 < kept / 3920 < 0.07
    assert first.exceptAll(training.downsample(df.repartition(5), F.col("is_fraud"))).isEmpty()


def test_version_depends_on_rows_only(spark):
    rows = [("TRAIN", i, None if i % 3 else float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "dataset_split string, a int, b double")
    version = profiles.dataset_version(df).first().version
    assert profiles.dataset_version(df.repartition(7)).first().version == version
    assert profiles.dataset_version(df.unionByName(df.limit(1))).first().version != version
    changed = df.withColumn("b", F.when(F.col("a") == 4, 4.5).otherwise(F.col("b")))
    assert profiles.dataset_version(changed).first().version != version


def test_a_value_in_another_nullable_column_changes_the_version(spark):
    schema = "dataset_split string, a int, b int"
    left = spark.createDataFrame([("TRAIN", 1, None)], schema)
    right = spark.createDataFrame([("TRAIN", None, 1)], schema)
    assert (
        profiles.dataset_version(left).first().version
        != profiles.dataset_version(right).first().version
    )


def test_missing_keys_are_not_repeated_keys(spark):
    rows = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int")
    assert [tuple(r) for r in checks.unique(rows, ["k"]).collect()] == [(1, 2)]
