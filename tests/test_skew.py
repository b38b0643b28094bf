"""Dominating accounts are split, and nothing looks at accounts without need."""

import pytest
from pyspark.sql import functions as F

from ledgerwright import Products
from ledgerwright.plans import dashboards, dimensions, marts, profiles, training


@pytest.fixture(scope="module")
def hot_fact(spark):
    """Fact rows of which one account holds four fifths."""
    n = 60_000
    return spark.range(n, numPartitions=6).select(
        F.col("id").alias("transaction_id"),
        F.when(F.col("id") % 5 > 0, "C0")
        .otherwise(F.concat(F.lit("C"), F.col("id").cast("string")))
        .alias("origin_account_id"),
        F.lit("C1").alias("destination_account_id"),
        F.lit("MERCHANT").alias("destination_account_type"),
        F.lit("PAYMENT").alias("transaction_type"),
        (F.col("id") % 48 + 1).cast("int").alias("simulation_step"),
        F.when(F.col("id") % 48 < 24, 1).otherwise(2).alias("simulation_day"),
        F.sha2(F.col("id").cast("string"), 512).alias("padding"),
    )


@pytest.fixture()
def low_thresholds(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), len(rows)


def test_star_join_splits_a_dominating_account(spark, hot_fact, low_thresholds):
    customers = dimensions.dim_customer(hot_fact)
    types = spark.createDataFrame(
        [("PAYMENT", "x", "y", "z")],
        "transaction_type string, transaction_family string, balance_direction string, description string",
    )
    days = spark.createDataFrame(
        [(1, 1, 1, True), (2, 1, 2, True)],
        "simulation_day int, simulation_week int, day_of_simulation_week int, is_complete_day boolean",
    )
    plan, rows = final_plan(marts.star_join(hot_fact, customers, types, days))
    assert rows == 60_000
    assert "skew=true" in plan


def test_event_spans_split_a_dominating_account(hot_fact, low_thresholds):
    plan, rows = final_plan(dimensions.events_with_span(hot_fact))
    assert rows == 60_000
    assert "skew=true" in plan


def test_events_without_an_account_keep_their_span(hot_fact):
    holed = hot_fact.limit(100).withColumn("origin_account_id", F.lit(None).cast("string"))
    spans = dimensions.events_with_span(holed)
    assert spans.count() == 100
    assert spans.select("originated_transaction_count").distinct().first()[0] == 100


def test_profiles_start_no_job_while_they_are_built(spark, ledger):
    p = Products(ledger({"step": 1}, {"step": 2}))
    context = spark.sparkContext
    context.setJobGroup("building", "building")
    try:
        profiles.split_summary(p.labelled_rows)
        profiles.drain_rule_metrics(p.labelled_rows)
        p.labelled_rows.filter(F.col("dataset_split") == "VALIDATION")
        assert not context.statusTracker().getJobIdsForGroup("building")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_row_features_are_the_training_features_without_history(ledger):
    p = Products(ledger(*[{"step": s, "amount": f"{s}.25"} for s in range(1, 30)]))
    kept = [c for c in training.TRAINING_COLUMNS if c not in training.HISTORY_COLUMNS]
    full = p.ml_dataset.select(*kept, "dataset_split")
    assert p.labelled_rows.columns == full.columns
    assert full.exceptAll(p.labelled_rows).isEmpty() and p.labelled_rows.exceptAll(full).isEmpty()


def test_the_scatter_shows_all_points(spark):
    risk = spark.range(10_500).select(
        F.col("id").alias("transaction_count"),
        F.lit("LOW").alias("customer_risk_level"),
        F.lit(1.0).alias("transaction_amount_total"),
    )
    assert dashboards.risk_scatter(risk).count() == 10_500
    assert dashboards.risk_scatter(risk, limit=100).count() == 100
