"""Aggregates behind the dashboard charts; all read marts, not fact rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.functions import fraud_rate, order_key
from ledgerwright.plans.marts import summed
from ledgerwright.sources.snapshots import SnapshotTable

# Display order of risk levels, chart limits and queue columns.
RISK_LEVELS = ["HIGH", "MEDIUM", "LOW"]
TOP_CUSTOMERS = 100
TOP_COLUMNS = [
    "customer_id",
    "customer_risk_rank",
    "customer_risk_level",
    "customer_role",
    "first_seen_day",
    "last_seen_day",
    "transaction_count",
    "transaction_amount_total",
    "transaction_amount_average",
    "maximum_transaction_amount",
    "fraudulent_transaction_count",
    "fraudulent_transaction_amount",
    "high_value_anomaly_count",
    "maximum_amount_zscore",
    "maximum_amount_to_average_ratio",
    "maximum_transaction_count_24h",
    "average_hours_between_transactions",
    "fraud_rate_percent",
]
QUEUE_COLUMNS = [
    "customer_risk_rank",
    "customer_id",
    "customer_risk_level",
    "customer_role",
    "transaction_count",
    "transaction_amount_total",
    "maximum_transaction_amount",
    "fraudulent_transaction_count",
    "fraudulent_transaction_amount",
    "high_value_anomaly_count",
]
VOLUME = [
    "transaction_count",
    "transaction_amount_total",
    "fraudulent_transaction_count",
    "fraudulent_transaction_amount",
]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "fraud_rate_percent",
        fraud_rate(F.col("fraudulent_transaction_count"), F.col("transaction_count")),
    )


def executive_summary(daily: DataFrame) -> DataFrame:
    """One row over all days."""
    return _with_rate(
        daily.agg(
            *summed(*VOLUME, "flagged_transaction_count"),
            F.avg("average_fraudulent_transaction_amount").alias("average_daily_fraud_amount"),
            F.max("fraudulent_transaction_amount").alias("maximum_daily_fraud_amount"),
        )
    )


def headline_rate(daily: DataFrame) -> DataFrame:
    """The overall fraud rate as a fraction, for a percent-formatted number chart."""
    return executive_summary(daily).agg(
        (F.max("fraud_rate_percent") / 100).alias("fraud_rate")
    )


def risk_distribution(risk: DataFrame) -> DataFrame:
    """Customers and volume per risk level."""
    return _with_rate(
        risk.groupBy("customer_risk_level").agg(
            F.count(F.lit(1)).alias("customer_count"),
            *summed(*VOLUME, "high_value_anomaly_count"),
            F.avg("maximum_amount_zscore").alias("average_maximum_amount_zscore"),
        )
    ).withColumn("risk_level_order", order_key(F.col("customer_risk_level"), RISK_LEVELS, 4))


def top_risk_customers(risk: DataFrame, limit: int = TOP_CUSTOMERS) -> DataFrame:
    """The highest ranked customers; ties are broken by id so the cut is repeatable."""
    return (
        risk.select(*TOP_COLUMNS).orderBy("customer_risk_rank", "customer_id").limit(limit)
    )


def investigation_queue(risk: DataFrame, limit: int = TOP_CUSTOMERS) -> DataFrame:
    """The work list of an analyst, in rank order."""
    return (
        risk.select(*QUEUE_COLUMNS).orderBy("customer_risk_rank", "customer_id").limit(limit)
    )


def daily_transaction_type(behavior: DataFrame) -> DataFrame:
    """Behaviour rolled up over customer roles."""
    return _with_rate(
        behavior.groupBy(
            "simulation_day",
            "simulation_week",
            "day_of_simulation_week",
            "is_complete_day",
            "transaction_type",
            "transaction_family",
            "balance_direction",
        ).agg(*summed(*VOLUME, "distinct_customer_count", "flagged_transaction_count"))
    )


def risk_scatter(risk: DataFrame, limit: int | None = None) -> DataFrame:
    """Mean customer volume per transaction count and risk level.

    `limit` is for a chart that cannot show all points; there is none by default.
    """
    points = (
        risk.groupBy("transaction_count", "customer_risk_level")
        .agg(
            (F.sum("transaction_amount_total").cast("double") / F.count(F.lit(1))).alias(
                "average_customer_amount"
            )
        )
        .orderBy("transaction_count", "customer_risk_level")
    )
    return points if limit is None else points.limit(limit)


def fraud_heatmap(behavior: DataFrame, types: list[str]) -> DataFrame:
    """Frauds per day and type as a matrix; the types are the lookup's, so no extra job
    is needed to find the columns."""
    return (
        behavior.groupBy("simulation_day")
        .pivot("transaction_type", types)
        .agg(F.sum("fraudulent_transaction_count"))
        .fillna(0)
    )


def daily_trend(daily: DataFrame) -> DataFrame:
    """The four series of the daily trend charts."""
    series = [
        "fraud_rate_percent",
        "rolling_7d_fraud_rate_percent",
        "fraud_rate_change_percentage_points",
        "cumulative_fraud_count",
    ]
    return (
        daily.groupBy("simulation_day")
        .agg(*[F.max(s).alias(s) for s in series])
        .orderBy("simulation_day")
    )


def type_rates(by_type: DataFrame) -> DataFrame:
    """Fraud and detection rate per transaction type."""
    rates = ["fraud_rate_percent", "fraud_detection_rate_percent"]
    return by_type.groupBy("transaction_type").agg(*[F.max(r).alias(r) for r in rates])


def dataset_metadata(
    tables: Mapping[str, DataFrame], source: str, folder: str, spark: SparkSession
) -> DataFrame:
    """Publish tables below `folder`, and per table its name, rows, snapshot, source and
    when it was synchronised.

    The rows are counted as they are written; no table is read again.
    """
    listed = []
    for name, df in tables.items():
        made = SnapshotTable(spark, f"{folder}/{name}").write(df, None)
        listed.append((name, made.written["rows"], made.version, source, made.written_at))
    rows = spark.createDataFrame(
        listed, "table_name string, row_count bigint, snapshot_id bigint, source string, at double"
    )
    return rows.withColumn("synchronized_at", F.timestamp_seconds("at")).drop("at")
