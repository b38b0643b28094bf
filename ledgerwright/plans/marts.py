"""Marts over the fact and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.functions import (
    count_where,
    fraud_rate,
    published_rate,
    ratio,
    safe_divide,
    sum_where,
)
from ledgerwright.operators.ordered import global_rank
from ledgerwright.session import freeze

# Limits of the anomaly rule and the ranking keys, all descending.
ANOMALY_ZSCORE = 3.0
ANOMALY_RATIO = 5.0
MINIMUM_TRANSACTIONS = 2
RISK_KEYS = [
    "fraudulent_transaction_count",
    "fraudulent_transaction_amount",
    "high_value_anomaly_count",
    "maximum_amount_zscore",
    "transaction_amount_total",
]

# Additive measures that roll up from hourly totals to days, types and the whole.
ADDITIVE = [
    "transaction_count",
    "transaction_amount_total",
    "fraudulent_transaction_count",
    "fraudulent_transaction_amount",
    "flagged_transaction_count",
    "detected_fraud_count",
    "amount_count",
    "fraud_amount_count",
]
# Only needed to form averages over known amounts.
DENOMINATORS = ["amount_count", "fraud_amount_count"]


def additive_measures() -> dict[str, Column]:
    """Aggregates over fact rows, all additive."""
    amount, fraud, flagged = (
        F.col("transaction_amount"),
        F.col("is_fraud"),
        F.col("is_flagged_fraud"),
    )
    return {
        "transaction_count": F.count(F.lit(1)),
        "transaction_amount_total": F.sum(amount),
        "fraudulent_transaction_count": count_where(fraud),
        "fraudulent_transaction_amount": sum_where(fraud, amount),
        "flagged_transaction_count": count_where(flagged),
        "detected_fraud_count": count_where(fraud & flagged),
        "amount_count": F.count(amount),
        "fraud_amount_count": count_where(fraud & amount.isNotNull()),
    }


def summed(*names: str) -> list[Column]:
    """Roll already aggregated measures up once more, keeping their names."""
    return [F.sum(name).alias(name) for name in names]


def hourly_totals(fact: DataFrame) -> DataFrame:
    """One row per simulated hour and type: the single scan behind the day and type marts.

    Its size is hours x types, whatever the size of the fact table.
    """
    return fact.groupBy(
        "simulation_day", "simulation_hour", "simulation_step", "transaction_type"
    ).agg(*[column.alias(name) for name, column in additive_measures().items()])


def mart_fraud_by_transaction_type(hourly: DataFrame) -> DataFrame:
    """Volume, fraud and rule detection per transaction type."""
    totals = hourly.groupBy("transaction_type").agg(*summed(*ADDITIVE))
    frauds, detected = F.col("fraudulent_transaction_count"), F.col("detected_fraud_count")
    return totals.select(
        "transaction_type",
        "transaction_count",
        "transaction_amount_total",
        ratio(F.col("transaction_amount_total"), F.col("amount_count")).alias(
            "transaction_amount_average"
        ),
        "fraudulent_transaction_count",
        "flagged_transaction_count",
        "detected_fraud_count",
        (frauds - detected).alias("missed_fraud_count"),
        "fraudulent_transaction_amount",
        published_rate(fraud_rate(frauds, F.col("transaction_count"))).alias(
            "fraud_rate_percent"
        ),
        published_rate(safe_divide(detected, frauds, 100.0)).alias(
            "fraud_detection_rate_percent"
        ),
    )


def daily_totals(hourly: DataFrame) -> DataFrame:
    """Additive measures and the fraud rate per simulated day."""
    return (
        hourly.groupBy("simulation_day")
        .agg(*summed(*ADDITIVE))
        .withColumn(
            "average_fraudulent_transaction_amount",
            ratio(F.col("fraudulent_transaction_amount"), F.col("fraud_amount_count")),
        )
        .withColumn(
            "fraud_rate_percent",
            fraud_rate(F.col("fraudulent_transaction_count"), F.col("transaction_count")),
        )
        .drop("detected_fraud_count", *DENOMINATORS)
    )


def mart_fraud_daily(hourly: DataFrame, days: DataFrame) -> DataFrame:
    """Daily fraud with calendar, previous day, seven-day and running totals.

    The unpartitioned windows run over one row per simulated day.
    """
    calendar = days.select(
        "simulation_day", "simulation_week", "day_of_simulation_week", "is_complete_day"
    )
    in_order = Window.orderBy("simulation_day")
    week = in_order.rowsBetween(-6, Window.currentRow)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windowed = (
        daily_totals(hourly)
        .join(calendar, "simulation_day")
        .withColumns(
            {
                "previous_day_fraud_rate_percent": F.lag("fraud_rate_percent").over(in_order),
                "rolling_7d_transaction_count": F.sum("transaction_count").over(week),
                "rolling_7d_fraud_count": F.sum("fraudulent_transaction_count").over(week),
                "cumulative_transaction_count": F.sum("transaction_count").over(so_far),
                "cumulative_fraud_count": F.sum("fraudulent_transaction_count").over(so_far),
                "cumulative_fraudulent_amount": F.sum("fraudulent_transaction_amount").over(
                    so_far
                ),
            }
        )
    )
    return windowed.withColumns(
        {
            "fraud_rate_change_percentage_points": F.col("fraud_rate_percent")
            - F.col("previous_day_fraud_rate_percent"),
            "rolling_7d_fraud_rate_percent": fraud_rate(
                F.col("rolling_7d_fraud_count"), F.col("rolling_7d_transaction_count")
            ),
        }
    )


def customer_aggregates(features: DataFrame) -> DataFrame:
    """Behaviour of every origin account with enough transactions.

    Grouping by the account follows the partitioning of the feature windows.
    """
    amount = F.col("transaction_amount")
    zscore, to_average = (
        F.col("amount_zscore_last_10"),
        F.col("amount_to_customer_average_ratio"),
    )
    grouped = features.groupBy(F.col("origin_account_id").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(amount).alias("transaction_amount_total"),
        ratio(F.sum(amount), F.count(amount)).alias("transaction_amount_average"),
        F.max(amount).alias("maximum_transaction_amount"),
        F.avg("hours_since_previous_transaction").alias("average_hours_between_transactions"),
        F.max("transaction_count_24h").alias("maximum_transaction_count_24h"),
        count_where(F.col("is_fraud")).alias("fraudulent_transaction_count"),
        sum_where(F.col("is_fraud"), amount).alias("fraudulent_transaction_amount"),
        count_where((zscore >= ANOMALY_ZSCORE) | (to_average >= ANOMALY_RATIO)).alias(
            "high_value_anomaly_count"
        ),
        F.coalesce(F.max(zscore), F.lit(0.0)).alias("maximum_amount_zscore"),
        F.coalesce(F.max(to_average), F.lit(0.0)).alias("maximum_amount_to_average_ratio"),
    )
    return grouped.filter(F.col("transaction_count") >= MINIMUM_TRANSACTIONS)


def score_customers(features: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer aggregates with role, fraud rate and risk level, not yet ranked.

    Accounts are aggregated before they meet the dimension: one row each on both sides.
    """
    known = customers.select("customer_id", "first_seen_day", "last_seen_day", "customer_role")
    return (
        customer_aggregates(features)
        .join(known, "customer_id")
        .withColumn(
            "fraud_rate_percent",
            fraud_rate(F.col("fraudulent_transaction_count"), F.col("transaction_count")),
        )
        .withColumn(
            "customer_risk_level",
            F.when(F.col("fraudulent_transaction_count") > 0, "HIGH")
            .when(
                (F.col("high_value_anomaly_count") > 0)
                | (F.col("maximum_amount_to_average_ratio") >= ANOMALY_RATIO),
                "MEDIUM",
            )
            .otherwise("LOW"),
        )
    )


def mart_customer_risk(features: DataFrame, customers: DataFrame) -> DataFrame:
    """Scored customers with their global risk rank."""
    return global_rank(score_customers(features, customers), RISK_KEYS, "customer_risk_rank")


def mart_transaction_behavior(
    fact: DataFrame, customers: DataFrame, types: DataFrame, days: DataFrame
) -> DataFrame:
    """Behaviour per day, type and role of the origin account.

    Rows are reduced to (account, day, type) before they meet the customer dimension,
    which bounds every account to days x types rows. As an account has one role, its
    distinct count per group is then a plain row count.
    """
    unused = ("detected_fraud_count", "fraud_amount_count")
    measures = [m for m in ADDITIVE if m not in unused]
    aggregates = additive_measures()
    per_account = fact.groupBy(
        F.col("origin_account_id").alias("customer_id"), "simulation_day", "transaction_type"
    ).agg(*[aggregates[m].alias(m) for m in measures])
    grouped = (
        per_account.join(customers.select("customer_id", "customer_role"), "customer_id")
        .groupBy("simulation_day", "transaction_type", "customer_role")
        .agg(F.count(F.lit(1)).alias("distinct_customer_count"), *summed(*measures))
    )
    calendar = days.select(
        "simulation_day", "simulation_week", "day_of_simulation_week", "is_complete_day"
    )
    families = types.select("transaction_type", "transaction_family", "balance_direction")
    return (
        grouped.join(F.broadcast(families), "transaction_type")
        .join(calendar, "simulation_day")
        .withColumn(
            "transaction_amount_average",
            ratio(F.col("transaction_amount_total"), F.col("amount_count")),
        )
        .withColumn(
            "fraud_rate_percent",
            fraud_rate(F.col("fraudulent_transaction_count"), F.col("transaction_count")),
        )
        .drop("amount_count")
    )


def star_join(
    fact: DataFrame, customers: DataFrame, types: DataFrame, days: DataFrame
) -> DataFrame:
    """Fact rows with their origin customer, type and day attributes.

    The lookup of types has a fixed size and the calendar one row per simulated day;
    customers grow with the data and take a shuffled join. Their two columns are stored
    first: against a stored table, adaptive execution splits the fact side where an
    account dominates, which it does not do against an aggregate.
    """
    roles = freeze(
        customers.select(F.col("customer_id").alias("origin_account_id"), "customer_role"),
        "roles",
    )
    return (
        fact.join(F.broadcast(types.drop("description")), "transaction_type")
        .join(
            F.broadcast(
                days.select(
                    "simulation_day",
                    "simulation_week",
                    "day_of_simulation_week",
                    "is_complete_day",
                )
            ),
            "simulation_day",
        )
        .join(roles, "origin_account_id")
    )
