"""Dimensions: customers, simulated days, transaction types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import count_where, with_calendar
from ledgerwright.session import freeze


def account_events(fact: DataFrame) -> DataFrame:
    """One row per account taking part in a transaction, with its side.

    Merchant and unknown destinations are not customers. One scan serves both sides.
    """

    def side(account: str, role: str):
        return F.struct(
            F.col(account).alias("customer_id"), F.lit(role).alias("account_event_role")
        )

    origin = side("origin_account_id", "ORIGIN")
    destination = side("destination_account_id", "DESTINATION")
    sides = F.when(
        F.col("destination_account_type") == "CUSTOMER", F.array(origin, destination)
    ).otherwise(F.array(origin))
    return fact.select(
        "simulation_step", "simulation_day", F.explode(sides).alias("side")
    ).select("side.customer_id", "simulation_step", "simulation_day", "side.account_event_role")


def dim_customer(fact: DataFrame) -> DataFrame:
    """One row per customer: when it was seen, how often on each side, its role."""
    is_origin = F.col("account_event_role") == "ORIGIN"
    originated = F.col("originated_transaction_count")
    received = F.col("received_transaction_count")
    return (
        account_events(fact)
        .groupBy("customer_id")
        .agg(
            F.min("simulation_step").alias("first_seen_step"),
            F.max("simulation_step").alias("last_seen_step"),
            F.min("simulation_day").alias("first_seen_day"),
            F.max("simulation_day").alias("last_seen_day"),
            count_where(is_origin).alias("originated_transaction_count"),
            count_where(~is_origin).alias("received_transaction_count"),
        )
        .withColumn("total_involved_transaction_count", originated + received)
        .withColumn(
            "customer_role",
            F.when((originated > 0) & (received > 0), "ORIGIN_AND_DESTINATION")
            .when(originated > 0, "ORIGIN_ONLY")
            .otherwise("DESTINATION_ONLY"),
        )
    )


def first_event(fact: DataFrame) -> DataFrame:
    """The earliest event of every customer (destination before origin within a step)."""
    event = F.struct("simulation_step", "account_event_role", "simulation_day")
    return (
        account_events(fact)
        .groupBy("customer_id")
        .agg(F.min(event).alias("event"))
        .select("customer_id", "event.*")
    )


def events_with_span(fact: DataFrame) -> DataFrame:
    """Every account event with its customer's first and last step and origin count.

    The whole-partition values are aggregated with map-side combine, stored, and joined
    back: against a stored table, adaptive execution splits the event side where one
    customer dominates. Events without an account form one group, as in a window.
    """
    events = account_events(fact)
    spans = events.groupBy("customer_id").agg(
        F.min("simulation_step").alias("first_seen_step"),
        F.max("simulation_step").alias("last_seen_step"),
        count_where(F.col("account_event_role") == "ORIGIN").alias(
            "originated_transaction_count"
        ),
    )
    spans = freeze(spans, "spans").withColumnRenamed("customer_id", "_customer")
    same = F.col("customer_id").eqNullSafe(F.col("_customer"))
    return events.join(spans, same).drop("_customer")


def dim_simulation_day(hourly: DataFrame) -> DataFrame:
    """One row per simulated day, from the hourly totals of `hourly_totals`."""
    days = hourly.groupBy("simulation_day").agg(
        F.min("simulation_step").alias("first_simulation_step"),
        F.max("simulation_step").alias("last_simulation_step"),
        F.countDistinct("simulation_hour").alias("observed_hour_count"),
    )
    return (
        with_calendar(days)
        .withColumn("is_complete_day", F.col("observed_hour_count") == 24)
        .select(
            "simulation_day",
            "simulation_week",
            "day_of_simulation_week",
            "first_simulation_step",
            "last_simulation_step",
            "observed_hour_count",
            "is_complete_day",
        )
    )


def type_usage(types: DataFrame, hourly: DataFrame) -> DataFrame:
    """The type lookup with how many transactions of each type were observed."""
    used = hourly.groupBy("transaction_type").agg(
        F.sum("transaction_count").alias("transaction_count")
    )
    return types.join(used, "transaction_type", "left").fillna(0, ["transaction_count"])
