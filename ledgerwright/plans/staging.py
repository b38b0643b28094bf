"""From the raw ledger to the typed, enriched fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import squish

MONEY = "decimal(18,2)"

# Attribute order of the transaction key.
ID_ATTRIBUTES = [
    "simulation_step",
    "transaction_type",
    "transaction_amount",
    "origin_account_id",
    "origin_balance_before",
    "origin_balance_after",
    "destination_account_id",
    "destination_balance_before",
    "destination_balance_after",
    "is_fraud",
    "is_flagged_fraud",
]

# Column order of the fact table, partition column last.
FACT_COLUMNS = [
    "transaction_id",
    "simulation_step",
    "simulation_hour",
    "transaction_type",
    "transaction_amount",
    "origin_account_id",
    "origin_balance_before",
    "origin_balance_after",
    "origin_balance_delta",
    "destination_account_id",
    "destination_account_type",
    "destination_balance_before",
    "destination_balance_after",
    "destination_balance_delta",
    "is_fraud",
    "is_flagged_fraud",
    "simulation_day",
]


def stage(raw: DataFrame, lenient: bool = False) -> DataFrame:
    """Readable names and fixed types for the raw columns.

    A value that does not fit its type raises; with `lenient` it becomes NULL.
    """

    def typed(name: str, kind: str) -> Column:
        return F.col(name).try_cast(kind) if lenient else F.col(name).cast(kind)

    return raw.select(
        typed("step", "bigint").alias("simulation_step"),
        F.upper(squish(F.col("type"))).alias("transaction_type"),
        typed("amount", MONEY).alias("transaction_amount"),
        squish(F.col("nameorig")).alias("origin_account_id"),
        typed("oldbalanceorg", MONEY).alias("origin_balance_before"),
        typed("newbalanceorig", MONEY).alias("origin_balance_after"),
        squish(F.col("namedest")).alias("destination_account_id"),
        typed("oldbalancedest", MONEY).alias("destination_balance_before"),
        typed("newbalancedest", MONEY).alias("destination_balance_after"),
        (F.col("isfraud") == 1).alias("is_fraud"),
        (F.col("isflaggedfraud") == 1).alias("is_flagged_fraud"),
    )


def enrich(staged: DataFrame) -> DataFrame:
    """Add the simulated day and hour, the destination's kind and the balance changes."""
    elapsed = F.col("simulation_step") - 1
    destination = F.col("destination_account_id")
    return staged.withColumns(
        {
            "simulation_day": (F.floor(elapsed / 24) + 1).cast("int"),
            "simulation_hour": (elapsed % 24).cast("int"),
            "destination_account_type": F.when(destination.startswith("M"), "MERCHANT")
            .when(destination.startswith("C"), "CUSTOMER")
            .otherwise("UNKNOWN"),
            "origin_balance_delta": F.col("origin_balance_after")
            - F.col("origin_balance_before"),
            "destination_balance_delta": F.col("destination_balance_after")
            - F.col("destination_balance_before"),
        }
    )


def with_transaction_id(enriched: DataFrame) -> DataFrame:
    """Fact rows: a deterministic key over the original attributes in front."""
    text = F.concat_ws("|", *[F.col(name).cast("string") for name in ID_ATTRIBUTES])
    return enriched.withColumn("transaction_id", F.upper(F.md5(text))).select(*FACT_COLUMNS)


def to_fact(raw: DataFrame, lenient: bool = False) -> DataFrame:
    """Raw ledger to fact rows; row by row, no shuffle."""
    return with_transaction_id(enrich(stage(raw, lenient)))
