"""A ledger derived from an orders and a customer table.

Order priorities map to transaction types, order dates to simulated hours 1..743,
and every 23rd urgent or high-priority order becomes a fraud that drains its account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Mapping of priorities to transaction types and the time compression.
PRIORITY_TYPES = {
    "1-URGENT": "TRANSFER",
    "2-HIGH": "CASH_OUT",
    "3-MEDIUM": "PAYMENT",
    "4-NOT SPECIFIED": "CASH_IN",
}
OTHER_TYPE = "DEBIT"
FIRST_DATE = "1995-01-01"
CALENDAR_DAYS = 2405
SIMULATED_HOURS = 743
# The columns read, declared so that no job has to infer them.
ORDERS_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
CUSTOMER_SCHEMA = "c_custkey bigint, c_acctbal double"


def ledger_from_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Raw ledger rows, one per order, in the raw column layout."""
    joined = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"
    ).join(
        customers.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey"
    )
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    priority = F.col("o_orderpriority")
    elapsed = F.datediff("o_orderdate", F.to_date(F.lit(FIRST_DATE))) * SIMULATED_HOURS
    kind = F.lit(OTHER_TYPE)
    for source, target in PRIORITY_TYPES.items():
        kind = F.when(priority == source, target).otherwise(kind)
    fraud = priority.isin("1-URGENT", "2-HIGH") & (key % 23 == 0)
    balance = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 50
    medium = priority == "3-MEDIUM"
    recorded = (key % 1000) * F.lit(100.0)
    customer_code = F.floor(F.col("o_custkey") / 10).cast("bigint") * 10
    money = "decimal(18,2)"
    return joined.select(
        (F.floor(elapsed / CALENDAR_DAYS) + 1).cast("bigint").alias("step"),
        kind.alias("type"),
        price.cast(money).alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameorig"),
        F.when(fraud, price)
        .when(F.col("c_acctbal") < 0, 0.0)
        .otherwise(F.col("c_acctbal") * 50)
        .cast(money)
        .alias("oldbalanceorg"),
        F.when(fraud, 0.0)
        .when(priority == "4-NOT SPECIFIED", balance + price)
        .otherwise(F.greatest(balance - price, F.lit(0.0)))
        .cast(money)
        .alias("newbalanceorig"),
        F.when(medium, F.concat(F.lit("M"), (key % 200).cast("string")))
        .when(key % 3 == 0, F.concat(F.lit("C"), customer_code.cast("string")))
        .otherwise(F.concat(F.lit("C"), (key % 5000 + 1000000).cast("string")))
        .alias("namedest"),
        F.when(medium | (key % 4 == 0), 0.0)
        .otherwise(recorded)
        .cast(money)
        .alias("oldbalancedest"),
        F.when(medium, 0.0)
        .when(key % 4 == 0, price)
        .otherwise(recorded + price)
        .cast(money)
        .alias("newbalancedest"),
        fraud.cast("int").alias("isfraud"),
        ((priority == "1-URGENT") & (key % 23 == 0) & (price > 400000))
        .cast("int")
        .alias("isflaggedfraud"),
    )


def read_orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ledger over `<sf_dir>/orders.parquet` and `<sf_dir>/customer.parquet`."""
    return ledger_from_orders(
        spark.read.schema(ORDERS_SCHEMA).parquet(f"{sf_dir}/orders.parquet"),
        spark.read.schema(CUSTOMER_SCHEMA).parquet(f"{sf_dir}/customer.parquet"),
    )
