"""The raw ledger: schema, readers, and the reference table of transaction types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Raw column names and types as the ledger is delivered. The two
# destination balances arrive as text.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameorig", T.StringType()),
        T.StructField("oldbalanceorg", T.DoubleType()),
        T.StructField("newbalanceorig", T.DoubleType()),
        T.StructField("namedest", T.StringType()),
        T.StructField("oldbalancedest", T.StringType()),
        T.StructField("newbalancedest", T.StringType()),
        T.StructField("isfraud", T.IntegerType()),
        T.StructField("isflaggedfraud", T.IntegerType()),
    ]
)

# The static lookup of transaction types.
TRANSACTION_TYPES = [
    ("CASH_IN", "CASH", "CREDIT", "Cash deposited into an account"),
    ("CASH_OUT", "CASH", "DEBIT", "Cash withdrawn from an account"),
    ("DEBIT", "PAYMENT", "DEBIT", "Direct debit transaction"),
    ("PAYMENT", "PAYMENT", "DEBIT", "Payment made to a merchant"),
    ("TRANSFER", "TRANSFER", "DEBIT", "Transfer between customer accounts"),
]

TRANSACTION_TYPES_SCHEMA = (
    "transaction_type string, transaction_family string, "
    "balance_direction string, description string"
)


def read_ledger_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Scan a CSV ledger with a header line under the declared schema.

    No inference pass. `strict` fails on malformed numbers; otherwise they are NULL.
    """
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .csv(path)
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Scan a hive-partitioned Parquet directory, merging file columns by name."""
    return spark.read.option("mergeSchema", True).parquet(path)


def transaction_types(spark: SparkSession) -> DataFrame:
    """The five-row type lookup (fixed size, so it may always be broadcast)."""
    return spark.createDataFrame(TRANSACTION_TYPES, TRANSACTION_TYPES_SCHEMA)
