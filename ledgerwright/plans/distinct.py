"""Exact distinct counts that add up over groups.

Customers are numbered once, in key ranges. The customers of a group are bitmaps of their
numbers, one row for 32,768 numbers, built by partial aggregates from one scan of the
ledger; the bitmaps of a coarser group are the union of those of its parts. So every level
has its true count of customers, where distinct counts of parts cannot be summed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.operators.ordered import running_totals
from ledgerwright.session import freeze

ACCOUNT = "origin_account_id"
# What the customers are counted by, finest first.
LEVELS = {
    "day_type": ["simulation_day", "transaction_type"],
    "day": ["simulation_day"],
    "type": ["transaction_type"],
    "all": [],
}


def customer_bitmaps(fact: DataFrame, keys: Sequence[str], account: str = ACCOUNT) -> DataFrame:
    """Stored: `keys`, bucket and bitmap of the customers of each group; rows without an
    account count for none."""
    # At most one row per account and group, so that no account's rows meet in a join.
    seen = freeze(fact.filter(F.col(account).isNotNull()).select(account, *keys).distinct(), "customers-seen")
    numbers = freeze(
        running_totals(seen, [account], {"_n": F.max(F.lit(1))}).select(
            account, (F.col("_n_before") + 1).cast("bigint").alias("_number")
        ),
        "customer-numbers",
    )
    return freeze(
        seen.join(numbers, account)
        .groupBy(*keys, F.bitmap_bucket_number("_number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bitmap")),
        "bitmaps",
    )


def distinct_customers(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys` and the distinct customers of each group of some of the bitmaps' keys."""
    united = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    counted = united.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias("customers"))
    return counted.withColumn("customers", F.coalesce("customers", F.lit(0)))


def customers_by_level(fact: DataFrame, levels: Mapping[str, Sequence[str]] = LEVELS) -> DataFrame:
    """`level`, the keys of the finest level (null where a level has them not), `customers`."""
    finest = next(iter(levels.values()))
    bitmaps = customer_bitmaps(fact, finest)
    types = {c: fact.schema[c].dataType for c in finest}
    out = None
    for level, keys in levels.items():
        counted = distinct_customers(bitmaps, keys).select(
            F.lit(level).alias("level"),
            *[F.col(c) if c in keys else F.lit(None).cast(types[c]).alias(c) for c in finest],
            "customers",
        )
        out = counted if out is None else out.unionByName(counted)
    return out
