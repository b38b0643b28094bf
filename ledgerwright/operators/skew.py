"""Finding and separating keys that hold too many rows for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.session import freeze

# More rows of one key than this do not belong into one sorted window partition.
HOT_ROWS = 2_000_000
# A list of hot keys up to this length is broadcast (a few MB); a longer one is joined.
BROADCAST_KEYS = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with at least `hot_rows` rows, or None when there are none.

    Reads one column and counts map-side first; the usual answer, none, costs one
    small job. The list has at most `rows / hot_rows` entries.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    busiest = counted.agg(F.max("_n")).first()[0]
    if busiest is None or busiest < hot_rows:
        return None
    keys = freeze(counted.filter(F.col("_n") >= hot_rows).select(key), "hot")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def split_hot(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`df` as (rows of ordinary keys, rows of hot keys); rows without a key are ordinary."""
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")
