"""Partitioned writes, incremental loads, schema alignment and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwright.plans.staging import to_fact
from ledgerwright.sources.snapshots import Manifest, SnapshotTable, from_value

PARTITION = "simulation_day"


def write_partitioned(df: DataFrame, path: str, partition: str = PARTITION) -> None:
    """Replace the dataset at `path`: Snappy Parquet, one directory per partition value.

    The rebalance hint gathers each partition value into few files, and adaptive
    execution splits a value that holds a large part of the rows over several tasks.
    """
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "static")
        .partitionBy(partition)
        .parquet(path)
    )


def replace_partitions(df: DataFrame, path: str, partition: str = PARTITION) -> None:
    """Replace only the partitions present in `df`, leave all others untouched."""
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def last_loaded_day(spark: SparkSession, target: str) -> int | None:
    """Greatest partition value at `target`; None when nothing was loaded yet.

    The query touches the partition column only, so no data pages are read.
    """
    try:
        loaded = spark.read.parquet(target)
    except AnalysisException as error:
        # Anything but a missing path is a fault of the target, not an empty target: to
        # take it for empty would overwrite what was loaded.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return loaded.agg(F.max(PARTITION)).first()[0]


def since_day(raw: DataFrame, day: int) -> DataFrame:
    """Raw rows of `day` and later, as a predicate on the stored hour so that it
    reaches the file scan instead of being evaluated on the derived day."""
    return raw.filter(F.col("step") > 24 * (day - 1))


def load_incremental(
    raw: DataFrame,
    target: str,
    full_refresh: bool = False,
    transform: Callable[[DataFrame], DataFrame] = to_fact,
    schema: T.StructType | None = None,
) -> None:
    """Bring the fact table at `target` up to date with the raw ledger.

    The last loaded day and everything after it are recomputed and replaced, so late
    rows of that day are absorbed and a repeated load changes nothing. Rows are written
    with exactly the columns of `schema` (default: what `transform` gives); days loaded
    under an older schema stay as they are and are read as the current one by
    `read_synced`, added columns as NULL, dropped ones gone.
    """
    day = None if full_refresh else last_loaded_day(raw.sparkSession, target)
    rows = transform(raw if day is None else since_day(raw, day))
    if schema is not None:
        rows = align_schema(rows, schema)
    if day is None:
        write_partitioned(rows, target)
    else:
        replace_partitions(rows, target)


def load_snapshot(
    raw: DataFrame,
    table: SnapshotTable,
    full_refresh: bool = False,
    transform: Callable[[DataFrame], DataFrame] = to_fact,
    schema: T.StructType | None = None,
) -> Manifest:
    """As `load_incremental`, as one new version of a snapshot table.

    Readers see all of a load or nothing of it, and the version before stays readable.
    The last loaded day is known from the manifest, without a scan.
    """
    base = table.manifest()
    days = base.values() if base is not None and not full_refresh else []
    rows = transform(since_day(raw, days[-1]) if days else raw)
    if schema is not None:
        rows = align_schema(rows, schema)
    return table.write(rows, PARTITION, from_value(days[-1]) if days else None, base=base)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of `schema`: missing ones as NULL, surplus ones dropped."""
    present = {name.lower() for name in df.columns}
    return df.select(
        *[
            (F.col(f.name) if f.name.lower() in present else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def read_synced(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read files written under older schemas as the current one."""
    return spark.read.schema(schema).parquet(path)


def export_splits(dataset: DataFrame, path: str, split: str = "dataset_split") -> dict[str, str]:
    """Write every split as its own Zstandard Parquet dataset, in one pass over the data.

    Returns the path of each split.
    """
    (
        dataset.write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy(split)
        .parquet(path)
    )
    return {name: f"{path}/{split}={name}" for name in ("TRAIN", "VALIDATION", "TEST")}


def export_report(df: DataFrame, path: str) -> None:
    """Write a small analysis result as a single CSV file with a header.

    For reports of a size that one task can write. The shuffle to one partition keeps
    the work that produces the rows parallel.
    """
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
