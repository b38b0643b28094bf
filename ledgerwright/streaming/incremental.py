"""New ledger files into the fact table, one micro-batch at a time.

The table is a snapshot table: a batch is appended as one version, and the ledger of the
files whose rows it holds is part of that version. A file that the ledger names is not
loaded again, whoever delivers it - the same batch after a failure, a new checkpoint, or a
second query on the same target - and a file that it does not name is, whatever its day
and in whatever order and batches the files come. A file is known by its path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerwright.plans.staging import to_fact
from ledgerwright.sources.ledger import RAW_SCHEMA
from ledgerwright.sources.sinks import PARTITION
from ledgerwright.sources.snapshots import Manifest, SnapshotTable
from ledgerwright.session import freeze

FILE = "_source_file"
# Ledgers of more loads than this are put together into one.
LEDGERS = 50


def stream_ledger(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """CSV ledger files of a folder as a stream of raw rows with the file of each."""
    return (
        spark.readStream.schema(RAW_SCHEMA)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(source)
        .select("*", F.col("_metadata.file_path").alias(FILE))
    )


def load_batch(raw: DataFrame, target: str) -> Manifest | None:
    """Append the rows of files that are not in the target yet, as one new version."""
    spark = raw.sparkSession
    table = SnapshotTable(spark, target)
    base = table.manifest()
    ledgers = list(base.notes["ledgers"]) if base is not None else []
    files = freeze(raw.select(FILE).distinct(), "files")
    if ledgers:
        known = spark.read.schema(files.schema).parquet(*[f"{target}/{x}" for x in ledgers])
        new = freeze(files.join(known, FILE, "left_anti"), "files")
        # As a rule no file was loaded before, and the rows need no join.
        if new.count() < files.count():
            raw, files = raw.join(new, FILE, "left_semi"), new
    if files.isEmpty():
        return base
    ledger = f"ledgers/{uuid.uuid4().hex}"
    if len(ledgers) >= LEDGERS:
        files, ledgers = files.unionByName(known), []
    files.write.parquet(f"{target}/{ledger}")
    return table.write(
        to_fact(raw.drop(FILE)),
        PARTITION,
        appends=True,
        notes={"ledgers": [*ledgers, ledger]},
        base=base,
    )


def ingest_available(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Load every file that arrived since the last call, then stop.

    `checkpoint` remembers the files already delivered and must be on shared storage.
    Days that many batches have added to are rewritten as one load at the end.
    """
    started = (
        stream_ledger(spark, source, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda raw, batch: load_batch(raw, target))
        .start()
    )
    started.awaitTermination()
    SnapshotTable(spark, target).compact()
    return started


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """The fact rows loaded so far."""
    return SnapshotTable(spark, target).read()
