"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "ledgerwright", **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Recording the call site of every column doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder, visible to every executor, for tables this application freezes.

    The cluster names it in `spark.checkpoint.dir`. A machine-local folder is
    used only in local mode, where driver and executors share one machine.
    """
    context = spark.sparkContext
    root = spark.conf.get(SCRATCH_CONF, None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SCRATCH_CONF} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="ledgerwright-")
        spark.conf.set(SCRATCH_CONF, root)
    return f"{root.rstrip('/')}/ledgerwright-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


# Rows of some MB each: a writer looks at its size after every row, not after a hundred, and a
# reader's batch, which ends with a row group, holds a few of them.
_LARGE_ROWS = {
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
}


def freeze(
    df: DataFrame, label: str = "frozen", compression: str | None = None, large_rows: bool = False
) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    Cuts the lineage in a form that survives lost executors, fixes values that a
    second evaluation could change (row layout, float sums), and keeps column
    pruning for whatever reads the result. With `large_rows` neither the tasks that write
    nor those that read hold many rows at once.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.options(**(_LARGE_ROWS if large_rows else {})).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete frozen tables that nothing reads any more.

    To be called with the frames that `freeze` returned, once all that was made of them
    is stored itself. Spark removes the shuffle files of finished jobs when the driver's
    garbage collector finds that nothing refers to them; it is asked to look now.
    """
    for table in tables:
        session = table.sparkSession
        remove(session, table._scratch_path)
    if tables:
        session._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the scratch folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
