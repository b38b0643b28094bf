"""Digest trees, additive distinct counts, and metrics taken while writing."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwright.plans import dashboards, distinct, versions
from ledgerwright.sources.snapshots import SnapshotTable


@pytest.fixture(scope="module")
def dataset(spark):
    seed = random.Random(4)
    rows = [
        (i, f"C{seed.randint(0, 40)}", d, "TRAIN" if d < 6 else "TEST", seed.random() < 0.2, None if i % 7 == 0 else i / 4)
        for i, d in ((i, i % 9 + 1) for i in range(400))
    ]
    schema = "id int, origin_account_id string, simulation_day int, dataset_split string, is_fraud boolean, x double"
    return spark.createDataFrame(rows, schema).cache()


def listed(rows):
    return {(r.level, r.dataset_split, r.simulation_day): r.version for r in rows.collect()}


def test_a_changed_row_changes_its_path_only(dataset):
    before = listed(versions.version_rows(dataset))
    assert len(before) == 9 + 2 + 1
    assert listed(versions.version_rows(dataset.repartition(7).select(*reversed(dataset.columns)))) == before
    row = F.col("id") == 12
    for changed in (
        dataset.withColumn("x", F.when(row, 1.5).otherwise(F.col("x"))),
        dataset.withColumn("x", F.when(~row, F.col("x"))),
        dataset.filter(~row),
        dataset.unionByName(dataset.filter(row)),
    ):
        after = listed(versions.version_rows(changed))
        assert {k for k in before if before[k] != after[k]} == {
            ("root", None, None), ("split", "TRAIN", None), ("day", "TRAIN", 4)
        }


def test_the_manifest_names_columns_splits_and_strategy(dataset):
    made = versions.register(dataset)
    assert made.splits["TRAIN"]["row_count"] == dataset.filter("dataset_split = 'TRAIN'").count()
    assert made.splits["TEST"]["fraud_count"] == dataset.filter("dataset_split = 'TEST' and is_fraud").count()
    assert {"name": "x", "type": "double"} in made.columns and '"train_end_step": 322' in made.as_json()
    assert versions.register(dataset).version == made.version
    assert versions.register(dataset, {"type": "other"}).version != made.version
    assert versions.register(dataset.withColumnRenamed("x", "y")).version != made.version
    assert versions.register(dataset.limit(0)).splits == {}


def test_only_changed_days_are_read_again(spark, dataset, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(dataset, "simulation_day")
    known = versions.leaves(table.read())
    late = dataset.filter("simulation_day = 7").withColumn("x", F.lit(0.0))
    table.write(late, "simulation_day", lambda v: v in ("7", "9"))
    read = []
    original = SnapshotTable.read

    def noted(self, version=None, schema=None, where=None):
        rows = original(self, version, schema, where)
        read.append({r.simulation_day for r in rows.select("simulation_day").distinct().collect()})
        return rows

    monkeypatch.setattr(SnapshotTable, "read", noted)
    carried = versions.carried_leaves(known, table, 1, 2)
    assert read == [{7}]
    whole = versions.leaves(original(table))
    assert versions.changed_days(carried, whole).isEmpty() and carried.count() == whole.count()
    changes = {(r.simulation_day, r.change) for r in versions.changed_days(known, whole).collect()}
    assert changes == {(7, "changed"), (9, "removed")}


def test_distinct_counts_at_every_level(spark, dataset):
    rows = dataset.withColumn("transaction_type", F.col("dataset_split")).withColumn(
        "origin_account_id", F.when(F.col("id") % 5 > 0, F.col("origin_account_id"))
    )
    bitmaps = distinct.customer_bitmaps(rows, ["simulation_day", "transaction_type"])
    for keys in (["simulation_day", "transaction_type"], ["simulation_day"], ["transaction_type"], []):
        want = rows.groupBy(*keys).agg(F.count_distinct("origin_account_id").alias("customers"))
        got = distinct.distinct_customers(bitmaps, keys)
        assert got.exceptAll(want.filter("customers > 0")).isEmpty() and got.count() == want.filter("customers > 0").count()
    spread = spark.range(100_000).selectExpr(
        "concat('C', id) origin_account_id", "id % 3 simulation_day", "'T' transaction_type"
    )
    counts = {(r.level, r.simulation_day): r.customers for r in distinct.customers_by_level(spread).collect()}
    assert counts["all", None] == 100_000 and counts["day", 1] == 33_333


def test_metrics_are_those_of_the_rows_written(spark, dataset, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    metrics = {"frauds": F.count_if(F.col("is_fraud")), "least": F.min("id"), "most": F.max("x")}
    made = table.write(dataset, "simulation_day", metrics=metrics)
    assert made.written == {
        "rows": 400, "frauds": dataset.filter("is_fraud").count(), "least": 0,
        "most": dataset.agg(F.max("x")).first()[0],
    }
    assert table.manifest().written == made.written
    listed = dashboards.dataset_metadata({"a": dataset, "b": dataset.limit(0)}, "here", str(tmp_path), spark)
    assert [(r.table_name, r.row_count, r.snapshot_id) for r in listed.collect()] == [("a", 400, 1), ("b", 0, 1)]
    assert SnapshotTable(spark, str(tmp_path / "a")).read().count() == 400


def test_a_task_that_is_tried_again_counts_once(tmp_path):
    """In a session of its own, as only there a failed task is tried again."""
    import subprocess
    import sys

    script = f'''
import os, sys
sys.path.insert(0, {str(__import__("os").getcwd())!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from ledgerwright.sources.snapshots import SnapshotTable
spark = SparkSession.builder.master("local[2, 3]").config("spark.ui.enabled", "false").getOrCreate()
def once(batches):
    from pyspark import TaskContext
    for n, batch in enumerate(batches):
        yield batch
    if TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() < 2:
        raise RuntimeError("lost")
rows = spark.range(0, 4000, 1, 4).mapInArrow(once, "id long")
made = SnapshotTable(spark, {str(tmp_path / "t")!r}).write(rows, None)
print("rows", made.written["rows"], SnapshotTable(spark, {str(tmp_path / "t")!r}).read().count())
'''
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "rows 4000 4000" in out.stdout, out.stderr[-2000:]
