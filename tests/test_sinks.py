"""Partitioned, incremental and streaming loads, schema alignment, exports."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerwright.plans.staging import to_fact
from ledgerwright.sources import sinks
from ledgerwright.sources.ledger import RAW_SCHEMA, read_ledger_csv, read_snapshot
from ledgerwright.streaming.incremental import FILE, ingest_available, load_batch, read_ingested


def same(left, right):
    left = left.select(*right.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def raw(ledger):
    rows = [{"step": s, "nameorig": f"C{s % 7}", "amount": f"{s}.50"} for s in range(1, 97)]
    return ledger(*rows).repartition(4).cache()


def test_partitioned_write_and_read(spark, raw, tmp_path):
    path = str(tmp_path / "fact")
    sinks.write_partitioned(to_fact(raw), path)
    folders = {d for d in os.listdir(path) if d.startswith("simulation_day=")}
    assert folders == {f"simulation_day={d}" for d in range(1, 5)}
    assert all(
        f.endswith(".snappy.parquet")
        for d in folders
        for f in os.listdir(f"{path}/{d}")
        if f.endswith(".parquet")
    )
    assert same(read_snapshot(spark, path), to_fact(raw))


def test_first_load_then_rest_equals_full_load(spark, raw, tmp_path):
    path = str(tmp_path / "fact")
    sinks.load_incremental(raw.filter("step <= 40"), path)
    assert sinks.last_loaded_day(spark, path) == 2
    sinks.load_incremental(raw, path)
    assert same(spark.read.parquet(path), to_fact(raw))
    sinks.load_incremental(raw, path)
    assert same(spark.read.parquet(path), to_fact(raw))


def test_late_rows_of_the_last_day_are_absorbed_and_older_ones_wait(spark, raw, ledger, tmp_path):
    path = str(tmp_path / "fact")
    sinks.load_incremental(raw, path)
    late = raw.unionByName(ledger({"step": 96, "amount": "1.00"}, {"step": 3, "amount": "2.00"}))
    sinks.load_incremental(late, path)
    loaded = spark.read.parquet(path)
    assert loaded.filter("transaction_amount = 1.00").count() == 1
    assert loaded.filter("transaction_amount = 2.00").count() == 0
    sinks.load_incremental(late, path, full_refresh=True)
    assert same(spark.read.parquet(path), to_fact(late))


def test_nothing_loaded_yet(spark, tmp_path):
    assert sinks.last_loaded_day(spark, str(tmp_path / "absent")) is None


def test_incremental_filter_reaches_the_scan(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    raw.write.parquet(path)
    plan = sinks.since_day(spark.read.parquet(path), 3)._jdf.queryExecution().toString()
    assert "GreaterThan(step,48)" in plan


def test_columns_are_added_and_dropped(spark, raw, tmp_path):
    path = str(tmp_path / "fact")
    schema = to_fact(raw).schema
    old = to_fact(raw.filter("step <= 48")).drop("is_fraud").withColumn("gone", F.lit(1))
    sinks.write_partitioned(old, path)
    new = to_fact(raw.filter("step > 48"))
    sinks.replace_partitions(sinks.align_schema(new, schema), path)
    synced = sinks.read_synced(spark, path, schema)
    assert set(synced.columns) == set(schema.names)
    assert synced.filter("is_fraud is null").count() == 48
    aligned = sinks.align_schema(old, schema)
    assert aligned.columns == schema.names and aligned.filter("is_fraud is null").count() == 48


def test_files_with_different_columns_merge_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(f"{tmp_path}/d/p=1")
    spark.createDataFrame([(2,)], "x int").write.parquet(f"{tmp_path}/d/p=2")
    merged = read_snapshot(spark, f"{tmp_path}/d")
    rows = {(r.x, r.y, r.p) for r in merged.collect()}
    assert rows == {(1, "a", 1), (2, None, 2)}


def test_csv_round_trip_and_malformed_numbers(spark, raw, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    raw.write.option("header", True).csv(good)
    scanned = read_ledger_csv(spark, good)
    assert scanned.schema == RAW_SCHEMA
    assert same(to_fact(scanned), to_fact(raw))
    raw.withColumn("amount", F.lit("many")).write.option("header", True).csv(bad)
    with pytest.raises(Exception):
        read_ledger_csv(spark, bad).collect()
    assert read_ledger_csv(spark, bad, strict=False).filter("amount is null").count() == 96


def test_split_export(spark, tmp_path):
    rows = spark.range(300).withColumn(
        "dataset_split", F.element_at(F.array(*map(F.lit, ("TRAIN", "VALIDATION", "TEST"))),
                                      (F.col("id") % 3 + 1).cast("int"))
    )
    paths = sinks.export_splits(rows, str(tmp_path / "splits"))
    assert {n: spark.read.parquet(p).count() for n, p in paths.items()} == {
        "TRAIN": 100, "VALIDATION": 100, "TEST": 100
    }
    assert all(".zstd." in f for p in paths.values() for f in os.listdir(p) if f.startswith("part"))


def test_report_is_one_csv_file(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.export_report(spark.range(20, numPartitions=4), path)
    parts = [f for f in os.listdir(path) if f.startswith("part")]
    assert len(parts) == 1
    with open(f"{path}/{parts[0]}") as f:
        assert f.readline().strip() == "id"


def test_streamed_files_equal_the_batch_load(spark, raw, ledger, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    raw.filter("step <= 60").coalesce(1).write.option("header", True).csv(source)
    ingest_available(spark, source, target, checkpoint)
    raw.filter("step > 60").coalesce(1).write.mode("append").option("header", True).csv(source)
    ingest_available(spark, source, target, checkpoint)
    ingest_available(spark, source, target, checkpoint)
    assert same(read_ingested(spark, target), to_fact(raw))
    # A repeated micro-batch changes nothing.
    again = spark.read.schema(RAW_SCHEMA).option("header", True).csv(source)
    load_batch(again.select("*", F.col("_metadata.file_path").alias(FILE)), target)
    assert same(read_ingested(spark, target), to_fact(raw))


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_the_order_of_streamed_files_does_not_matter(spark, raw, tmp_path, files_per_batch):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    # The later days come first, and each file is a batch of its own or all are one.
    for part in ("step > 60", "step <= 30", "step > 30 and step <= 60"):
        raw.filter(part).coalesce(1).write.mode("append").option("header", True).csv(source)
    ingest_available(spark, source, target, checkpoint, files_per_batch)
    assert same(read_ingested(spark, target), to_fact(raw))


def test_an_unreadable_target_is_not_an_empty_one(spark, raw, tmp_path):
    target = tmp_path / "fact"
    target.mkdir()
    (target / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        sinks.load_incremental(raw.filter("step > 48"), str(target))
    assert (target / "part-0.parquet").read_text() == "not parquet"


def test_a_changed_model_is_loaded_incrementally(spark, raw, tmp_path):
    path = str(tmp_path / "fact")
    schema = to_fact(raw).schema

    def old(rows):
        return to_fact(rows).drop("is_fraud").withColumn("gone", F.lit(1))

    sinks.load_incremental(raw.filter("step <= 48"), path, transform=old)
    sinks.load_incremental(raw, path, schema=schema)
    synced = sinks.read_synced(spark, path, schema)
    assert set(synced.columns) == set(schema.names)
    # The first day keeps its old layout, the second was the last loaded one.
    assert synced.filter("is_fraud is null").count() == 24
    assert same(synced.drop("is_fraud"), to_fact(raw).drop("is_fraud"))
