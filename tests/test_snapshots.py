"""Versions that are published whole, and loads that go through them."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerwright.plans.staging import to_fact
from ledgerwright.sources import sinks
from ledgerwright.sources.snapshots import Conflict, SnapshotTable, from_value
from ledgerwright.streaming.incremental import ingest_available, load_batch, read_ingested


def same(left, right):
    left = left.select(*right.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def days(spark, *values):
    return spark.createDataFrame([(f"row {v}", v) for v in values], "name string, day int")


@pytest.fixture(scope="module")
def raw(ledger):
    rows = [{"step": s, "nameorig": f"C{s % 7}", "amount": f"{s}.50"} for s in range(1, 97)]
    return ledger(*rows).repartition(4).cache()


def test_versions_stay_as_they_were(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.manifest() is None and table.versions() == []
    table.write(days(spark, 1, 2, None), "day")
    table.write(days(spark, 2, 3).withColumn("name", F.lit("new")), "day", from_value(2))
    table.write(days(spark, 3), "day", appends=True)
    assert same(table.read(1), days(spark, 1, 2, None))
    rows = sorted((r.name, r.day or 0) for r in table.read().collect())
    assert rows == [("new", 2), ("new", 3), ("row 1", 1), ("row 3", 3), ("row None", 0)]
    assert table.manifest().values() == [1, 2, 3]
    assert table.read(where=lambda v: v == "3").count() == 2
    assert table.files().count() == 5
    with pytest.raises(ValueError):
        table.read(9)


def test_a_replaced_partition_without_new_rows_goes(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(days(spark, 1, 2, 3), "day")
    table.write(days(spark, 2), "day", from_value(2))
    assert same(table.read(), days(spark, 1, 2))
    table.write(days(spark).limit(0), "day")
    assert table.read().count() == 0 and same(table.read(1), days(spark, 1, 2, 3))


def test_a_writer_that_dies_between_partitions_changes_nothing(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(days(spark, 1, 2), "day")
    broken = days(spark, 1, 2, 3).repartition(3, "day").withColumn(
        "name", F.when(F.col("day") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("name"))
    )
    with pytest.raises(Exception, match="lost"):
        table.write(broken, "day", from_value(1))
    assert table.versions() == [1]
    assert same(table.read(), days(spark, 1, 2))


def test_a_driver_that_dies_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.write(days(spark, 1), "day")

    def dies(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(table, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            table.write(days(spark, 7), "day")
    assert same(SnapshotTable(spark, str(tmp_path / "t")).read(), days(spark, 1))
    # Its files are there, and go with the next clearing.
    assert len(os.listdir(tmp_path / "t" / "files")) == 2
    (removed,) = table.expire()
    assert removed.endswith("day=7") and len(os.listdir(tmp_path / "t" / "files")) == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    base = table.write(days(spark, 1), "day")
    table.write(days(spark, 2), "day", appends=True, base=base)
    with pytest.raises(Conflict):
        table.write(days(spark, 3), "day", appends=True, base=base)
    assert same(table.read(), days(spark, 1, 2))


def test_old_versions_go_on_request(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    for value in (1, 2, 3):
        table.write(days(spark, value), "day")
    table.write(days(spark, 4), "day", appends=True)
    removed = table.expire(keep=2)
    assert table.versions() == [3, 4] and len(removed) == 2
    assert same(table.read(3), days(spark, 3)) and same(table.read(), days(spark, 3, 4))


def test_many_loads_of_a_day_become_one(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    for _ in range(4):
        table.write(days(spark, 1, 2).filter("day = 1 or rand() < 2"), "day", appends=True)
    before = table.read().count()
    made = table.compact(most=3)
    assert all(len(folders) == 1 for folders in made.parts.values())
    assert table.read().count() == before == 8
    assert table.compact(most=3).version == made.version


def test_loads_are_versions(spark, raw, ledger, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "fact"))
    sinks.load_snapshot(raw.filter("step <= 40"), table)
    sinks.load_snapshot(raw, table)
    assert same(table.read(), to_fact(raw))
    assert same(table.read(1), to_fact(raw.filter("step <= 40")))
    late = raw.unionByName(ledger({"step": 96, "amount": "1.00"}, {"step": 3, "amount": "2.00"}))
    sinks.load_snapshot(late, table)
    assert table.read().filter("transaction_amount = 1.00").count() == 1
    assert table.read().filter("transaction_amount = 2.00").count() == 0
    sinks.load_snapshot(late, table, full_refresh=True)
    assert same(table.read(), to_fact(late))
    # Without a scan: what was loaded is known from the manifest.
    assert table.manifest().values() == [1, 2, 3, 4]


def test_a_changed_model_is_loaded_as_the_new_one(spark, raw, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "fact"))
    schema = to_fact(raw).schema
    sinks.load_snapshot(
        raw.filter("step <= 48"), table, transform=lambda r: to_fact(r).drop("is_fraud").withColumn("gone", F.lit(1))
    )
    sinks.load_snapshot(raw, table, schema=schema)
    rows = table.read()
    assert set(rows.columns) == set(schema.names)
    assert rows.filter("is_fraud is null").count() == 24


def write_csv(rows, path):
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def test_two_checkpoints_on_one_target_lose_nothing(spark, raw, tmp_path):
    first, second, target = (str(tmp_path / n) for n in ("a", "b", "out"))
    write_csv(raw.filter("step % 2 = 0"), first)
    write_csv(raw.filter("step % 2 = 1"), second)
    ingest_available(spark, first, target, str(tmp_path / "check-a"))
    ingest_available(spark, second, target, str(tmp_path / "check-b"))
    assert same(read_ingested(spark, target), to_fact(raw))


def test_a_lost_checkpoint_repeats_nothing(spark, raw, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("step <= 30", "step > 30 and step <= 60"):
        write_csv(raw.filter(part), source)
    ingest_available(spark, source, target, str(tmp_path / "check"), 1)
    write_csv(raw.filter("step > 60"), source)
    # The new checkpoint delivers all three files, in other batches.
    ingest_available(spark, source, target, str(tmp_path / "another"))
    assert same(read_ingested(spark, target), to_fact(raw))


def test_ledgers_of_many_loads_are_put_together(spark, raw, tmp_path, monkeypatch):
    from ledgerwright.streaming import incremental

    monkeypatch.setattr(incremental, "LEDGERS", 2)
    target = str(tmp_path / "out")
    named = raw.withColumn(incremental.FILE, F.concat(F.lit("file-"), F.col("step") % 5))
    for i in (0, 1, 2, 3, 3, 0):
        load_batch(named.filter(F.col("step") % 5 == i), target)
    made = load_batch(named, target)
    assert len(made.notes["ledgers"]) <= 2
    assert same(read_ingested(spark, target), to_fact(raw))
