"""Versions of a dataset as a tree of content digests.

A leaf covers the rows of one split on one day. Its digest is made of sums of row hashes,
so neither order nor file layout matters, repeated rows count, and the sums of parts add
up to those of the whole. A split's digest is that of its days' digests, and the version
of the dataset that of its splits', its columns and how it was made. A changed row changes
its leaf, its split and the version, and nothing else; two trees tell which days differ.

The leaves of a snapshot table are carried over: only days whose folders changed from one
version of the table to the next are read again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.plans.training import SAMPLE_PERCENT, TRAIN_END_STEP, VALIDATION_END_STEP
from ledgerwright.session import freeze
from ledgerwright.sources.snapshots import SnapshotTable

SPLIT, DAY = "dataset_split", "simulation_day"
# How the registered dataset is made.
STRATEGY = {
    "type": "temporal",
    "train_end_step": TRAIN_END_STEP,
    "validation_end_step": VALIDATION_END_STEP,
    "legitimate_train_sample_percent": SAMPLE_PERCENT,
    "all_training_frauds_preserved": True,
}


def leaves(dataset: DataFrame) -> DataFrame:
    """One row per split and day: rows, frauds and the digest of the content.

    All columns count, by name; the order of columns does not.
    """
    columns = [F.col(c) for c in sorted(dataset.columns)]
    # A hash skips NULLs, so which columns are NULL is hashed too.
    shape = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    sums = [
        F.sum(F.xxhash64(F.lit(seed), shape, *columns).cast("decimal(38,0)")).alias(seed)
        for seed in ("first", "second")
    ]
    return (
        dataset.groupBy(SPLIT, DAY)
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("is_fraud")).alias("fraud_count"), *sums)
        .select(
            SPLIT,
            DAY,
            "row_count",
            "fraud_count",
            F.sha2(F.concat_ws(":", "row_count", "first", "second"), 256).alias("digest"),
        )
    )


def carried_leaves(known: DataFrame, table: SnapshotTable, before: int, after: int) -> DataFrame:
    """The leaves of version `after` of a table partitioned by day, from those of version
    `before`; only days made up of other folders than before are read."""
    old, new = table.manifest(before), table.manifest(after)
    changed = {v for v in {*old.parts, *new.parts} if old.parts.get(v) != new.parts.get(v)}
    made = leaves(table.read(after, where=changed.__contains__))
    kept = known.filter(~F.coalesce(F.col(DAY).cast("string").isin(sorted(changed)), F.lit(False)))
    return kept.unionByName(made)


def tree(leaf_rows: DataFrame) -> DataFrame:
    """`level, dataset_split, simulation_day, row_count, fraud_count, digest` of days,
    splits and, as `root`, the whole."""

    def above(below: DataFrame, level: str, key: str, *by: str) -> DataFrame:
        entry = F.struct(F.col(key).alias("k"), F.concat_ws(":", F.col(key).cast("string"), "digest").alias("e"))
        # One entry per child: days of a split, or splits.
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), "\n")
        return below.groupBy(*by).agg(
            F.lit(level).alias("level"),
            F.sum("row_count").alias("row_count"),
            F.sum("fraud_count").alias("fraud_count"),
            F.sha2(listed, 256).alias("digest"),
        )

    days = leaf_rows.withColumn("level", F.lit("day"))
    splits = above(leaf_rows, "split", DAY, SPLIT)
    root = above(splits, "root", SPLIT)
    return (
        days.unionByName(splits, allowMissingColumns=True)
        .unionByName(root, allowMissingColumns=True)
        .select("level", SPLIT, DAY, "row_count", "fraud_count", "digest")
    )


def changed_days(before: DataFrame, after: DataFrame) -> DataFrame:
    """`dataset_split, simulation_day, change` of leaves that were added, removed or changed."""
    old = before.select(SPLIT, DAY, F.col("digest").alias("_old"))
    new = after.select(SPLIT, DAY, F.col("digest").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    )
    return (
        old.join(new, [SPLIT, DAY], "full")
        .filter(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(SPLIT, DAY, change.alias("change"))
    )


@dataclass
class DatasetManifest:
    """A registered dataset: its version, what it is made of, and its leaves."""

    version: str
    columns: list[dict]
    strategy: dict
    splits: dict[str, dict]
    leaves: DataFrame = field(repr=False)

    def as_json(self) -> str:
        named = {k: getattr(self, k) for k in ("version", "columns", "strategy", "splits")}
        return json.dumps(named, sort_keys=True)


def register(
    dataset: DataFrame, strategy: Mapping | None = None, leaf_rows: DataFrame | None = None
) -> DatasetManifest:
    """The manifest of a dataset with splits and days; `leaf_rows` if they are known."""
    strategy = dict(STRATEGY if strategy is None else strategy)
    columns = sorted(
        ({"name": f.name, "type": f.dataType.simpleString()} for f in dataset.schema.fields),
        key=lambda c: c["name"],
    )
    stored = freeze(leaves(dataset) if leaf_rows is None else leaf_rows, "leaves")
    # One row per split.
    rows = tree(stored).filter("level <> 'day'").collect()
    splits = {
        r[SPLIT]: {"row_count": r["row_count"], "fraud_count": r["fraud_count"], "digest": r["digest"]}
        for r in rows
        if r["level"] == "split"
    }
    root = next((r["digest"] for r in rows if r["level"] == "root"), "")
    made_of = json.dumps([root, columns, strategy], sort_keys=True)
    return DatasetManifest(
        hashlib.sha256(made_of.encode()).hexdigest()[:16], columns, strategy, splits, stored
    )


def version_rows(dataset: DataFrame) -> DataFrame:
    """The digest tree of a dataset, its root named by the version."""
    made = register(dataset)
    named = F.when(F.col("level") == "root", F.lit(made.version)).otherwise(F.substring("digest", 1, 16))
    return tree(made.leaves).withColumn("version", named).drop("digest")
