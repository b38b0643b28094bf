"""Candidate pairs from buckets of any size, none of which loses a link.

The members of a small bucket are all paired with each other. Those of a larger one are
paired with a few pivots first, in time linear in their number. A pivot is the most
central member of its class, where a class is a hash of the member and centrality is how
many members share a node's buckets. Of many edited copies of one text, the text itself is
nearest to all others and shares most buckets with them; it is the pivot that links them,
where two copies may be too far apart. As classes do not depend on the bucket, the buckets
of one group name the same few pivots, and its members meet each of them once.

What the pivots did not bring into one component goes the exact way: `unsettled` names
the members of large buckets that still hold several components, and `crossing` gives all
their pairs of different components that can reach the similarity, whatever bucket they
share. It is a prefix filter: two sets that are similar enough share one of their rarest
elements. Elements found in one component only come first, as no such pair shares them,
so that a family which is one component costs nothing there. The join itself leaves out
pairs whose sizes differ too much, or whose sets cannot have enough in common behind the
element that they share.

Centralities and pivots are partial aggregates, and members meet them in joins of plain
stored tables, which adaptive execution splits where one bucket is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.session import freeze, release

# Buckets up to this size pair all their members.
WHOLE = 8
# Elements handed over at once; bounds the working memory of a task.
BATCH_ELEMENTS = 200_000
_TIES = 1 << 20
_ROUNDING = 1e-6


def pivoted(rows: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """From `bucket, node`: stored, distinct `node, pivot` pairs, the smaller number as
    pivot; and the `bucket, node` whose bucket is too large for all its pairs to be among them."""
    # A bucket of one links nothing; most are.
    sizes = freeze(
        rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes"
    )
    members = freeze(rows.join(sizes, "bucket"), "members")
    small = members.filter(F.col("size") <= WHOLE).select("bucket", "node")
    large = members.filter(F.col("size") > WHOLE)
    whole = (
        small.join(small.withColumnRenamed("node", "pivot"), "bucket")
        .filter("node > pivot")
        .select("node", "pivot")
    )
    central = freeze(
        large.groupBy("node").agg(F.sum("size").alias("centrality")), "centrality"
    )
    ranked = large.select("bucket", "node").join(central, "node").select(
        "bucket",
        "node",
        F.pmod(F.xxhash64(F.lit("class"), "node"), F.lit(classes)).alias("class"),
        # Ties are broken by a hash, so that runs agree.
        (
            F.col("centrality") * _TIES + F.pmod(F.xxhash64("node"), F.lit(_TIES))
        ).alias("rank"),
    )
    pivots = freeze(
        ranked.groupBy("bucket").agg(
            *[
                F.max_by("node", F.when(F.col("class") == c, F.col("rank"))).alias(f"p{c}")
                for c in range(classes)
            ]
        ),
        "pivots",
    )
    # Once for all buckets that name the same pivots, as those of one group do.
    met = large.select("bucket", "node").join(pivots, "bucket").drop("bucket").distinct()
    pairs = met.select(
        "node", F.explode(F.array_compact(F.array(*[f"p{c}" for c in range(classes)]))).alias("pivot")
    )
    ordered = pairs.filter("node <> pivot").select(
        F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot")
    )
    found = freeze(ordered.unionByName(whole).distinct(), "bucket-pairs")
    release(sizes, central, pivots)
    return found, large.select("bucket", "node")


def unsettled(large: DataFrame, merged: DataFrame) -> DataFrame:
    """Stored: `node, component` of the members of buckets that hold several components.

    `large` has `bucket, node`; `merged` has `node, component` of the nodes linked so far.
    """
    placed = freeze(
        large.join(merged, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component")
        ),
        "placed-members",
    )
    mixed = freeze(
        placed.groupBy("bucket")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .filter("least <> most")
        .select("bucket"),
        "mixed-buckets",
    )
    rest = freeze(placed.join(mixed, "bucket").select("node", "component").distinct(), "unsettled")
    release(placed, mixed)
    return rest


def elements(
    texts: DataFrame, make: Callable[[], Callable[[object], np.ndarray]]
) -> DataFrame:
    """`node, component, size, element` of every element of the set that a function makes
    of `body`; `texts` has `node, component, body`. `make` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()

        def packed(places, sets):
            counts = np.array([len(x) for x in sets], np.int64)
            at = np.repeat(np.array(places, np.int64), counts)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    batch.column(1).take(pa.array(at)),
                    pa.array(np.repeat(counts, counts)),
                    pa.array(np.concatenate(sets).view(np.int64)),
                ],
                names=["node", "component", "size", "element"],
            )

        for batch in batches:
            places, sets, held = [], [], 0
            for i in range(batch.num_rows):
                places.append(i)
                sets.append(np.unique(function(batch.column(2)[i].as_py())))
                held += len(sets[-1])
                if held >= BATCH_ELEMENTS:
                    yield packed(places, sets)
                    places, sets, held = [], [], 0
            if sets:
                yield packed(places, sets)

    return texts.select("node", "component", "body").mapInArrow(
        run, "node long, component long, size long, element long"
    )


def crossing(sets: DataFrame, similarity: float) -> DataFrame:
    """Stored: all `node, pivot` of different components whose sets can have a Jaccard index of
    `similarity`, from the stored rows of `elements`."""
    shared = freeze(
        sets.groupBy("element")
        .agg(
            F.count(F.lit(1)).alias("often"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
        )
        .filter("least <> most")
        .select("element", "often"),
        "shared-elements",
    )
    own = Window.partitionBy("node")
    ranked = sets.join(shared, "element").select(
        "node",
        "component",
        "size",
        "element",
        # Elements of one component only stand before all others.
        (
            F.row_number().over(own.orderBy("often", "element"))
            + F.col("size")
            - F.count(F.lit(1)).over(own)
        ).alias("position"),
    )
    prefix = freeze(
        ranked.filter(
            F.col("position") <= F.col("size") - F.ceil(F.col("size") * similarity - _ROUNDING) + 1
        ),
        "prefixes",
    )
    one = prefix.select(
        "element", F.col("node").alias("_a"), F.col("component").alias("_c"), F.col("size").alias("_n"),
        F.col("position").alias("_at"),
    )
    other = prefix.select(
        F.col("element").alias("_element"), F.col("node").alias("_b"), F.col("component").alias("_other"),
        F.col("size").alias("_m"), F.col("position").alias("_there"),
    )
    near_size = F.least("_n", "_m") >= similarity * F.greatest("_n", "_m") - _ROUNDING
    # Of the first element that a pair shares: only what follows it in both can be common.
    need = similarity / (1 + similarity) * (F.col("_n") + F.col("_m")) - _ROUNDING
    behind = 1 + F.least(F.col("_n") - F.col("_at"), F.col("_m") - F.col("_there"))
    met = one.join(
        other,
        (F.col("element") == F.col("_element")) & (F.col("_c") < F.col("_other")) & near_size & (behind >= need),
    )
    pairs = freeze(
        met.select(F.greatest("_a", "_b").alias("node"), F.least("_a", "_b").alias("pivot")).distinct(), "crossing"
    )
    release(shared, prefix)
    return pairs
