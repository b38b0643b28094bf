"""Shards by K-d tree over row metadata.

The rows are split again and again at a weighted median along the dimension in which a
node is widest, until every leaf holds about the target bytes; a shard is then a
rectangle of metadata, so readers that filter on it open few shards. All nodes of a level
are cut at once: distributed running totals over (node, value, row) find each cut to the
row. Rows carry the number of their node, and a level's cuts are a table with one row per
node that rows meet by that number, so that neither plans nor the driver grow with the
shards. Texts are read once, for their size and checksum; every later step works on a
narrow table of metadata.

Only DataFrame functions are used.

Defined cases: a null text has no bytes (size 8) and checksum 0; null metadata counts as
the least value. Equal values are told apart by the order in which rows were read, so
ties never unbalance a cut. Repeated rows are rows of their own. An empty table gives
an empty result; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.texts import utf8
from ledgerwright.operators.ordered import running_totals
from ledgerwright.session import freeze, release

ROW_OVERHEAD = 8


def text_code(column: Column) -> Column:
    """A number that orders texts by their first six bytes."""
    head = F.rpad(F.substring(F.coalesce(column, F.lit("")).cast("binary"), 1, 6), 6, F.lit(b"\0"))
    return F.conv(F.hex(head), 16, 10).cast("double")


def metadata(docs: DataFrame, dims: dict[str, Column], key: str, text: str) -> DataFrame:
    """Stored, one narrow row per document: `_row`, key, `size`, `text_crc32`, the
    dimensions, and node 0, which holds them all."""
    body = utf8(docs[text])
    return freeze(
        docs.select(
            docs[key].alias(key),
            (F.length(body) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_dim_{d}") for d, c in dims.items()],
        ).withColumns({"_row": F.monotonically_increasing_id(), "_node": F.lit(0).cast("long")}),
        "shard-rows",
    )


def _cuts(rows: DataFrame, nodes: DataFrame, dims: list[str], widths: dict[str, float]) -> DataFrame:
    """Stored, one row per node of two or more shards: `_node, first, left, right`, the
    dimension `dim` in which it is widest and `cut`, the last value and row on its left."""
    totals = rows.groupBy("_node").agg(
        F.sum("size").alias("weight"),
        *[
            ((F.max(f"_dim_{d}") - F.min(f"_dim_{d}")) / F.lit(widths[d] or 1.0)).alias(f"_spread_{d}")
            for d in dims
        ],
    )
    spreads = F.array(*[F.struct(F.col(f"_spread_{d}").alias("s"), F.lit(d).alias("d")) for d in dims])
    split = freeze(
        nodes.filter("shards > 1")
        .join(totals, "_node")
        .select(
            "_node",
            "first",
            F.floor(F.col("shards") / 2).cast("int").alias("left"),
            (F.col("shards") - F.floor(F.col("shards") / 2)).cast("int").alias("right"),
            F.array_max(spreads)["d"].alias("dim"),
            (F.col("weight") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("goal"),
        ),
        "splits",
    )
    valued = rows.join(split.select("_node", "dim"), "_node").select(
        "_node", "_row", "size", _value(dims).alias("_value")
    )
    ordered = running_totals(valued, ["_value", "_row"], {"weight": F.sum("size")}, by=["_node"])
    # The last row on the left: the one whose middle is still before the goal.
    last = (
        ordered.join(split.select("_node", "goal"), "_node")
        .filter(F.col("weight_before") + F.col("weight") / 2 <= F.col("goal"))
        .groupBy("_node")
        .agg(F.max(F.struct("_value", "_row")).alias("cut"))
    )
    return freeze(split.drop("goal").join(last, "_node", "left"), "cuts")


def _value(dims: list[str]) -> Column:
    """A row's value in the dimension that `dim` names."""
    return reduce(lambda x, d: F.when(F.col("dim") == d, F.col(f"_dim_{d}")).otherwise(x), dims, F.lit(None).cast("double"))


def _children(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """The next level: every node that was cut gives way to its two children."""
    whole = nodes.join(cuts.select("_node"), "_node", "left_anti")
    two = F.array(
        F.struct((2 * F.col("_node") + 1).alias("n"), F.col("first").alias("f"), F.col("left").alias("s")),
        F.struct(
            (2 * F.col("_node") + 2).alias("n"), (F.col("first") + F.col("left")).alias("f"), F.col("right").alias("s")
        ),
    )
    born = cuts.select(F.explode(two).alias("c")).select(
        F.col("c.n").alias("_node"), F.col("c.f").alias("first"), F.col("c.s").alias("shards")
    )
    return freeze(whole.unionByName(born), "nodes")


def _moved(rows: DataFrame, cuts: DataFrame, dims: list[str]) -> DataFrame:
    """Rows with the node of the next level that they are in."""
    value, at = _value(dims), F.col("cut._value")
    left = F.coalesce((value < at) | ((value == at) & (F.col("_row") <= F.col("cut._row"))), F.lit(False))
    node = F.when(F.col("dim").isNull(), F.col("_node")).otherwise(
        2 * F.col("_node") + F.when(left, 1).otherwise(2)
    )
    met = rows.join(cuts.select("_node", "dim", "cut"), "_node", "left")
    return freeze(met.select(*[c for c in rows.columns if c != "_node"], node.alias("_node")), "shard-rows")


def kd_shards(
    docs: DataFrame,
    dims: dict[str, Column],
    shards: int | None = None,
    target_bytes: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`key, size, text_crc32, shard, slot`: every row in one shard, slots gapless from 0.

    Give either the number of shards or the bytes that each should hold.
    """
    rows = metadata(docs, dims, key, text)
    whole = rows.agg(
        F.sum("size").alias("bytes"),
        *[(F.max(f"_dim_{d}") - F.min(f"_dim_{d}")).alias(d) for d in dims],
    ).first()
    if shards is None:
        if target_bytes is None:
            raise ValueError("give shards or target_bytes")
        shards = max(1, round((whole["bytes"] or 0) / target_bytes))
    names, widths = list(dims), {d: whole[d] for d in dims}
    nodes = rows.sparkSession.range(1).select(
        F.col("id").alias("_node"), F.lit(0).alias("first"), F.lit(shards).alias("shards")
    )
    for _ in range((shards - 1).bit_length() if whole["bytes"] is not None else 0):
        cuts = _cuts(rows, nodes, names, widths)
        moved = _moved(rows, cuts, names)
        nodes = _children(nodes, cuts)
        release(rows)
        rows = moved
    placed = rows.join(nodes.select("_node", F.col("first").alias("shard")), "_node").select(
        key, "size", "text_crc32", "_row", "shard"
    )
    return running_totals(
        placed, ["_row", key, "size", "text_crc32"], {"rows": F.count(F.lit(1))}, by=["shard"]
    ).select(key, "size", "text_crc32", "shard", F.col("rows_before").cast("long").alias("slot"))
