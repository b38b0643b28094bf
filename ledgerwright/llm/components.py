"""Connected components of a distributed edge list.

Alternating large and small stars: every node is re-linked to the smallest node among its
neighbours, first towards larger neighbours, then towards smaller ones, until each
component is a star around its smallest node. Every round is two joins over edges, written
to the shared scratch folder; no component is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.session import freeze, release

MAX_ROUNDS = 60


def _linked(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has exactly one, its centre."""
    roles = (
        edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        .unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        )
        .groupBy("node")
        .agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    )
    return roles.filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored first: a plain table on each side lets adaptive execution split a hot node.
    least = freeze(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star"
    )
    return _linked(
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = freeze(edges.groupBy("a").agg(F.min("b").alias("m")), "star")
    return _linked(
        edges.join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
    )


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """`node, component` for every node of an edge; a component is named by its least node.

    Edges are undirected and may repeat; an edge with a null end is ignored and one from a
    node to itself makes a component of one. No edges give no rows.
    """
    given = freeze(
        edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter(
            "x is not null and y is not null"
        ),
        "edges",
    )
    links = freeze(
        _linked(given.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))),
        "links",
    )
    for _ in range(MAX_ROUNDS):
        if _stars(links):
            break
        wider = freeze(_large_star(links), "links")
        release(links)
        links = freeze(_small_star(wider), "links")
        release(wider)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    alone = given.filter("x = y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    centres = links.select(F.col("b").alias("a"), "b")
    return (
        links.unionByName(centres)
        .unionByName(alone)
        .groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("component"))
    )
