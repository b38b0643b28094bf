"""Mixing sources to target weights by hierarchical budgets.

Sources form a tree, such as domain, language, source. A token budget flows from the root
to the leaves in proportion to the weights of siblings. A node can take at most its
capacity, the tokens below it times the epochs allowed; what a child cannot take goes to
its siblings first, and only what all of them cannot take is missing from the parent,
whose own siblings have then been given it already. All arithmetic is exact on integers.

Inside a leaf, a budget of several times its tokens means whole epochs and a part of one
more. Each epoch has its own seeded order of the documents, and the last one is cut at
the longest prefix whose tokens fit. The cut is stored per leaf as the greatest order key
taken, so that choosing documents needs no join with other documents: texts meet a table
with one row per leaf. Texts of one id, or without one, are told apart by a digest.

Defined cases: a null or empty text has no tokens; it costs nothing and is taken with any
prefix that reaches its key. Null tree values form a node of their own. A node of weight
zero, and all below it, gets nothing and counts towards no capacity; negative weights are
refused. Shares are rounded down, which leaves less than one token per open child
unassigned. Rows that repeat an id and a text are taken or left together. An empty table
gives empty results. Extra columns are kept by `mixed`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.llm.texts import WORD, fresh
from ledgerwright.operators.ordered import running_totals
from ledgerwright.session import freeze

Weights = Mapping[str, Mapping[str, int]]
WIDE = "decimal(38,0)"
DIGEST = "_digest"


def word_tokens(text: Column) -> Column:
    """Tokens counted as words, where no exact token count is at hand."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_digest(text: Column) -> Column:
    """Tells the texts of one id apart; a null text is an empty one."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _weight(level: str, weights: Weights) -> Column:
    weight = F.lit(1)
    for value, w in weights.get(level, {}).items():
        weight = F.when(F.col(level) == value, F.lit(w)).otherwise(weight)
    return weight.cast("long")


def _filled(children: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """`children` (parents, child, tokens, capacity, weight, given) plus `budget`.

    Children in the order of capacity per weight: each is full as long as its weight's
    share of what is left would fill it, and the others divide the rest by weight.
    """
    group = Window.partitionBy(*(parents or [F.lit(0)]))
    # A weight of zero goes with a capacity of zero: full before anything is shared out.
    ratio = F.try_divide("capacity", "weight")
    order = group.orderBy(ratio.asc_nulls_first(), F.col(child).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = F.col("capacity").cast(WIDE) * F.sum("weight").over(from_here) <= F.col(
        "weight"
    ).cast(WIDE) * left
    rest = F.col("given") - F.coalesce(
        F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0)
    )
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group)
    return (
        children.withColumn("_full", full)
        .withColumn("_rest", rest)
        .withColumn("_open", open_weight)
        .withColumn(
            "budget",
            F.when(F.col("_full"), F.col("capacity")).otherwise(
                F.expr("cast(weight as decimal(19,0)) * cast(_rest as decimal(19,0)) div _open")
            ),
        )
        .drop("_full", "_rest", "_open")
    )


def leaf_budgets(
    rows: DataFrame, levels: Sequence[str], weights: Weights, target: Column, epochs: int
) -> DataFrame:
    """One row per leaf: the levels, its `tokens` and its `budget`.

    `rows` has the levels and `tokens`; `target` is the root's budget as an aggregate
    over the leaves' tokens. Everything after the first aggregation has at most one row
    per leaf.
    """
    weighted = reduce(lambda x, y: x & y, [_weight(level, weights) > 0 for level in levels])
    leaves = freeze(
        rows.groupBy(*levels)
        .agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        # What the mix may draw on: nothing below a node of weight zero.
        .withColumn("usable", F.when(weighted, F.col("tokens")).otherwise(0)),
        "leaves",
    )
    given = None
    for depth in range(1, len(levels) + 1):
        path, parents = list(levels[:depth]), list(levels[: depth - 1])
        nodes = (
            leaves.groupBy(*path)
            .agg(F.sum("tokens").alias("tokens"), F.sum("usable").alias("usable"))
            .withColumn("capacity", F.col("usable") * epochs)
            .drop("usable")
            .withColumn("weight", _weight(path[-1], weights))
        )
        if given is None:
            root = leaves.agg(
                F.least(target.cast("long"), F.sum("usable") * epochs).alias("given")
            )
            nodes = nodes.withColumn("given", F.lit(root.scalar()))
        else:
            upper = given.select(
                *[F.col(p).alias(f"_up_{i}") for i, p in enumerate(parents)],
                F.col("budget").alias("given"),
            )
            same = [F.col(p).eqNullSafe(F.col(f"_up_{i}")) for i, p in enumerate(parents)]
            nodes = nodes.join(upper, same).drop(*[f"_up_{i}" for i in range(len(parents))])
        given = freeze(_filled(nodes, parents, path[-1]), f"budget-{depth}")
    return given.select(*levels, "tokens", "budget")


def order_key(key: Column, epoch: Column, seed: int) -> Column:
    """Where a document stands in an epoch: a digest, so that any engine agrees."""
    return F.md5(
        F.concat_ws(
            "|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))
        ).cast("binary")
    )


def leaf_cuts(
    rows: DataFrame, budgets: DataFrame, levels: Sequence[str], seed: int, key: str = "doc_id"
) -> DataFrame:
    """One row per leaf: levels, `full_epochs`, and `cut`, the last order key and digest
    that the part of one more epoch takes (null: none)."""
    plan = freeze(
        budgets.select(
            *levels,
            F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("full_epochs"),
            F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
        ).withColumn("_leaf", F.monotonically_increasing_id()),
        "epochs",
    )
    keyed = _beside(rows.select(*levels, key, DIGEST, "tokens"), plan, levels).filter("rest > 0")
    # By number: the levels of a leaf may be null.
    ordered = running_totals(
        keyed.withColumn("_key", order_key(F.col(key), F.col("full_epochs"), seed)),
        ["_key", DIGEST, "rest"],
        {"tokens": F.sum("tokens")},
        by=["_leaf"],
    )
    cuts = (
        ordered.filter(F.col("tokens_before") + F.col("tokens") <= F.col("rest"))
        .groupBy("_leaf")
        .agg(F.max(F.struct("_key", DIGEST)).alias("cut"))
    )
    return freeze(plan.join(cuts, "_leaf", "left").drop("rest", "_leaf"), "cuts")


def _beside(left: DataFrame, right: DataFrame, levels: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on the levels in which null equals null."""
    renamed = right.select(
        *[F.col(v).alias(f"_r_{i}") for i, v in enumerate(levels)],
        *[F.col(c) for c in right.columns if c not in levels],
    )
    same = [left[v].eqNullSafe(F.col(f"_r_{i}")) for i, v in enumerate(levels)]
    return left.join(renamed, same, how).drop(*[f"_r_{i}" for i in range(len(levels))])


def copies(key: Column, digest: Column, seed: int) -> Column:
    """How often a document is taken, from the columns of `leaf_cuts`."""
    place = order_key(key, F.col("full_epochs"), seed)
    last = F.col("cut._key")
    extra = (place < last) | ((place == last) & (digest <= F.col(f"cut.{DIGEST}")))
    return (F.col("full_epochs") + F.coalesce(extra, F.lit(False)).cast("long")).cast("long")


def plan_mix(
    docs: DataFrame,
    levels: Mapping[str, str],
    weights: Weights,
    percent: int,
    epochs: int,
    seed: int,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Per document its leaf and tokens, and per leaf its cuts and budget; texts are read
    once. `levels` names the tree's levels, root first, and gives each as a SQL expression
    over the documents' columns. `percent` is the root's budget in percent of all tokens."""
    rows = freeze(
        docs.select(
            docs[key].alias(key),
            *[F.expr(x).alias(n) for n, x in levels.items()],
            word_tokens(docs[text]).alias("tokens"),
            text_digest(docs[text]).alias(DIGEST),
        ),
        "mix-rows",
    )
    negative = [f"{n} of {level}" for level, of in weights.items() for n, w in of.items() if w < 0]
    if negative:
        raise ValueError(f"negative weights: {', '.join(negative)}")
    names = list(levels)
    target = F.expr(f"sum(tokens) * {percent} div 100")
    budgets = leaf_budgets(rows, names, weights, target, epochs)
    cuts = leaf_cuts(rows, budgets, names, seed, key)
    return rows, _beside(cuts, budgets.drop("tokens"), names)


def chosen(rows: DataFrame, cuts: DataFrame, levels: Sequence[str], seed: int, key: str = "doc_id") -> DataFrame:
    """Every document with its leaf, tokens, the leaf's budget and its `copies`."""
    return _beside(rows, cuts, levels).select(
        key, *levels, "tokens", "budget", copies(F.col(key), F.col(DIGEST), seed).alias("copies")
    )


def mixed(
    docs: DataFrame,
    levels: Mapping[str, str],
    weights: Weights,
    percent: int,
    epochs: int,
    seed: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; texts are not shuffled as
    long as the table of leaves is small enough for Spark to broadcast it."""
    _, cuts = plan_mix(docs, levels, weights, percent, epochs, seed, key, text)
    names = docs.columns
    whole = fresh(docs, "_doc")
    packed = docs.select(
        F.struct(*[docs[c] for c in names]).alias(whole),
        *[F.expr(x).alias(n) for n, x in levels.items()],
    )
    taken = _beside(packed, cuts, list(levels)).withColumn(
        "_n", copies(F.col(f"{whole}.`{key}`"), text_digest(F.col(f"{whole}.`{text}`")), seed)
    )
    return (
        taken.filter("_n > 0")
        .select(whole, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
        .select(*[F.col(f"{whole}.`{c}`") for c in names])
    )
