"""Account features day by day, from carried state instead of whole histories.

What the features of new rows need of the rows before them fits into one row per account:
how many there are, their exact total, how many have an amount, the last ten rows, and the
rows per hour of the last 168 hours. A load reads the state as it was before the last
loaded day and the fact rows from that day on; late rows of that day are absorbed, as the
state of the day before is where the load starts again.

A new row also changes one older row, whose next amount it is: the last one of its account
before the load. Such rows are not rewritten. Their next amounts are kept as links, one
per account and load, which readers put in their place; only rows whose next row is not
in their load, or on its last day, can have one.

Three tables belong together: features, links and state. The version of the features
names the versions of the other two and is published last, so that readers see one load
or the next, never parts of both.

Ordinary accounts take one shuffle of their new rows, which meet the rows that the state
stands for. A hot account is split within a load as in `history`: blocks of its new rows,
where the state takes the place of a block before the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwright.operators.history import (
    _TIE,
    ACCOUNT,
    AMOUNT,
    ID,
    LAST_ROWS,
    NEXT_STEP,
    NO_ACCOUNT,
    RANGES,
    STEP,
    _derived,
    _last_of,
    _last_rows,
    _sum_or_null,
    _windowed,
    _within_hours,
    block_totals,
)
from ledgerwright.operators.ordered import BLOCK, range_layout
from ledgerwright.operators.skew import HOT_ROWS, hot_keys, split_hot
from ledgerwright.session import freeze
from ledgerwright.sources.snapshots import Manifest, SnapshotTable, from_value

DAY = "simulation_day"
NUMBER = "customer_transaction_number"
NEXT = "next_transaction_amount"
HOURS_KEPT = max(RANGES.values())
# Whether a later load can give the row another next one: its next row is on the last day
# of the load, or not there yet.
OPEN = "_open"
_THROUGH = "through_day"
_STATE_COLUMNS = ["rows", "total", "amounts", "tail", "hours"]
_TAIL = f"array<struct<{STEP}:bigint,{ID}:string,{_TIE}:bigint,{AMOUNT}:decimal(18,2)>>"
_HOURS = "array<struct<step:bigint,n:bigint>>"
# One row per account.
STATE = f"{ACCOUNT} string, rows bigint, total decimal(28,2), amounts bigint, tail {_TAIL}, hours {_HOURS}"


# What a row is while histories are continued: rows of an hour, one of the last rows of
# the state, or a new row.
_KIND = "_kind"
_HOUR, _TAIL_ROW, _NEW = 0, 1, 2


def _parted(facts: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary accounts, and those of hot ones in blocks, if there are any."""
    named = facts.withColumn(ACCOUNT, F.coalesce(ACCOUNT, F.lit(NO_ACCOUNT)))
    hot = hot_keys(named, ACCOUNT, hot_rows)
    if hot is None:
        return named, None
    ordinary, crowded = split_hot(named, ACCOUNT, hot)
    numbered = freeze(crowded, "crowded").withColumn(_TIE, F.monotonically_increasing_id())
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, -(-numbered.count() // hot_rows))
    laid = range_layout(numbered, ACCOUNT, STEP, ID, _TIE, blocks=blocks)
    return ordinary.select(*facts.columns), laid


def _met(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state of the accounts that `rows` has."""
    return state.join(rows.select(ACCOUNT).distinct(), ACCOUNT, "left_semi")


def _hours_before(state: DataFrame) -> DataFrame:
    return state.select(ACCOUNT, F.explode("hours").alias("h")).select(
        ACCOUNT, F.col("h.step").alias(STEP), F.col("h.n").alias("_n")
    )


def _rows_before(state: DataFrame) -> DataFrame:
    """The rows that a state stands for: its last rows, the first of which also stands for
    all rows and totals, and before them one row for the other rows of each hour."""
    tails = state.select(
        ACCOUNT, "rows", "total", "amounts", F.posexplode("tail").alias("_at", "_row")
    )
    first = F.col("_at") == 0
    last_rows = tails.select(
        ACCOUNT,
        F.lit(_TAIL_ROW).alias(_KIND),
        F.col(f"_row.{STEP}").alias(STEP),
        # Their places, 0 to 9, stand for their ids, which are many times as long.
        F.col("_at").cast("string").alias(ID),
        F.col(f"_row.{AMOUNT}").alias(AMOUNT),
        F.lit(1).cast("bigint").alias("_n"),
        F.when(first, F.col("rows")).otherwise(F.lit(0)).alias("_rows"),
        F.when(first, F.col("total")).alias("_total"),
        F.when(first, F.col("amounts")).otherwise(F.lit(0)).alias("_amounts"),
    )
    # Of the hour of the first of the last rows, some rows may come before them.
    start = F.col("tail")[0][STEP]
    at_start = F.size(F.filter("tail", lambda r: r[STEP] == start))
    earlier = F.filter(
        F.transform(
            F.filter("hours", lambda h: h["step"] <= start),
            lambda h: F.struct(
                h["step"].alias("step"),
                (h["n"] - F.when(h["step"] == start, at_start).otherwise(F.lit(0))).alias("n"),
            ),
        ),
        lambda h: h["n"] > 0,
    )
    hours = _hours_before(state.select(ACCOUNT, earlier.alias("hours"))).withColumn(_KIND, F.lit(_HOUR))
    return last_rows.unionByName(hours, allowMissingColumns=True)


def _continued_accounts(facts: DataFrame, state: DataFrame | None) -> DataFrame:
    """The features of new rows of ordinary accounts, which one task each can order."""
    rows = facts.select(
        "*",
        F.lit(_NEW).alias(_KIND),
        F.lit(1).cast("bigint").alias("_n"),
        F.lit(1).cast("bigint").alias("_rows"),
        F.col(AMOUNT).cast("decimal(28,2)").alias("_total"),
        F.col(AMOUNT).isNotNull().cast("bigint").alias("_amounts"),
    )
    if state is not None:
        rows = rows.unionByName(_rows_before(_met(state, facts)), allowMissingColumns=True)
    account = Window.partitionBy(ACCOUNT)
    # Rows of the state are of earlier hours than new rows.
    ordered = account.orderBy(STEP, _KIND, ID)
    start = Window.unboundedPreceding
    prior_rows = ordered.rowsBetween(start, -1)
    # Row windows first: their sort also serves the step ranges.
    by_rows = rows.select(
        "*",
        F.sum("_rows").over(ordered.rowsBetween(start, 0)).alias(NUMBER),
        F.lag(AMOUNT).over(ordered).alias("previous_transaction_amount"),
        F.lag(STEP).over(ordered).alias("previous_transaction_step"),
        F.lead(AMOUNT).over(ordered).alias(NEXT),
        F.lead(STEP).over(ordered).alias(NEXT_STEP),
        _last_rows(F.sum(AMOUNT), ordered).alias("_last_total"),
        F.stddev_samp(F.col(AMOUNT).cast("double"))
        .over(ordered.rowsBetween(-LAST_ROWS, -1))
        .alias("std_last_10_transactions"),
        _last_rows(F.count(AMOUNT), ordered).alias("_last_amounts"),
        F.coalesce(F.sum("_amounts").over(prior_rows), F.lit(0)).alias("_prior_amounts"),
        F.sum("_total").over(prior_rows).cast("decimal(28,2)").alias("cumulative_transaction_value"),
    )
    by_step, counted = account.orderBy(STEP), F.sum("_n")
    windowed = by_rows.select(
        "*",
        *[
            F.coalesce(
                _within_hours(hours, by_step, counted),
                # Nothing is that old.
                counted.over(by_step.rangeBetween(start, -1)),
                F.lit(0),
            ).alias(name)
            for name, hours in RANGES.items()
        ],
    )
    # A row without an hour has its place in the order but no features.
    return windowed.filter((F.col(_KIND) == _NEW) & F.col(STEP).isNotNull()).drop(
        _KIND, "_n", "_rows", "_total", "_amounts"
    )


def continued_history(
    facts: DataFrame, state: DataFrame | None, newest: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The features of new rows, all of them later than those that `state` is made of.

    As `account_history` over all rows, and `_open`. Next amounts are those known from the
    new rows, the last day of which is `newest`.
    """
    ordinary, laid = _parted(facts, hot_rows)
    windowed = _continued_accounts(ordinary, state)
    if laid is not None:
        met = hours = None
        if state is not None:
            met = freeze(_met(state, laid), "met-state")
            hours = _hours_before(met)
        windowed = windowed.unionByName(_windowed(laid, block_totals(laid, met), hours))
    # The next load starts again with the last day.
    follows = F.coalesce(F.ceil(F.col(NEXT_STEP) / 24) < newest, F.lit(False))
    return (
        _derived(windowed)
        .withColumn(OPEN, F.coalesce(F.col(DAY) < newest, F.lit(True)) & ~follows)
        .withColumn(ACCOUNT, F.nullif(F.col(ACCOUNT), F.lit(NO_ACCOUNT)))
        .drop(NEXT_STEP)
    )


def next_amounts(facts: DataFrame, state: DataFrame) -> DataFrame:
    """The next amount of the last row that each account of `state` has, where new rows
    follow it: account, number of that row, its day, the day of the next one, the amount."""
    named = facts.withColumn(ACCOUNT, F.coalesce(ACCOUNT, F.lit(NO_ACCOUNT)))
    first = named.groupBy(ACCOUNT).agg(
        F.min_by(F.struct(AMOUNT, DAY), F.struct(STEP, ID)).alias("_first")
    )
    last = state.select(
        ACCOUNT,
        F.col("rows").alias(NUMBER),
        F.ceil(F.element_at("tail", -1)[STEP] / 24).cast("bigint").alias("row_day"),
    )
    return last.join(first, ACCOUNT).select(
        ACCOUNT,
        NUMBER,
        "row_day",
        F.col(f"_first.{DAY}").alias(DAY),
        F.col(f"_first.{AMOUNT}").alias(NEXT),
    )


def _account_totals(facts: DataFrame, oldest: int) -> DataFrame:
    """What the rows of ordinary accounts add to the state, from one shuffle of them."""
    account = Window.partitionBy(ACCOUNT)
    from_last, by_step = account.orderBy(F.desc(STEP), F.desc(ID)), account.orderBy(F.desc(STEP))
    same_step = by_step.rangeBetween(Window.currentRow, Window.currentRow)
    numbered = facts.select(
        ACCOUNT,
        STEP,
        ID,
        AMOUNT,
        F.row_number().over(from_last).alias("_from_end"),
        F.rank().over(by_step).alias("_step_from_end"),
        F.count(F.lit(1)).over(same_step).alias("n"),
    )
    last_row = F.struct(STEP, ID, F.lit(0).cast("bigint").alias(_TIE), AMOUNT)
    one_of_step = F.col("_from_end") == F.col("_step_from_end")
    return numbered.groupBy(ACCOUNT).agg(
        F.count(F.lit(1)).alias("_new_rows"),
        F.sum(AMOUNT).alias("_new_total"),
        F.count(AMOUNT).alias("_new_amounts"),
        F.sort_array(F.collect_list(F.when(F.col("_from_end") <= LAST_ROWS, last_row))).alias("_new_tail"),
        F.collect_list(
            F.when(one_of_step & (F.col(STEP) > oldest), F.struct(F.col(STEP).alias("step"), "n"))
        ).alias("_new_hours"),
    )


def _block_account_totals(laid: DataFrame, oldest: int) -> DataFrame:
    """The same of rows laid out in blocks."""
    per_step = (
        laid.filter(F.col(STEP) > oldest).groupBy(ACCOUNT, STEP).agg(F.count(F.lit(1)).alias("n"))
    )
    # Per block, what came before it and what is in it; the last block has everything.
    inside = laid.groupBy(ACCOUNT, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(AMOUNT).alias("_total"),
        F.count(AMOUNT).alias("_amounts"),
    )
    new = (
        block_totals(laid)
        .join(inside, [ACCOUNT, BLOCK])
        .filter(F.col("_after").isNull())
        .select(
            ACCOUNT,
            (F.col("_rows_before") + F.col("_rows")).alias("_new_rows"),
            _sum_or_null(F.col("_total_before"), F.col("_total")).alias("_new_total"),
            (F.col("_amounts_before") + F.col("_amounts")).alias("_new_amounts"),
            _last_of(F.concat("_near", "_tail")).alias("_new_tail"),
        )
    )
    hours = per_step.groupBy(ACCOUNT).agg(
        F.collect_list(F.struct(F.col(STEP).alias("step"), "n")).alias("_new_hours")
    )
    return new.join(hours, ACCOUNT, "left")


def updated_state(
    state: DataFrame | None, facts: DataFrame, through_day: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The state at the end of a day, after `facts`, all later than those of `state`."""
    oldest = 24 * through_day - HOURS_KEPT
    ordinary, laid = _parted(facts, hot_rows)
    new = _account_totals(ordinary, oldest)
    if laid is not None:
        new = new.unionByName(_block_account_totals(laid, oldest))
    if state is None:
        state = new.sparkSession.createDataFrame([], STATE)
    joined = state.join(new, ACCOUNT, "full")

    def or_none(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.array().cast(kind))

    every_hour = F.concat(or_none("hours", _HOURS), or_none("_new_hours", _HOURS))
    return joined.select(
        ACCOUNT,
        (F.coalesce("rows", F.lit(0)) + F.coalesce("_new_rows", F.lit(0))).cast("bigint").alias("rows"),
        _sum_or_null(F.col("total"), F.col("_new_total")).alias("total"),
        (F.coalesce("amounts", F.lit(0)) + F.coalesce("_new_amounts", F.lit(0))).cast("bigint").alias("amounts"),
        _last_of(F.concat(or_none("tail", _TAIL), or_none("_new_tail", _TAIL))).alias("tail"),
        F.filter(every_hour, lambda h: h["step"] > oldest).alias("hours"),
    )


class FeatureStore:
    """Features of a growing fact table, at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, hot_rows: int = HOT_ROWS):
        self.features = SnapshotTable(spark, f"{path}/features")
        self.links = SnapshotTable(spark, f"{path}/links")
        self.state = SnapshotTable(spark, f"{path}/state")
        self.hot_rows = hot_rows

    def load(self, facts: DataFrame) -> Manifest | None:
        """Bring the features up to date with the fact rows.

        Rows of the last loaded day and later are taken; older ones are not read, so that
        `facts` needs to hold only these. Loading the same rows again changes nothing but
        the version.
        """
        base = self.features.manifest()
        last = base.values()[-1] if base is not None and base.values() else None
        notes = dict(base.notes) if base is not None else {}
        new = freeze(facts if last is None else facts.filter(F.col(DAY) >= last), "new-facts", "zstd")
        newest = new.agg(F.max(DAY)).first()[0]
        if newest is None:
            return base
        state = None
        if notes.get("state") is not None:
            state = self.state.read(notes["state"]).select(ACCOUNT, *_STATE_COLUMNS)
        rows = continued_history(new, state, newest, self.hot_rows)
        if state is not None:
            links = self.links.write(
                next_amounts(new, state), DAY, from_value(last), base=self.links.manifest()
            )
            notes["links"] = links.version
        if last is None or newest > last:
            # The next load starts again with the newest day.
            before = new.filter(F.col(DAY) < newest)
            if not before.isEmpty():
                after = updated_state(state, before, newest - 1, self.hot_rows)
                made = self.state.write(after.withColumn(_THROUGH, F.lit(newest - 1)), _THROUGH)
                notes["state"] = made.version
        return self.features.write(
            rows, DAY, None if last is None else from_value(last), notes=notes, base=base
        )

    def read(self, version: int | None = None) -> DataFrame:
        """The features of all rows loaded, with the next amounts that came later."""
        manifest = self.features.manifest(version)
        rows = self.features.read(None if manifest is None else manifest.version)
        if manifest.notes.get("links") is None:
            return rows.drop(OPEN)
        links = self.links.read(manifest.notes["links"]).select(
            F.col(ACCOUNT).alias("_account"),
            F.col(NUMBER).alias("_number"),
            F.col("row_day").alias("_row_day"),
            F.struct(NEXT).alias("_link"),
        )
        names = [c for c in rows.columns if c != OPEN]
        met = rows.filter(OPEN).join(
            links,
            (F.coalesce(ACCOUNT, F.lit(NO_ACCOUNT)) == F.col("_account"))
            & (F.col(NUMBER) == F.col("_number"))
            & (F.col(DAY) == F.col("_row_day")),
            "left",
        )
        later = F.when(F.col("_link").isNull(), F.col(NEXT)).otherwise(F.col(f"_link.{NEXT}"))
        linked = met.select(*[later.alias(c) if c == NEXT else F.col(c) for c in names])
        return rows.filter(~F.col(OPEN)).select(*names).unionByName(linked)

