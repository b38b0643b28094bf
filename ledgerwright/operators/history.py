"""Behavioural features over the earlier rows of the same account.

An account's rows are ordered by `(simulation_step, transaction_id)`. Ordinary
accounts take one shuffle on the account and one sort. Accounts with very many rows
are cut into consecutive blocks; each block gets the few rows just outside it and the
totals of everything before it, so that the results are the same as over the whole
account.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerwright.functions import ratio
from ledgerwright.operators.ordered import BLOCK, range_layout
from ledgerwright.operators.skew import HOT_ROWS, hot_keys, split_hot
from ledgerwright.session import freeze

ACCOUNT = "origin_account_id"
STEP = "simulation_step"
ID = "transaction_id"
AMOUNT = "transaction_amount"
LAST_ROWS = 10
RANGES = {"transaction_count_24h": 24, "transaction_count_7d": 168}

# Stands for the account of rows without one while histories are built; no account
# number contains it.
NO_ACCOUNT = "\0none"
_TIE = "_tie"
_OUTSIDE = "_outside"
# The step of the next row, where blocks are put together.
NEXT_STEP = "_next_step"


def account_history(facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`facts` plus sequence, previous/next, last-ten, expanding and time-range features.

    Rows without an account share one history, as in a window over a NULL key. They take
    the place of an account of their own, so that many of them are split like any other.
    """
    named = facts.withColumn(ACCOUNT, F.coalesce(ACCOUNT, F.lit(NO_ACCOUNT)))
    hot = hot_keys(named, ACCOUNT, hot_rows)
    if hot is None:
        windowed = _whole_accounts(named)
    else:
        ordinary, crowded = split_hot(named, ACCOUNT, hot)
        windowed = _whole_accounts(ordinary.select(*facts.columns)).unionByName(
            _blocked_accounts(crowded, hot_rows).drop(NEXT_STEP)
        )
    return _derived(windowed).withColumn(
        ACCOUNT, F.nullif(F.col(ACCOUNT), F.lit(NO_ACCOUNT))
    )


def _last_rows(aggregate: Column, ordered: WindowSpec) -> Column:
    """An additive aggregate over the last ten rows, as the difference of two totals
    that start at the first row: both advance row by row, nothing is summed again."""
    start = Window.unboundedPreceding
    through_previous = aggregate.over(ordered.rowsBetween(start, -1))
    through_eleventh = aggregate.over(ordered.rowsBetween(start, -LAST_ROWS - 1))
    return F.coalesce(through_previous, F.lit(0)) - F.coalesce(through_eleventh, F.lit(0))


def _within_hours(hours: int, by_step: WindowSpec, rows: Column | None = None) -> Column:
    """Rows in the `hours` before the current one, as a difference of two counts; `rows`
    counts, if a row may stand for several."""
    start = Window.unboundedPreceding
    rows = F.count(F.lit(1)) if rows is None else rows
    return rows.over(by_step.rangeBetween(start, -1)) - rows.over(
        by_step.rangeBetween(start, -hours - 1)
    )


def _whole_accounts(facts: DataFrame) -> DataFrame:
    account = Window.partitionBy(ACCOUNT)
    ordered = account.orderBy(STEP, ID)
    last_rows = ordered.rowsBetween(-LAST_ROWS, -1)
    prior_rows = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # Row windows first: their (account, step, id) sort also serves the step ranges.
    by_rows = facts.select(
        "*",
        F.row_number().over(ordered).cast("bigint").alias("customer_transaction_number"),
        F.lag(AMOUNT).over(ordered).alias("previous_transaction_amount"),
        F.lag(STEP).over(ordered).alias("previous_transaction_step"),
        F.lead(AMOUNT).over(ordered).alias("next_transaction_amount"),
        _last_rows(F.sum(AMOUNT), ordered).alias("_last_total"),
        F.stddev_samp(F.col(AMOUNT).cast("double")).over(last_rows).alias(
            "std_last_10_transactions"
        ),
        _last_rows(F.count(AMOUNT), ordered).alias("_last_amounts"),
        F.count(AMOUNT).over(prior_rows).alias("_prior_amounts"),
        F.sum(AMOUNT).over(prior_rows).alias("cumulative_transaction_value"),
    )
    by_step = account.orderBy(STEP)
    return by_rows.select(
        "*",
        *[_within_hours(hours, by_step).alias(name) for name, hours in RANGES.items()],
    )


def _blocked_accounts(facts: DataFrame, hot_rows: int) -> DataFrame:
    # The tie number lets a large group of identical rows span several blocks. It is
    # given to rows read from files, so a repeated task numbers them the same way.
    numbered = freeze(facts, "crowded").withColumn(_TIE, F.monotonically_increasing_id())
    # Few enough rows for one task in each block, however few shuffle partitions are set.
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, -(-numbered.count() // hot_rows))
    laid = range_layout(numbered, ACCOUNT, STEP, ID, _TIE, blocks=blocks)
    return _windowed(laid, block_totals(laid))


def block_totals(laid: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per (account, block) what its rows need to know of the others: totals of all rows
    before it, `_near`, the last rows before it, and `_after`, the first row behind it.

    `state` is what is known of each account before its first block, see `carried`.
    """
    place = F.struct(STEP, ID, _TIE)
    block = Window.partitionBy(ACCOUNT, BLOCK)

    # One row per (account, block): size, sum, first row, and its last rows.
    sums = laid.groupBy(ACCOUNT, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(AMOUNT).alias("_total"),
        F.count(AMOUNT).alias("_amounts"),
        F.min_by(F.struct(AMOUNT, STEP), place).alias("_first"),
    )
    tail_rows = (
        laid.select(ACCOUNT, BLOCK, STEP, ID, _TIE, AMOUNT)
        .withColumn(
            "_from_end",
            F.row_number().over(block.orderBy(F.desc(STEP), F.desc(ID), F.desc(_TIE))),
        )
        .filter(F.col("_from_end") <= LAST_ROWS)
    )
    tails = tail_rows.groupBy(ACCOUNT, BLOCK).agg(
        F.sort_array(F.collect_list(F.struct(STEP, ID, _TIE, AMOUNT))).alias("_tail")
    )
    totals = sums.join(tails, [ACCOUNT, BLOCK])
    if state is None:
        rows, total, amounts = F.lit(0), F.lit(None).cast("decimal(28,2)"), F.lit(0)
        earlier = F.slice("_tail", 1, 0)
    else:
        totals = totals.join(state.drop("hours"), ACCOUNT, "left")
        rows, amounts = F.coalesce("rows", F.lit(0)), F.coalesce("amounts", F.lit(0))
        total, earlier = F.col("total"), F.coalesce("tail", F.slice("_tail", 1, 0))
    blocks = Window.partitionBy(ACCOUNT).orderBy(BLOCK)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    # A block of an account has at least one row, so ten blocks hold the last ten rows.
    near = blocks.rowsBetween(-LAST_ROWS, -1)
    return totals.select(
        ACCOUNT,
        BLOCK,
        (rows + F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("_rows_before"),
        _sum_or_null(total, F.sum("_total").over(before)).alias("_total_before"),
        (amounts + F.coalesce(F.sum("_amounts").over(before), F.lit(0))).alias("_amounts_before"),
        F.lead("_first").over(blocks).alias("_after"),
        "_tail",
        _last_of(F.concat(earlier, F.flatten(F.collect_list("_tail").over(near)))).alias("_near"),
    )


def _sum_or_null(left: Column, right: Column) -> Column:
    """The sum of two totals, null only if both are."""
    added = F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.when(left.isNotNull() | right.isNotNull(), added).cast("decimal(28,2)")


def _last_of(rows: Column) -> Column:
    """The last ten entries of an array."""
    return F.slice(rows, F.greatest(F.size(rows) - LAST_ROWS + 1, F.lit(1)), LAST_ROWS)


def _windowed(laid: DataFrame, carried: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """The features of rows laid out in blocks, from what is carried into each of them."""
    block = Window.partitionBy(ACCOUNT, BLOCK)
    # Rows just before each block take part in its windows and are dropped afterwards.
    outside = carried.select(
        ACCOUNT, BLOCK, F.explode("_near").alias("_row"), F.lit(True).alias(_OUTSIDE)
    ).select(ACCOUNT, BLOCK, "_row.*", _OUTSIDE)
    rows = laid.withColumn(_OUTSIDE, F.lit(False)).unionByName(
        outside, allowMissingColumns=True
    )
    summary = carried.select(
        ACCOUNT,
        BLOCK,
        "_rows_before",
        "_total_before",
        "_amounts_before",
        "_after",
        F.size("_near").alias("_extra"),
    )
    ordered = block.orderBy(STEP, ID, _TIE)
    last_rows = ordered.rowsBetween(-LAST_ROWS, -1)
    prior_rows = ordered.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.when(~F.col(_OUTSIDE), F.col(AMOUNT))
    inside_total = F.sum(inside).over(prior_rows)
    following = F.coalesce(F.lead(F.struct(AMOUNT, STEP)).over(ordered), F.col("_after"))
    windowed = (
        rows.join(summary, [ACCOUNT, BLOCK])
        .select(
            "*",
            (F.col("_rows_before") + F.row_number().over(ordered) - F.col("_extra")).alias(
                "customer_transaction_number"
            ),
            F.lag(AMOUNT).over(ordered).alias("previous_transaction_amount"),
            F.lag(STEP).over(ordered).alias("previous_transaction_step"),
            following[AMOUNT].alias("next_transaction_amount"),
            following[STEP].alias(NEXT_STEP),
            _last_rows(F.sum(AMOUNT), ordered).alias("_last_total"),
            F.stddev_samp(F.col(AMOUNT).cast("double"))
            .over(last_rows)
            .alias("std_last_10_transactions"),
            _last_rows(F.count(AMOUNT), ordered).alias("_last_amounts"),
            (F.col("_amounts_before") + F.count(inside).over(prior_rows)).alias(
                "_prior_amounts"
            ),
            _sum_or_null(F.col("_total_before"), inside_total).alias(
                "cumulative_transaction_value"
            ),
        )
        .filter(~F.col(_OUTSIDE))
    )
    counted = windowed.join(_step_ranges(laid, hours), [ACCOUNT, BLOCK, STEP])
    return counted.drop(
        BLOCK,
        _TIE,
        _OUTSIDE,
        "_rows_before",
        "_total_before",
        "_amounts_before",
        "_after",
        "_extra",
    )


def _step_ranges(laid: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Rows of the account in the hours before each step, per (account, block, step).

    The windows run over one row per account and hour, however many rows it has. `hours`
    has such rows, with their count `_n`, of before the first block.
    """
    per_block = laid.groupBy(ACCOUNT, BLOCK, STEP).agg(F.count(F.lit(1)).alias("_n"))
    per_step = per_block.groupBy(ACCOUNT, STEP).agg(F.sum("_n").alias("_n"))
    if hours is not None:
        per_step = per_step.unionByName(hours)
    by_step = Window.partitionBy(ACCOUNT).orderBy(STEP)
    ranges = per_step.select(
        ACCOUNT,
        STEP,
        *[
            F.coalesce(F.sum("_n").over(by_step.rangeBetween(-hours, -1)), F.lit(0)).alias(name)
            for name, hours in RANGES.items()
        ],
    )
    return per_block.drop("_n").join(ranges, [ACCOUNT, STEP])


def _derived(windowed: DataFrame) -> DataFrame:
    amount = F.col(AMOUNT).cast("double")
    earlier = F.col("customer_transaction_number") - 1
    hours = F.col(STEP) - F.col("previous_transaction_step")
    features = reduce(
        lambda df, step: df.withColumns(step),
        [
            {
                "hours_since_previous_transaction": hours,
                "days_since_previous_transaction": hours.cast("double") / 24,
                "historical_transaction_count": earlier,
                "transaction_count_last_10": F.least(earlier, F.lit(LAST_ROWS)),
            },
            {
                # Exact decimal totals divided once: no drift over long histories. A
                # missing amount counts as a transaction but not in an average.
                "avg_last_10_transactions": ratio(
                    F.col("_last_total"), F.col("_last_amounts")
                ),
                "customer_average_amount": ratio(
                    F.col("cumulative_transaction_value"), F.col("_prior_amounts")
                ),
            },
            {
                "amount_vs_customer_average": amount - F.col("customer_average_amount"),
                "amount_to_customer_average_ratio": ratio(
                    amount, F.col("customer_average_amount")
                ),
                "amount_zscore_last_10": F.when(
                    F.col("std_last_10_transactions") > 0,
                    (amount - F.col("avg_last_10_transactions"))
                    / F.col("std_last_10_transactions"),
                ),
            },
        ],
        windowed,
    )
    return features.drop("_last_total", "_last_amounts", "_prior_amounts")
