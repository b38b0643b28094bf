"""Global ordering without a single-partition sort.

The rows are laid out once in contiguous key ranges and that layout is frozen.
Whatever a range needs to know about the ones before it is then a small table with
one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwright.session import freeze

BLOCK = "_block"
_PLACE, _RUN = "_place", "_run"
# Bins of an interval in which a quantile is sought.
QUANTILE_BINS = 4096
# Values that are counted one by one instead of in bins.
FEW_VALUES = 200_000
# Intervals that are sent to every task; more are joined.
BROADCAST_INTERVALS = 10_000


def range_layout(df: DataFrame, *order: Column | str, blocks: int | None = None) -> DataFrame:
    """`df` plus `_block`: blocks are numbered by `order` and do not overlap.

    Range bounds come from sampling, so the layout is written once and re-read:
    everything downstream sees the same blocks. The number of blocks is `blocks`, or
    follows `spark.sql.shuffle.partitions`.
    """
    ranged = df.repartitionByRange(*([] if blocks is None else [blocks]), *order)
    return freeze(ranged.withColumn(BLOCK, F.spark_partition_id()), "layout")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """One row per distinct key with its measures, as `<measure>_before` the totals over
    all strictly earlier keys of the same `by` group, as `<measure>_all` the group's.

    Equal keys are collapsed before anything is ordered, so a heavily repeated key
    costs one row; `measures` must be additive aggregates.
    """
    names = list(measures)
    grain = df.groupBy(*by, *keys).agg(*[measures[n].alias(n) for n in names])
    order = [
        F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_last() for k in keys
    ]
    laid = range_layout(grain, *[F.col(b) for b in by], *order)

    block_totals = laid.groupBy(*by, BLOCK).agg(*[F.sum(n).alias(n) for n in names])
    earlier_blocks = (
        Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    group = Window.partitionBy(*by)
    carried = block_totals.select(
        *by,
        BLOCK,
        *[F.sum(n).over(group).alias(f"{n}_all") for n in names],
        *[
            F.coalesce(F.sum(n).over(earlier_blocks), F.lit(0)).alias(f"_carried_{n}")
            for n in names
        ],
    )
    earlier_keys = (
        Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return laid.join(carried, [*by, BLOCK]).select(
        *by,
        *keys,
        *names,
        *[
            (
                F.col(f"_carried_{n}")
                + F.coalesce(F.sum(n).over(earlier_keys), F.lit(0))
            ).alias(f"{n}_before")
            for n in names
        ],
        *[f"{n}_all" for n in names],
    )


def global_rank(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """SQL `rank()` over all rows, every key descending: ties share a rank, gaps follow.

    The rows are shuffled once, into ranges of the keys; a place of their own keeps many
    equal rows from being one range. Each range numbers its rows and knows where each run
    of equal keys starts. A table with one row per range has the rows before it, and where
    a run that begins in an earlier range starts there.
    """
    # Stored first, as ranges are chosen from a sample: both reads must agree.
    rows = freeze(df, "ranked").withColumn(_PLACE, F.monotonically_increasing_id())
    order = [F.col(k).desc_nulls_last() for k in keys]
    ranged = rows.repartitionByRange(*order, F.col(_PLACE)).sortWithinPartitions(*order)
    laid = freeze(_runs(ranged.drop(_PLACE).withColumn(BLOCK, F.spark_partition_id()), keys), "ranges")
    key = F.struct(*keys)
    blocks = laid.groupBy(BLOCK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(key, _RUN).alias("_first"),
        F.max_by(key, _RUN).alias("_last"),
        F.max(_RUN).alias("_last_run"),
    )
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    placed = freeze(
        blocks.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "range-starts"
    )
    # A run that crosses a border is the last of one range and the first of the next.
    starts = (
        placed.select(F.col("_first").alias("_key"), F.col("_start").alias("_at"))
        .unionByName(
            placed.select(F.col("_last").alias("_key"), (F.col("_start") + F.col("_last_run")).alias("_at"))
        )
        .groupBy("_key")
        .agg(F.min("_at").alias("_run_start"))
    )
    carried = placed.join(starts, F.col("_first").eqNullSafe(F.col("_key"))).select(
        BLOCK, "_start", "_run_start"
    )
    before = F.when(F.col(_RUN) == 0, F.col("_run_start")).otherwise(F.col("_start") + F.col(_RUN))
    # One row per range: as many as the shuffle has partitions.
    return laid.join(F.broadcast(carried), BLOCK).select(
        *df.columns, (before + 1).cast("bigint").alias(name)
    )


def _runs(ordered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`ordered` plus `_run`: where in its partition the run of equal keys starts."""
    names = ordered.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, start, last = 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            changed = np.zeros(n, bool)
            for i in at:
                column = batch.column(i)
                joined = column if last is None else pa.concat_arrays([last.column(i), column])
                changed[n - len(joined) + 1 :] |= _differ(joined)
            first = np.where(changed, np.arange(seen, seen + n), 0)
            first[0] = max(first[0], start)
            runs = np.maximum.accumulate(first)
            seen, start, last = seen + n, runs[-1], batch.slice(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs)], names=[*names, _RUN])

    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField(_RUN, T.LongType())]))


def _differ(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before, nulls and NaN alike."""
    left, right = column.slice(0, len(column) - 1), column.slice(1)
    equal = pc.fill_null(pc.equal(left, right), False)
    equal = pc.or_(equal, pc.and_(left.is_null(), right.is_null()))
    if pa.types.is_floating(column.type):
        both = pc.and_(pc.is_nan(left), pc.is_nan(right))
        equal = pc.or_(equal, pc.fill_null(both, False))
    return ~equal.to_numpy(zero_copy_only=False).astype(bool)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per column (and per `by` group), NULLs ignored.

    `weight` names an integer column that says how many times a row counts. Output: `by` +
    `feature` + one double per entry of `probabilities`.

    Found by narrowing: the values of an interval are counted into bins, and the bin that
    holds the position asked for, shrunk to its least and greatest value, is the interval
    of the next pass, until it is one value. Only bins are shuffled, after map-side sums;
    values are neither sorted nor laid out, but for the last `FEW_VALUES` of them. `df` is
    read once for each pass.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    group = F.struct(*by, F.col("_cell.feature").alias("feature"))
    cells = (
        df.select(
            *by,
            times.cast("bigint").alias("_times"),
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                        for c in columns
                    ]
                )
            ).alias("_cell"),
        )
        .select(group.alias("_group"), "_times", F.col("_cell.value").alias("_value"))
        .filter("_value is not null")
    )
    wholes = freeze(cells.groupBy("_group").agg(F.sum("_times").alias("_inside"), *_bounds()), "values")
    asked = {
        f"{side}_{label}": rounded((F.col("_inside") - 1) * F.lit(float(p))).cast("bigint")
        for label, p in probabilities.items()
        for side, rounded in (("lo", F.floor), ("hi", F.ceil))
    }
    targets = freeze(
        wholes.filter("_inside > 0")
        .withColumn("_position", F.explode(F.array_distinct(F.array(*asked.values()))))
        .withColumn("_before", F.lit(0).cast("bigint")),
        "targets",
    )
    passes = 0
    while True:
        wide = targets.filter(~F.col("_low").eqNullSafe(F.col("_high")))
        intervals = freeze(
            wide.select("_group", "_low", "_high", "_least", "_greatest", "_before", "_inside").distinct(), "intervals"
        )
        n, values = intervals.agg(F.count(F.lit(1)), F.sum("_inside")).first()
        if not n:
            break
        # Few enough to be sent to every task, or left to a join.
        held = F.broadcast(intervals) if n <= BROADCAST_INTERVALS else intervals
        met = cells.join(held, "_group").filter(F.col("_value").between(F.col("_low"), F.col("_high")))
        bin_number = F.col("_value") if values <= FEW_VALUES else _bin(logarithmic=passes == 0)
        counted = met.groupBy("_group", "_low", "_before", bin_number.alias("_bin")).agg(
            F.sum("_times").alias("_n"), *[b.alias(f"{name}_") for name, b in zip(_NAMES, _bounds(), strict=True)]
        )
        earlier = Window.partitionBy("_group", "_low").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.select(
            "_group",
            "_low",
            *[f"{name}_" for name in _NAMES],
            F.col("_n"),
            (F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_at"),
        )
        inside = (F.col("_position") >= F.col("_at")) & (F.col("_position") < F.col("_at") + F.col("_n"))
        narrowed = (
            wide.select("_group", "_low", "_position")
            .join(placed, ["_group", "_low"])
            .filter(inside)
            .select(
                "_group",
                "_position",
                F.col("_at").alias("_before"),
                F.col("_n").alias("_inside"),
                *[F.col(f"{name}_").alias(name) for name in _NAMES],
            )
        )
        done = targets.filter(F.col("_low").eqNullSafe(F.col("_high"))).select(*narrowed.columns)
        targets = freeze(done.unionByName(narrowed), "targets")
        passes += 1

    found = targets.groupBy("_group").agg(
        F.map_from_entries(F.collect_list(F.struct("_position", "_low"))).alias("_at")
    )
    picked = wholes.select("_group", "_inside").join(found, "_group", "left")

    def blend(label: str, p: float) -> Column:
        target = (F.col("_inside") - 1) * F.lit(float(p))
        low, high = (F.try_element_at("_at", asked[f"{side}_{label}"]) for side in ("lo", "hi"))
        # Between two infinite values there is nothing to blend.
        between = low + (high - low) * (target - F.floor(target))
        return F.when(low == high, low).otherwise(between).alias(label)

    return picked.select("_group.*", *[blend(label, p) for label, p in probabilities.items()])


_NAMES = ("_low", "_high", "_least", "_greatest")


def _bounds() -> list[Column]:
    """The least and greatest value, of all and of the finite ones."""
    value = F.col("_value")
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    made = [F.min(value), F.max(value), F.min(finite), F.max(finite)]
    return [m.alias(name) for m, name in zip(made, _NAMES, strict=True)]


def _bin(logarithmic: bool) -> Column:
    """A bin number that never falls as the value rises; infinite values and NaN, which
    is the greatest, have bins of their own, and so have the least and greatest value."""
    value, least, greatest = F.col("_value"), F.col("_least"), F.col("_greatest")

    def scaled(x: Column) -> Column:
        return F.signum(x) * F.log1p(F.abs(x)) if logarithmic else x / 2

    share = (scaled(value) - scaled(least)) / (scaled(greatest) - scaled(least))
    inner = F.least(F.greatest(F.floor(share * F.lit(QUANTILE_BINS)), F.lit(0)), F.lit(QUANTILE_BINS))
    return (
        F.when(F.isnan(value), QUANTILE_BINS + 3)
        .when(value == float("inf"), QUANTILE_BINS + 2)
        .when(value == float("-inf"), -2)
        .when(value == least, -1)
        .when(value == greatest, QUANTILE_BINS + 1)
        .otherwise(F.coalesce(inner, F.lit(0)))
        .cast("double")
    )
