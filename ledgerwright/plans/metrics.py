"""Evaluation of scored rows, tie-aware and without collecting or globally sorting them.

A scored set has `label` (0/1) and `score`; `by` groups (a split, a model) are
evaluated side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import confusion_flags
from ledgerwright.operators.ordered import running_totals


def _or_zero(numerator: Column, denominator: Column) -> Column:
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(quotient, F.lit(0.0))


def pr_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall of alerting at or above each distinct score.

    Keeps the integer counts the other metrics are derived from.
    """
    counts = running_totals(
        scored,
        ["score"],
        {"positives": F.sum(F.col("label").cast("bigint")), "rows": F.count(F.lit(1))},
        by=by,
        descending=True,
    )
    hits = F.col("positives_before") + F.col("positives")
    alerts = F.col("rows_before") + F.col("rows")
    return counts.select(
        *by,
        F.col("score").alias("threshold"),
        hits.alias("true_positive"),
        alerts.alias("generated_alerts"),
        _or_zero(hits, alerts).alias("precision"),
        # Without positives every threshold finds all of them.
        F.coalesce(
            F.try_divide(hits.cast("double"), F.col("positives_all").cast("double")),
            F.lit(1.0),
        ).alias("recall"),
        "positives",
        "rows",
        "positives_all",
        "rows_all",
    )


def best_f1_threshold(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct score with the highest F1; the lowest one among ties.

    F1 is compared as `2 tp / (alerts + positives)`, a quotient of integers.
    """
    f1 = _or_zero(
        2 * F.col("true_positive"), F.col("generated_alerts") + F.col("positives_all")
    )
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("negated")))
    return (
        pr_curve(scored, by)
        .withColumn("f1", f1)
        .groupBy(*by)
        .agg(best.alias("best"))
        .select(*by, (-F.col("best.negated")).alias("threshold"), F.col("best.f1").alias("f1"))
    )


def curve_areas(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision and ROC AUC of every group of a precision-recall curve.

    Average precision adds, over distinct scores, the recall gained there times the
    precision there. The AUC is the share of (positive, negative) pairs in the right
    order, ties counted half; NULL when a group has one class only.
    """
    gained = _or_zero(F.col("positives"), F.col("positives_all"))
    tied = F.col("rows") - F.col("positives")
    negatives = F.col("rows_all") - F.col("positives_all")
    below = negatives - (F.col("generated_alerts") - F.col("true_positive"))
    # Twice the number of ordered pairs, as an exact integer.
    doubled = F.col("positives").cast("decimal(18,0)") * (2 * below + tied).cast("decimal(19,0)")
    pairs = F.max(F.col("positives_all").cast("double") * negatives.cast("double"))
    return curve.groupBy(*by).agg(
        F.sum(gained * F.col("precision")).alias("average_precision"),
        F.try_divide(F.sum(doubled).cast("double"), 2.0 * pairs).alias("roc_auc"),
    )


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision of every group."""
    return curve_areas(pr_curve(scored, by), by).select(*by, "average_precision")


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of every group."""
    return curve_areas(pr_curve(scored, by), by).select(*by, "roc_auc")


def confusion_at_threshold(
    scored: DataFrame, threshold: Column | float, by: Sequence[str] = ()
) -> DataFrame:
    """Counts and percentages of alerting at `threshold`, 0 where a rate is undefined."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    alert = F.col("score") >= F.col("threshold")
    flags = confusion_flags(alert, F.col("label") == 1)
    counted = (
        scored.withColumn("threshold", limit)
        .groupBy(*by)
        .agg(F.max("threshold").alias("threshold"), *[c.alias(n) for n, c in flags.items()])
    )
    tp, fp, fn, tn = (F.col(n) for n in flags)
    return counted.withColumns(
        {
            "generated_alerts": tp + fp,
            "alert_rate_percent": 100 * _or_zero(tp + fp, tp + fp + fn + tn),
            "precision_percent": 100 * _or_zero(tp, tp + fp),
            "recall_percent": 100 * _or_zero(tp, tp + fn),
            "f1_percent": 100 * _or_zero(2 * tp, 2 * tp + fp + fn),
        }
    )


def evaluate(scored: DataFrame, threshold: Column | float, by: Sequence[str]) -> DataFrame:
    """All metrics of every group in one row each."""
    areas = curve_areas(pr_curve(scored, by), by)
    return confusion_at_threshold(scored, threshold, by).join(areas, list(by))


def flatten_metrics(metrics: DataFrame, split: str = "dataset_split") -> DataFrame:
    """(name, value) rows, the name being `<split>_<metric>` in lower case."""
    values = [c for c in metrics.columns if c != split]
    return (
        metrics.select(split, *[F.col(v).cast("double").alias(v) for v in values])
        .unpivot([split], values, "metric", "value")
        .select(F.concat_ws("_", F.lower(split), F.col("metric")).alias("name"), "value")
    )
