"""Evaluation metrics against direct evaluation, with ties and degenerate classes."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwright.plans import metrics


def brute_force(rows):
    positives = sum(label for label, _ in rows)
    points, previous_hits = [], 0
    average = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        chosen = [label for label, s in rows if s >= t]
        hits = sum(chosen)
        precision = hits / len(chosen)
        if positives:
            average += (hits - previous_hits) / positives * precision
        previous_hits = hits
        f1 = 2 * hits / (len(chosen) + positives) if len(chosen) + positives else 0.0
        points.append((t, f1))
    top = max(f for _, f in points)
    threshold = min(t for t, f in points if f == top)
    ups = [s for label, s in rows if label]
    downs = [s for label, s in rows if not label]
    auc = None
    if ups and downs:
        won = sum((u > d) + 0.5 * (u == d) for u in ups for d in downs)
        auc = won / (len(ups) * len(downs))
    return threshold, top, average, auc


@pytest.fixture(scope="module")
def scored(spark):
    seed = random.Random(11)
    rows = [
        (group, int(seed.random() < 0.2 + 0.3 * score), round(score, 1))
        for group in ("A", "B")
        for score in (seed.random() for _ in range(250))
    ]
    rows += [("NONE", 0, s / 10) for s in range(6)] + [("ALL", 1, s / 10) for s in range(6)]
    return spark.createDataFrame(rows, "g string, label int, score double").repartition(6)


def test_all_metrics_match(scored, many_blocks):
    by = ["g"]
    best = {r.g: r for r in metrics.best_f1_threshold(scored, by).collect()}
    areas = {r.g: r for r in metrics.curve_areas(metrics.pr_curve(scored, by), by).collect()}
    groups = {}
    for r in scored.collect():
        groups.setdefault(r.g, []).append((r.label, r.score))
    for g, rows in groups.items():
        threshold, f1, average, auc = brute_force(rows)
        assert best[g].threshold == threshold
        assert best[g].f1 == pytest.approx(f1)
        assert areas[g].average_precision == pytest.approx(average)
        assert areas[g].roc_auc == (None if auc is None else pytest.approx(auc))


def test_undefined_rates_are_zero(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    row = metrics.confusion_at_threshold(rows, 0.9).first()
    assert (row.true_positive, row.generated_alerts, row.true_negative) == (0, 0, 2)
    assert row.precision_percent == row.recall_percent == row.f1_percent == 0.0


def test_confusion_counts(scored):
    row = metrics.confusion_at_threshold(scored.filter("g = 'A'"), 0.5).first()
    rows = scored.filter("g = 'A'").collect()
    assert row.true_positive == sum(r.label == 1 and r.score >= 0.5 for r in rows)
    assert row.false_negative == sum(r.label == 1 and r.score < 0.5 for r in rows)


def test_flattened_names(scored):
    wide = scored.groupBy("g").agg(F.max("score").alias("top"))
    names = {r.name for r in metrics.flatten_metrics(wide, "g").collect()}
    assert names == {"a_top", "b_top", "none_top", "all_top"}
