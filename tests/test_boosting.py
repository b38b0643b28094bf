"""Boosted trees against a plain version that shares nothing but the sampling."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwright.plans import boosting, metrics

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(8)
    n = 1200
    values = [rnd.normal(size=n), rnd.integers(0, 3, n) * 1.0, np.round(rnd.random(n), 1), rnd.integers(0, 2, n) * 1.0]
    odds = 2 * values[0] - values[1] + (values[0] > 0.5) * 3 * values[3] - 1
    label = (rnd.random(n) < 1 / (1 + np.exp(-odds))) * 1.0
    data = [
        (f"{i:08d}", float(label[i]), *[float(v[i]) for v in values]) for i in range(n)
    ]
    schema = "transaction_id string, label double, " + ", ".join(f"{c} double" for c in NAMES)
    return spark.createDataFrame(data, schema).withColumn("_key", F.xxhash64("transaction_id")).cache()


def plain(given, cuts, settings, bins):
    """Trees as nested tuples, every node summed from its own rows."""
    table = np.array([[r[c] for c in NAMES] for r in given])
    label = np.array([r["label"] for r in given])
    keys = np.array([r["_key"] for r in given], np.int64).view(np.uint64)
    binned = np.stack([(table[:, i : i + 1] >= np.array(c)[None, :]).sum(axis=1) for i, c in enumerate(cuts)], axis=1)
    margin = np.zeros(len(given))

    def shrink(x):
        return math.copysign(max(abs(x) - settings.l1, 0.0), x)

    def weight(g, h):
        return -settings.rate * shrink(g) / (h + settings.l2)

    def node(at, depth, g, h, columns):
        if depth == settings.depth:
            return weight(g[at].sum(), h[at].sum())
        total = shrink(g[at].sum()) ** 2 / (h[at].sum() + settings.l2)
        best = (1e-6, None, None)
        for column in columns:
            for cut in range(bins - 1):
                left, right = at[binned[at, column] <= cut], at[binned[at, column] > cut]
                if min(h[left].sum(), h[right].sum()) < settings.least_weight:
                    continue
                parts = sum(shrink(g[s].sum()) ** 2 / (h[s].sum() + settings.l2) for s in (left, right))
                if (parts - total) / 2 > best[0]:
                    best = ((parts - total) / 2, column, cut)
        gain, column, cut = best
        if column is None:
            return weight(g[at].sum(), h[at].sum())
        sides = [at[binned[at, column] <= cut], at[binned[at, column] > cut]]
        return (column, cut, *[node(s, depth + 1, g, h, columns) for s in sides])

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if binned[row, tree[0]] > tree[1] else tree[2]
        return tree

    trees = []
    for number in range(settings.rounds):
        p = 1 / (1 + np.exp(-margin))
        scale = np.where(label > 0, settings.scale, 1.0)
        g = np.round((p - label) * scale * 2**28) / 2**28
        h = np.round(p * (1 - p) * scale * 2**28) / 2**28
        at = np.flatnonzero(boosting.sampled(keys, number, settings))
        tree = node(at, 0, g, h, boosting.columns_of(number, len(NAMES), settings))
        trees.append(tree)
        margin = margin + np.array([value(tree, i) for i in range(len(given))])
    return trees, margin


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return tree.value[at]
    return (int(tree.feature[at]), int(tree.cut[at]), nested(tree, 2 * at + 1), nested(tree, 2 * at + 2))


def close(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if isinstance(a, tuple):
        return a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3])
    return a == pytest.approx(b, abs=1e-12)


SETTINGS = boosting.Settings(rounds=5, rate=0.3, depth=3, scale=1.5, least_weight=2.0)


@pytest.mark.parametrize("tasks, job_rounds", [(1, 5), (3, 2)])
def test_equals_a_plain_version(rows, tasks, job_rounds):
    made = boosting.fit(rows, None, NAMES, SETTINGS, 75, job_rounds=job_rounds, bins=16, tasks=tasks)
    given = rows.collect()
    trees, margin = plain(given, made.cuts, SETTINGS, 16)
    assert len(made.trees) == 5
    for mine, other in zip(made.trees, trees, strict=True):
        assert close(nested(mine), other)
    scored = {r["transaction_id"]: r["score"] for r in made.scored(rows, ["transaction_id"]).collect()}
    for row, m in zip(given, margin, strict=True):
        assert scored[row["transaction_id"]] == pytest.approx(1 / (1 + math.exp(-m)))


def test_bins_hold_equal_shares_and_equal_values_together(rows):
    cuts = boosting.borders(rows, NAMES, 8)
    values = np.sort([r["a"] for r in rows.collect()])
    assert [len(c) for c in cuts] == [7, 2, 7, 1]
    sizes = np.diff(np.searchsorted(values, [-np.inf, *cuts[0], np.inf]))
    assert sizes.min() >= 1200 // 8 - 1 and sizes.max() <= 1200 // 8 + 1
    assert cuts[1].tolist() == [1.0, 2.0] and cuts[3].tolist() == [1.0]


def test_validation_ends_the_fit_and_names_the_best_round(rows):
    split = F.pmod(F.xxhash64(F.lit(3), "transaction_id"), F.lit(3)) == 0
    settings = boosting.Settings(rounds=60, rate=0.5, depth=4, least_weight=1.0)
    made = boosting.fit(rows.filter(~split), rows.filter(split), NAMES, settings, patience=6, job_rounds=10)
    tried = made.precisions
    assert made.best_round == tried.index(max(tried)) + 1 < 60
    assert len(tried) - made.best_round == 6
    scored = made.scored(rows.filter(split), ["label"])
    again = metrics.average_precision(scored).first()["average_precision"]
    assert again == pytest.approx(made.best_score)
    assert made.importances().sum() == pytest.approx(1) and made.importances().argmax() == 0


def test_more_rows_than_the_bound_are_sampled(rows):
    few, n = boosting._bounded(rows, 300)
    assert n == 300 and 230 < few.count() < 370
    assert boosting._bounded(rows, 5000)[0] is rows


def test_patience_does_not_depend_on_the_rounds_of_a_job():
    scores = [0.1, 0.5, 0.4, 0.4, 0.4, 0.9]
    assert boosting._watched(scores, 3) == scores[:5]
    assert boosting._watched(scores, 4) == scores


def test_precisions_from_counts_equal_those_of_all_rows(spark, rows, monkeypatch):
    settings = boosting.Settings(rounds=7, rate=0.5, depth=3, least_weight=1.0)
    # Few features in few bins: many rows share a margin.
    names, sent = NAMES[1:], []
    monkeypatch.setattr(boosting, "_precisions", lambda *given: sent.append(given) or [0.0] * given[2])
    counted = boosting.fit(rows, rows.repartition(5), names, settings, 75, job_rounds=4).precisions
    assert not sent
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "POSITIVES_SENT", 0)
    every = boosting.fit(rows, rows.repartition(5), names, settings, 75, job_rounds=4).precisions
    assert counted == pytest.approx(every, abs=1e-12) and len(counted) == 7


def test_validation_without_positives_or_rows_has_precision_zero(rows):
    settings = boosting.Settings(rounds=2, depth=2)
    for held_out in (rows.filter("label = 0"), rows.filter("false")):
        assert boosting.fit(rows, held_out, NAMES, settings, 75).precisions == (0.0, 0.0)


def test_leaves_of_trees_that_end_early():
    tree = boosting.Tree(
        np.array([1, -1, 0, -1, -1, -1, -1]), np.array([3, 0, 5, 0, 0, 0, 0]), np.arange(7.0), np.zeros(7)
    )
    bins = np.array([[9, 3], [5, 4], [6, 4], [255, 255]], np.uint8)
    assert tree.leaf(bins).tolist() == [1, 5, 6, 6]
    assert tree.leaf(bins[:, ::-1][:, ::-1]).tolist() == [1, 5, 6, 6]
    assert tree.leaf(bins[:0]).tolist() == []


def test_leaves_by_bits_are_those_of_a_walk():
    rnd = np.random.default_rng(4)
    for depth, sizes in ((1, [3]), (3, [2, 2, 5, 1, 256]), (6, [2, 2, 2, 24, 7, 256, 241, 11, 11]), (7, [9, 40])):
        packing = boosting.Packing.of(sizes)
        assert sorted(i for g in packing.groups for i in g) == list(range(len(sizes)))
        assert all(packing.width(g) <= boosting.BINS for g in range(len(packing.groups)))
        bins = np.stack([rnd.integers(0, s, 700) for s in sizes], axis=1).astype(np.uint8)
        codes = np.zeros((len(packing.groups), 700), np.uint8)
        for i, (group, stride) in enumerate(packing.places):
            codes[group] += (bins[:, i].astype(int) * stride).astype(np.uint8)
        assert (packing.unpacked(codes) == bins).all()
        trees = []
        for _ in range(12):
            n = 2 ** (depth + 1) - 1
            feature = np.where(rnd.random(n) < 0.8, rnd.integers(0, len(sizes), n), -1)
            feature[n // 2 :] = -1
            for i in range(1, n):
                if feature[(i - 1) // 2] < 0:
                    feature[i] = -1
            cut = np.array([rnd.integers(0, max(1, sizes[f] - 1)) for f in feature])
            trees.append(boosting.Tree(feature, cut, rnd.normal(size=n), np.zeros(n)))
        margin = np.zeros(700)
        boosting.add_margins([boosting.Scorer.of(t, packing) for t in trees], codes, margin)
        expected = np.zeros(700)
        for t in trees:
            expected += t.margin(bins)
        assert (margin == expected).all()


def test_counts_between_known_values():
    rnd = np.random.default_rng(5)
    values = np.round(rnd.normal(size=500), 1)
    for n in (0, 1, 20, 900):
        known = np.unique(np.round(rnd.normal(size=n), 1 if n < 900 else 3))
        borders = [-math.inf, *known, math.inf]
        expected = [int(((values >= a) & (values < b)).sum()) for a, b in zip(borders, borders[1:])]
        assert boosting.counts_between(known, values).tolist() == expected
        assert boosting.counts_between(known, values[:0]).tolist() == [0] * (len(known) + 1)


def test_tasks_do_not_wait_a_second_for_every_sum(rows):
    settings = boosting.Settings(rounds=15, rate=0.3, depth=3, least_weight=2.0)
    alone = boosting.fit(rows, None, NAMES, settings, 75, bins=16, tasks=1)
    began = time.monotonic()
    shared = boosting.fit(rows, None, NAMES, settings, 75, bins=16, tasks=3)
    # Three sums a tree.
    assert time.monotonic() - began < 35
    assert [t.packed() for t in shared.trees] == [t.packed() for t in alone.trees]


def test_tasks_without_a_folder_exchange_through_spark(rows, monkeypatch):
    settings = boosting.Settings(rounds=1, rate=0.3, depth=2)
    alone = boosting.fit(rows, None, NAMES, settings, 75, bins=16, tasks=1)
    monkeypatch.setattr(boosting, "_exchange_folder", lambda spark: None)
    shared = boosting.fit(rows, None, NAMES, settings, 75, bins=16, tasks=2)
    assert shared.trees[0].packed() == alone.trees[0].packed()


def test_rows_beyond_those_held_in_memory_count_as_well(rows):
    settings = boosting.Settings(rounds=4, rate=0.3, depth=3, least_weight=2.0)
    every = boosting.fit(rows, None, NAMES, settings, 75, bins=16, job_rounds=2, tasks=2)
    mapped = boosting.fit(rows, None, NAMES, settings, 75, labelled_rows=300, bins=16, job_rounds=2, tasks=2)
    assert [c.tolist() for c in mapped.cuts] == [c.tolist() for c in every.cuts]
    assert [t.packed() for t in mapped.trees] == [t.packed() for t in every.trees]
    # The root of the first tree sums the Hessians of all rows that it sees, a quarter each.
    given = rows.select("_key", "label").collect()
    keys = np.array([r["_key"] for r in given], np.int64).view(np.uint64)
    at = boosting.sampled(keys, 0, settings)
    seen = int(at.sum())
    assert seen > 900
    label = np.array([r["label"] for r in given])
    total = np.where(label[at] > 0, -0.5, 0.5).sum()
    value = -settings.rate * math.copysign(abs(total) - settings.l1, total) / (seen / 4 + settings.l2)
    assert mapped.trees[0].value[0] == pytest.approx(value)


def test_sums_beyond_53_bits_are_exact():
    packing = boosting.Packing.of([2, 3])
    big = (1 << 60) + 1
    sums = np.full((2, 1, packing.width(0)), big // 8, np.int64)
    sums[:, :, 0] += 1
    bins = packing.sums_of_bins([sums], np.array([0, 1]))
    assert bins[0, 0, 0] == 3 * (big // 8) + 1 and bins[0, 0, 2] == 2 * (big // 8) + 1
    running = boosting._running(bins, np.array([0, 2]))
    assert running[0, 0, 1] == running[0, 0, 4] == 6 * (big // 8) + 1
