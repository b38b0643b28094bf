import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import mixing

LEVELS = {"domain": "d", "language": "l", "source": "s"}
WEIGHTS = {"domain": {"a": 3}, "language": {"en": 4}, "source": {"s1": 2}}


def fill(given, children):
    """Budgets of (name, capacity, weight) by water-filling with exact fractions."""
    out, left, rest = {}, given, list(children)
    while rest:
        total = sum(w for _, _, w in rest)
        full = [c for c in rest if c[1] * total <= c[2] * left]
        first = min(rest, key=lambda c: (Fraction(c[1], c[2]), c[0] is not None, c[0]))
        if not full:
            out |= {n: w * left // total for n, _, w in rest}
            break
        out[first[0]] = first[1]
        left -= first[1]
        rest.remove(first)
    return out


def brute(rows, percent, epochs, seed):
    tokens = {i: len((t or "").split()) for i, _, _, _, t in rows}
    leaf = {i: (d, lang, s) for i, d, lang, s, _ in rows}
    size = lambda p: sum(n for i, n in tokens.items() if leaf[i][: len(p)] == p)
    budgets = {(): min(size(()) * percent // 100, size(()) * epochs)}
    for depth, level in enumerate(LEVELS):
        for path in [p for p in budgets if len(p) == depth]:
            names = {q[depth] for q in leaf.values() if q[:depth] == path}
            children = [
                (n, size((*path, n)) * epochs, WEIGHTS[level].get(n, 1)) for n in names
            ]
            budgets |= {(*path, n): b for n, b in fill(budgets[path], children).items()}
    out = {}
    for path in set(leaf.values()):
        total, budget = size(path), budgets[path]
        full, rest = (budget // total, budget % total) if total else (0, 0)
        members = sorted(
            (hashlib.md5(f"{seed}|{full}|{i}".encode()).hexdigest(), i)
            for i in leaf
            if leaf[i] == path
        )
        spent = 0
        last = None
        for key, i in members:
            spent += tokens[i]
            if rest and spent <= rest:
                last = key
        for key, i in members:
            out[i] = full + (last is not None and key <= last)
    return out, budgets


def corpus(n=120):
    rows = []
    for i in range(n):
        d = "a" if i % 5 else None
        lang = "en" if i % 3 else "de"
        text = None if i % 17 == 0 else "" if i % 19 == 0 else "w " * (i % 13 + 1)
        rows.append((i, d, lang, f"s{i % 4}" if i % 7 else "s0", text))
    return rows


def planned(spark, rows, percent, epochs):
    docs = spark.createDataFrame(rows, "doc_id long, d string, l string, s string, text string")
    docs = docs.withColumn("budget", F.lit("mine")).withColumn("tokens", F.lit("mine"))
    table, cuts = mixing.plan_mix(docs, LEVELS, WEIGHTS, percent, epochs, 7)
    return docs, mixing.chosen(table, cuts, list(LEVELS), 7)


def test_equal_to_brute_force(spark):
    rows = corpus()
    for percent, epochs in ((30, 1), (100, 3), (250, 2), (80, 2), (0, 1)):
        want, budgets = brute(rows, percent, epochs, 7)
        docs, got = planned(spark, rows, percent, epochs)
        found = got.collect()
        assert {r["doc_id"]: r["copies"] for r in found} == want, (percent, epochs)
        for r in found:
            assert r["budget"] == budgets[r["domain"], r["language"], r["source"]]


def test_mixed_repeats_rows_and_keeps_columns(spark):
    rows = corpus()
    want, _ = brute(rows, 120, 3, 7)
    docs, _ = planned(spark, rows, 120, 3)
    out = mixing.mixed(docs, LEVELS, WEIGHTS, 120, 3, 7)
    assert out.schema == docs.schema
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in want.items() if n}


def test_empty_and_repeated(spark):
    docs, got = planned(spark, [], 50, 1)
    assert got.count() == 0
    assert mixing.mixed(docs, LEVELS, WEIGHTS, 50, 1, 7).count() == 0
    rows = [(1, "a", "en", "s1", "x y")] * 3 + [(2, "a", "en", "s1", None)]
    _, got = planned(spark, rows, 100, 1)
    assert [r["copies"] for r in got.collect() if r["doc_id"] == 1] == [1, 1, 1]


def test_a_weight_of_zero_leaves_a_source_out(spark, monkeypatch):
    rows = [(i, "a", "en" if i % 2 else "de", f"s{i % 4}", "w w w") for i in range(40)]
    monkeypatch.setitem(WEIGHTS, "language", {"en": 4, "de": 0})
    docs, got = planned(spark, rows, 80, 3)
    found = {r["doc_id"]: r["copies"] for r in got.collect()}
    # Half of the tokens may be used, and take the budget of 96 up to whole documents.
    assert all(found[i] == 0 for i in range(0, 40, 2))
    assert 90 <= sum(found.values()) * 3 <= 96
    monkeypatch.setitem(WEIGHTS, "domain", {"a": 0})
    _, got = planned(spark, rows, 80, 3)
    assert {r["copies"] for r in got.collect()} == {0}


def test_negative_weights_are_refused(spark, monkeypatch):
    monkeypatch.setitem(WEIGHTS, "source", {"s1": -1})
    with pytest.raises(ValueError, match="-|s1"):
        planned(spark, [(1, "a", "en", "s1", "w")], 50, 1)


def test_rows_without_an_id_spread_over_the_epoch(spark):
    rows = [(None, "a", "en", "s1", f"text number {i}") for i in range(60)]
    rows += [(i, "a", "en", "s1", f"text number {100 + i}") for i in range(120)]
    docs, got = planned(spark, rows, 50, 1)
    taken = sum(r["copies"] for r in got.collect())
    # Within one document of half of all tokens.
    assert 89 <= taken <= 90
    out = mixing.mixed(docs, LEVELS, WEIGHTS, 50, 1, 7)
    assert out.count() == taken and out.distinct().count() == taken
