import hashlib
import itertools
import random
import re

import numpy as np

from ledgerwright.llm import pii


def luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_patterns_equal_the_plain_expressions():
    rnd = random.Random(7)
    alphabet = ["a", "b.", "@", "-", "c.d", "1", "22", "255", "256", ".", "+", " ", "(", ")", "é", "\n", "4", "٣"]
    for _ in range(20_000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))
        assert pii.base_spans(text) == brute(text), repr(text)
    assert pii.base_spans("card 4337166598464399 or 4337-1665-9846-4399.") == [(5, 2, 21), (25, 2, 44)]


def test_long_runs_are_read_once():
    for text in ("9" * 400_000, "a" * 400_000 + "@", "x" * 400_000, "@" * 100_000, "0" * 5000 + ".1.1.1"):
        base = pii.base_spans(text)
        pii.graph_of(text, base)


def exact(graph, field):
    """Marginals by summing over all labellings, hubs included."""
    n, k, hubs = len(graph.spans), len(pii.LABELS), len(graph.groups)
    p = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n + hubs):
        if any(e >= 0 and labels[i] != e for i, e in enumerate(graph.evidence)):
            continue
        score = sum(graph.features[i] @ field.shape[labels[i]] for i in range(n))
        score += sum(field.chain[labels[i], labels[j]] for i, j in graph.chain)
        score += sum(
            field.spoke * (labels[n + g] == labels[i])
            for g, members in enumerate(graph.groups)
            for i in members
        )
        for i in range(n):
            p[i, labels[i]] += np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def test_beliefs_are_exact_where_the_graph_has_no_loop():
    rnd = np.random.default_rng(3)
    k = len(pii.LABELS)
    field = pii.Field(rnd.normal(size=(k, pii.N_FEATURES)), rnd.normal(size=(k, k)), 1.3)
    text = "one +1 (456) x 456.555.2186 y"
    graph = pii.graph_of(text, pii.base_spans(text))
    graph.evidence[:] = -1
    graph.groups = [[0, 2]]
    assert len(graph.spans) == 3 and len(graph.chain) == 1
    assert np.abs(pii.beliefs(graph, field) - exact(graph, field)).max() < 5e-3


TRAIN = [
    "write to loogm.24@mail6.example.com or call +1 (456) 555-2186 now",
    "host 55.63.178.142 and card 4337166598464399 and version 2.0. or 3 or 17",
    "password=e3b3ed3cc8548923d6 and 12 and 100,000 and +44 (20) 7946-0958",
] * 30


def test_labels_reach_repetitions():
    field = pii.fit_field(TRAIN)
    text = "call +1 (212) 555-7788 or ab.12@x.example.org today; later 555-7788 or ab.12, not 555-0000"
    base = pii.base_spans(text)
    added = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, base, field)]
    assert added == [("phone", "555-7788"), ("email", "ab.12")]
    plain = "in 2019 there were 1,234,567 of 8 kinds, 1,234,567 in all; 3.14"
    assert pii.added_spans(plain, [], field) == []


def test_table(spark):
    texts = [None, "", "é a.b@c.de and a.b@c.de", "1.2.3.4 " * 3000, "no data", "+1 (212) 555-7788"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    field = pii.fitted(docs)
    got = pii.found(docs, field).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(texts[r["doc_id"]] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == n for b in base) for n in range(4)]
    assert pii.found(docs.limit(0), pii.fitted(docs.limit(0))).count() == 0
