import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {
        i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(5)
    }
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        len(lines),
        max((len(w.encode()) for w in words), default=0),
    )


def random_texts(n, seed=0):
    rnd = random.Random(seed)
    parts = ["a", "b", "é漢", "x#", "$$", " ", " ", "\n", "\t", "\x0b", "\x1c", "　", "a b a b c\n"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(120))) for _ in range(n)]


def test_measures_equal_brute_force():
    for text in ["", " \n", *random_texts(300)]:
        assert q.measure(text.encode()) == brute(text), text


@pytest.fixture(scope="module")
def docs(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, good, "x"),
        (2, None, "x"),
        (3, "", None),
        (4, "only three words", "x"),
        (5, "one two three four five " * 20, "x"),
        (6, " ".join(f"w{i}$$$" for i in range(60)), "x"),
        (7, good, "x"),
        (7, good, "x"),
        (8, "w " * 9 + "x" * 300_000, "x"),
    ]
    # columns that clash with the operator's own names
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_defined_cases(docs):
    rows = q.ledger(docs).withColumn("kept", q.passes()).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert len(rows) == 9
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True, 8: False}
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3)} == {0}


def test_accepted_keeps_columns_and_rows(docs):
    out = q.accepted(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 7, 7]
    assert q.accepted(docs.limit(0)).count() == 0


def test_ablations_equal_recounting(docs):
    ledger = q.ledger(docs)
    bits = [r["fail_bits"] for r in ledger.collect()]
    got = {(r["policy"], r["rule"]): r for r in q.ablations(ledger).collect()}
    for policy, mask in q.POLICIES.items():
        for rule, bit in q.BIT.items():
            if not bit & mask:
                assert (policy, rule) not in got
                continue
            r = got[policy, rule]
            assert r["n_failed"] == sum(bool(b & bit) for b in bits)
            assert r["n_only"] == sum(b & mask == bit for b in bits)
            assert r["n_kept"] == sum(b & mask == 0 for b in bits)


def test_ledger_needs_no_shuffle(docs):
    plan = q.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert q.ledger(docs.withColumn("text", F.lit(None).cast("string"))).count() == 9
