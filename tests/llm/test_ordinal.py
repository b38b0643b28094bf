import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import ordinal as o
from ledgerwright.llm.queries import GRADE
from ledgerwright.llm.sketches import WordHashes


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randrange(30, 200))]
        grade = i % 3
        if grade == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "nasty", "foul"]))
        elif grade == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


def numbered(rows):
    hashes = WordHashes()
    return [o.features(t.encode(), hashes).astype(np.int64) for _, t, _ in rows]


def test_held_out_accuracy_and_ordered_thresholds():
    train, test = corpus(900, 1), corpus(300, 2)
    model = o.fit_rows(numbered(train), np.array([g for *_, g in train]), 3)
    assert (np.diff(model.thresholds) > 0).all()
    tails = np.array([model.tails(x) for x in numbered(test)])
    assert (tails[:, 0] >= tails[:, 1]).all()
    guess = (tails > 0.5).sum(axis=1)
    assert (guess == np.array([g for *_, g in test])).mean() > 0.95


def test_gradient_lowers_the_loss():
    train = corpus(300, 3)
    x, y = numbered(train), np.array([g for *_, g in train])

    def loss(model):
        out = 0.0
        for row, grade in zip(x, y, strict=True):
            tails = np.r_[1.0, model.tails(row), 0.0]
            out -= np.log(max(tails[grade] - tails[grade + 1], 1e-12))
        return out / len(y)

    fitted = o.fit_rows(x, y, 3)
    flat = o.Model(np.zeros_like(fitted.weights), np.array([-0.7, 0.7]))
    assert loss(fitted) < 0.2 * loss(flat)


def test_held_out_accuracy_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.xxhash64("doc_id") % 4 == 0
    model = o.fitted(docs, labels.filter(~held), F.expr(GRADE), 3, size=2500)
    tested = labels.filter(held).select("doc_id", F.expr(GRADE).alias("grade"))
    rows = o.graded(docs.join(tested.select("doc_id"), "doc_id"), model).join(tested, "doc_id").collect()
    good = [r for r in rows if r["grade"] == 2]
    toxic = [r for r in rows if r["grade"] == 0]
    assert len(rows) > 500
    assert np.mean([r["tails"][1] >= 0.5 for r in good]) > 0.97
    # A sample of 2,500 labels; the production sample of 12,000 finds 0.91 of the toxic.
    assert np.mean([r["tails"][0] < 0.5 for r in toxic]) > 0.7
    assert np.mean([r["tails"][1] < 0.5 for r in toxic]) > 0.8
    assert np.mean([sum(t > 0.5 for t in r["tails"]) == r["grade"] for r in rows]) > 0.93


def test_defined_cases(spark):
    rows = corpus(60, 4)
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t, _ in rows] + [(100, None, "x"), (101, "", "x"), (0, rows[0][1], "x"), (102, "x" * 200_000, None)],
        "doc_id long, text string, grade string",
    )
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(1, None), (None, 1), (999, 2)], "doc_id long, g int")
    model = o.fitted(docs, labels, F.col("g"), 3)
    got = o.graded(docs, model).collect()
    assert len(got) == 64
    assert all(0 <= r["expected_grade"] <= 2 and len(r["tails"]) == 2 for r in got)
    kept = o.selected(docs, model, 2, 0.5)
    assert kept.schema == docs.schema
    want = sorted(r["doc_id"] for r in got if r["tails"][1] >= 0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert o.graded(docs.limit(0), model).count() == 0


def test_without_two_grades_no_word_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(20, 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 2) for i in range(7)], "doc_id long, g int")
    for chosen, known, tails in (
        (docs, labels, [9 / 10, 8 / 10]),
        (docs, labels.limit(0), [2 / 3, 1 / 3]),
        (docs.limit(0), labels, [2 / 3, 1 / 3]),
    ):
        model = o.fitted(chosen, known, F.col("g"), 3)
        for r in o.graded(docs, model).collect():
            assert r["tails"] == pytest.approx(tails) and r["expected_grade"] == pytest.approx(sum(tails))


def test_one_id_on_many_rows_is_one_sampled_row(spark):
    rows = corpus(60, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, g int")
    least = min((t for _, t, _ in rows[:2]), key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest())
    again = docs.unionByName(docs.filter("doc_id = 0").withColumn("text", F.lit(rows[1][1])))
    once = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.lit(least)).otherwise(F.col("text")))
    models = [o.fitted(d, labels, F.col("g"), 3) for d in (again, once)]
    assert (models[0].weights == models[1].weights).all()


def test_the_query_follows_from_the_weights(spark):
    """Every probability again, from a word-by-word sum."""
    import math

    from ledgerwright.llm.queries import GRADE as QUERY_GRADE
    from ledgerwright.llm.queries import QUERIES
    from ledgerwright.llm.sketches import WordHashes

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = o.fitted(docs, labels, F.expr(QUERY_GRADE), 3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = QUERIES["op9_graded_quality"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        score = math.fsum(model.weights[i] for i in o.features((texts[r["doc_id"]] or "").encode(), WordHashes()))
        better = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert (r["p_not_toxic"], r["p_good"]) == pytest.approx(better, rel=1e-9)
        assert r["expected_grade"] == pytest.approx(sum(better), rel=1e-9)
        assert r["kept"] == (better[1] >= 0.5)
