import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerwright.llm import near_duplicates as nd
from ledgerwright.llm.texts import BATCH_BYTES, small_batches


def grams(text):
    words = (text or "").split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def edited(rnd, base, edits):
    out = list(base)
    for _ in range(edits):
        at = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[at] = f"new{rnd.randrange(10**6)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"new{rnd.randrange(10**6)}")
    return out


def brute(rows, least=0.8):
    """Classes by all pairs with a multiset Jaccard index of five-word shingles; for texts
    that are edited but not rearranged it equals the ordered index."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [grams(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][1] is not None and rows[a][1] == rows[b][1]
            common = sum((sets[a] & sets[b]).values())
            total = sum(sets[a].values()) + sum(sets[b].values()) - common
            if same or (total and common / total >= least):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    heads = {}
    for a in range(len(rows)):
        heads[find(a)] = min(heads.get(find(a), rows[a][0]), rows[a][0])
    return {rows[a][0]: heads[find(a)] for a in range(len(rows))}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    passage = words(rnd, 60)
    out = []
    for i in range(40):
        base = words(rnd, rnd.choice([30, 120, 400]))
        if i % 3 == 0:
            base = base[:50] + passage + base[50:]
        out.append(base)
        for _ in range(rnd.randrange(4)):
            out.append(edited(rnd, base, rnd.choice([0, 1, 2, 4, 9])))
    hot = words(rnd, 80)
    out += [edited(rnd, hot, 1) for _ in range(120)] + [hot] * 60
    texts = [" ".join(x) for x in out] + [None, None, "", "", " ", "a b", "a b", "a b c"]
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n_words long")
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(docs).collect()}
    assert got == brute(rows)


def test_one_document_of_each_class_stays(spark, rows):
    doubled = rows + rows[:5]
    docs = spark.createDataFrame([(*r, "x", 1) for r in doubled], "doc_id long, text string, _key string, class_id long")
    out = nd.deduplicated(docs)
    assert out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(brute(rows).values()))
    assert nd.deduplicated(docs.limit(0)).count() == 0


def test_moved_blocks_are_not_duplicates():
    rnd = random.Random(3)
    hashes = nd.WordHashes()
    text = [w.encode() for w in words(rnd, 300)]
    moved = text[150:] + text[:150]
    a, b = nd.shingles(text, hashes), nd.shingles(moved, hashes)
    assert nd.similarity(a, a) == 1
    assert nd.similarity(a, b) < 0.8
    assert (nd.sketch(a) == nd.sketch(b)).mean() < (nd.sketch(a) == nd.sketch(a)).mean()


def test_alignment_equals_the_unbanded_chain():
    rnd = random.Random(4)
    for _ in range(60):
        base = words(rnd, 60)
        a, b = edited(rnd, base, rnd.randrange(4)), edited(rnd, base, rnd.randrange(4))
        want = grams(" ".join(a)) & grams(" ".join(b))
        x, y = grams(" ".join(a)), grams(" ".join(b))
        common = sum(want.values())
        jaccard = common / (sum(x.values()) + sum(y.values()) - common)
        hashes = nd.WordHashes()
        got = nd.similarity(
            nd.shingles([w.encode() for w in a], hashes), nd.shingles([w.encode() for w in b], hashes)
        )
        assert (got >= 0.8) == (jaccard >= 0.8)
        if jaccard >= 0.8:
            assert abs(got - jaccard) < 1e-12


def test_repeated_shingles_are_labelled():
    hashes = nd.WordHashes()
    labelled = nd.shingles([b"a"] * 100, hashes)
    assert len(np.unique(labelled)) == 96


def test_twins_inside_a_templated_family(spark):
    """Documents of one template are too far from each other and from any pivot, but each
    has a twin."""
    rnd = random.Random(8)
    template = words(rnd, 200)
    out = []
    for _ in range(150):
        own = list(template)
        own[:30] = words(rnd, 30)
        twin = list(own)
        twin[100:108] = words(rnd, 8)
        out += [own, twin]
    family = list(enumerate(" ".join(x) for x in out))
    want = brute(family)
    assert len(set(want.values())) == 150
    docs = spark.createDataFrame(family, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in nd.classes(docs).collect()} == want


def test_pairs_of_texts_go_to_python_in_small_batches(spark):
    texts = spark.range(0, 300, numPartitions=1).selectExpr("id as node", "cast(repeat('word ', 20000) as binary) as body")
    pairs = spark.range(1, 300, numPartitions=1).selectExpr("id as node", "0L as pivot")
    members = pairs.join(texts.withColumnRenamed("body", "_a"), "node")
    both = members.join(texts.selectExpr("node as pivot", "body as _b"), "pivot").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with small_batches(spark):
        held = [r.n for r in both.mapInArrow(sizes, "n long").collect()]
    # A batch ends with the row that reaches the bound.
    assert sum(held) > 50 << 20 and max(held) <= BATCH_BYTES + (1 << 20)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES)
