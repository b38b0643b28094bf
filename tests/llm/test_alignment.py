import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerwright.llm import alignment, pieces
from ledgerwright.llm.pieces import ByteLevel, SentencePieces
from ledgerwright.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(ByteLevel.read(BYTES, plain=True), SentencePieces.read(PIECES)).ready()


class Reference:
    """Both libraries on whole texts, and a plain walk over their tokens."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def encode(self, text):
        return self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)

    def spelled(self, pair, text):
        ids_a, ids_b = self.encode(text)
        return [
            [table[i] for i in ids]
            for ids, table in ((ids_a, pair.bytes_a), (ids_b, pair.bytes_b))
        ]


@pytest.fixture(scope="module")
def reference():
    return Reference()


def spans(ids, lengths):
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends], ends, ids, strict=False))


def walked(pair, reference, texts):
    """What `aligned` should give for each text."""
    docs, holding = [], Counter()
    for text in texts:
        ids_a, ids_b = reference.encode(text) if text else ([], [])
        spelled = [b"".join(x) for x in reference.spelled(pair, text)] if text else []
        if not text or any(x != f" {text}".encode() for x in spelled):
            docs.append((0, 0, 0, [], ""))
            continue
        a = spans(ids_a, pair.length_a[ids_a])
        b = spans(ids_b, pair.length_b[ids_b])
        linked = [(x[2], y[2]) for x, y in overlapping(a, b)]
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups = []
        for start, stop in zip([0, *cuts], cuts, strict=False):
            inside = [[str(x[2]) for x in side if start < x[1] <= stop] for side in (a, b)]
            groups.append("|".join(",".join(side) for side in inside))
        docs.append((len(a), len(b), len(groups), linked, ";".join(groups)))
        holding.update(set(linked))
    most = defaultdict(int)
    for (first, _), n in holding.items():
        most[first] = max(most[first], n)
    return [
        (*d[:3], len(d[3]), sum(holding[x] == most[x[0]] for x in d[3]), sum(holding[x] for x in d[3]), d[4])
        for d in docs
    ]


def overlapping(a, b):
    i = j = 0
    while i < len(a) and j < len(b):
        yield a[i], b[j]
        step = a[i][1] - b[j][1]
        i, j = i + (step <= 0), j + (step >= 0)


def texts_of(n, seed=2):
    rnd = random.Random(seed)
    alphabet = "ab 'st  \n\t\x1c\x85　éß٣Ⅷ²漢🙂̈.,!_$0ſZ"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]
    special = ["<|endoftext|>", "<s> </s> <unk> <0x41>", "holds ▁ a mark", "x ", " x", "  ", " ", "\n", "ﬁ Á"]
    return [*made, *special, "hello world " * 40, "hello world " * 40]


def test_pieces_give_the_ids_of_whole_texts(pair, reference, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_PIECES", 300)
    texts = [t for t in texts_of(3000) if t]
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        for text, made in zip(part, pair.encoded(part), strict=True):
            want = reference.encode(text)
            if made is None:
                assert any(b"".join(x) != f" {text}".encode() for x in reference.spelled(pair, text))
            else:
                assert [x.tolist() for x in made] == list(want), repr(text)


def test_cuts_are_all_common_ends():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        ends, texts, at = ([], []), ([0], [0]), 0
        for _ in range(rnd.integers(1, 5)):
            length = int(rnd.integers(1, 60))
            for side in (0, 1):
                share = rnd.choice([0.02, 0.3, 1.0])
                inner = np.flatnonzero(rnd.random(length - 1) < share) + 1
                ends[side].extend((at + np.append(inner, length)).tolist())
                texts[side].append(len(ends[side]))
            at += length
        a, b = np.array(ends[0]), np.array(ends[1])
        groups_a, groups_b = alignment.shared_groups(a, b, np.array(texts[0]), np.array(texts[1]))
        common = np.intersect1d(a, b)
        assert groups_a.tolist() == [0, *(np.searchsorted(a, common) + 1)[:-1]]
        assert groups_b.tolist() == [0, *(np.searchsorted(b, common) + 1)[:-1]]


@pytest.mark.parametrize("block", [50, 500_000])
def test_equals_a_plain_walk(spark, pair, reference, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", block)
    texts = [*texts_of(150), None, "", "many many"]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(3)
    out = alignment.aligned(docs, pair.a, pair.b)
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    want = walked(pair, reference, texts)
    for i, text in enumerate(texts):
        assert got[i] == want[i], repr(text)


def test_null_and_repeated_ids_are_rows(spark, pair):
    rows = [(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = alignment.aligned(docs, pair.a, pair.b).collect()
    counts = Counter((r["doc_id"], r["n_a"]) for r in out)
    assert counts == {(None, 2): 2, (1, 1): 2, (1, 0): 1}
    assert alignment.aligned(docs.limit(0), pair.a, pair.b).count() == 0
    assert alignment.aligned(docs.filter("text is null"), pair.a, pair.b).first()["n_links"] == 0


def test_the_query_equals_a_plain_walk(spark, pair, reference):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_alignment"](spark, DATA).collect()}
    want = walked(pair, reference, [t for _, t in docs])
    assert len(got) == len(docs)
    for (doc_id, _), row in zip(docs, want, strict=True):
        digest = hashlib.sha256(row[6].encode()).hexdigest() if row[6] else ""
        assert tuple(got[doc_id])[1:] == (*row[:6], digest)


@pytest.mark.parametrize("most", [5, 40_000, 1 << 20])
def test_order_by_two_ids(most):
    rng = np.random.default_rng(most)
    first, second = rng.integers(0, most, (2, 3000)).astype(np.uint32)
    expected = np.lexsort([np.arange(3000), second, first])
    assert alignment.sorted_by(first, second).tolist() == expected.tolist()
    assert alignment.sorted_by(first[:0], second[:0]).tolist() == []
