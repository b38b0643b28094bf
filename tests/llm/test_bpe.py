import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerwright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.read(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )


def test_the_hash_is_perfect_and_minimal(codec):
    keys = list(codec.ranks)
    assert sorted(codec.hash.slot(k) for k in keys) == list(range(len(keys)))
    assert [codec.hash.slot(k) for k in keys] == codec.hash.slots
    assert bpe.PerfectHash([]).size == 1
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_random_texts_equal_the_library(codec, reference):
    rnd = random.Random(5)
    alphabet = "ab 'st  \n\t\x1c\x85　éß٣Ⅷ²漢🙂̈.,!_$0ſZ"
    encode = codec.encoder()
    for _ in range(5000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
        want = reference.encode_ordinary(text)
        got = encode(text)
        assert got == " ".join(map(str, want)), repr(text)
        assert codec.decode(got) == text.encode()


def test_merging_alone_equals_the_library(codec, reference):
    rnd = random.Random(6)
    for _ in range(2000):
        word = "".join(rnd.choice("aeinorst") for _ in range(rnd.randrange(1, 30)))
        assert bpe.merge(word.encode(), codec.ranks) == reference.encode_ordinary(word)


def test_a_long_pre_token(codec, reference):
    text = "ab" * 60_000
    assert codec.encoder()(text) == " ".join(map(str, reference.encode_ordinary(text)))


def test_the_memo_can_overflow(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    fresh = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    text = " ".join(f"w{i} x{i % 5}" for i in range(200))
    assert fresh.encoder()(text) == " ".join(map(str, reference.encode_ordinary(text)))


def test_tables(spark, reference):
    texts = ["hello world", None, "", "  two\n\n", "<|endoftext|>", "é" * 1000, "hello world"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' as ids", "1 as n_tokens"
    )
    out = bpe.encoded(docs, PATH, public_tokenizers.PATTERN)
    rows = {r["doc_id"]: r for r in out.collect()}
    digests = {
        r["doc_id"]: r for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    }
    for i, text in enumerate(texts):
        want = reference.encode_ordinary(text or "")
        assert rows[i]["ids"] == want and rows[i]["n_tokens"] == len(want)
        joined = " ".join(map(str, want)).encode()
        assert digests[i]["ids_sha256"] == hashlib.sha256(joined).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert digests[i]["n_tokens"] == len(want)
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decoded(out, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encoded(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
