import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerwright.llm import pieces, token_files
from ledgerwright.llm.pieces import ByteLevel
from ledgerwright.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_PIECES", 500)
    rnd = random.Random(11)
    alphabet = "ab 'st  \n\t\x1c\x85　éß٣Ⅷ²漢🙂̈.,!_$0ſZ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["a <|endoftext|> b<|endoftext|>", "<|endoftext|>", " x", "x ", "  ", ""]
    codec = ByteLevel.read(PATH)
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        for text, ids in zip(part, codec.ids(part), strict=True):
            assert ids.tolist() == want(library, text), repr(text)


def test_coding_round_trips():
    rnd = np.random.default_rng(3)
    for counts in ([], [0], [1], [0, 5, 0, 3, 4, 1], rnd.integers(0, 20, 500).tolist()):
        counts = np.array(counts, np.int64)
        n = int(counts.sum())
        ranks = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        control, data, n_control, n_data = token_files.coded(ranks, counts)
        assert n_control.sum() == len(control) and n_data.sum() == len(data)
        assert (token_files.decoded(control, data, counts) == ranks).all()
    sizes = [token_files.coded(np.array([x], np.uint32), np.array([1]))[1].size for x in (255, 256, 65536, 1 << 24)]
    assert sizes == [1, 2, 3, 4]


def in_order(rows):
    return sorted(rows, key=lambda r: r["start"])


def test_files_hold_all_documents_in_order(spark, library, monkeypatch, many_blocks):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(token_files, "FILE_BYTES", 200)
    texts = ["hello world", None, "", "  two\n\n", "<|endoftext|>", "é" * 400, "hello world", "w " * 300]
    rows = [(i % 7 - 3, t, "x") for i, t in enumerate(texts * 4)]
    rows += [(None, "no id", "x"), (None, "no id", "y"), (None, "another", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    files = token_files.write(docs, ByteLevel.read(PATH), 2)
    assert files.manifest.count() > 3
    got = in_order(token_files.read(files).collect())
    assert len(got) == len(rows)
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start = 0
    for row in got:
        assert row["start"] == start and row["n_tokens"] == len(row["ids"]) and row["ids"][-1] == 2
        start += row["n_tokens"]
    made = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"][:-1]) for r in got)
    assert made == sorted((k is None, k or 0, want(library, t)) for k, t, _ in rows)


def test_frequent_ids_are_short(spark, tmp_path):
    docs = spark.createDataFrame([(1, " the" * 5000)], "doc_id long, text string")
    files = token_files.write(docs, ByteLevel.read(PATH), 2, f"file://{tmp_path}/out")
    (path,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".lwt"]
    assert path.stat().st_size < 5000 * 1.3 + 100
    order = np.fromfile(tmp_path / "out" / "ranks.u32", "<u4")
    assert order[:2].tolist() == [262, 2] and sorted(order) == list(range(files.size))


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write(docs, ByteLevel.read(PATH), 2)
    assert token_files.read(files).count() == 0


def test_the_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_token_files"](spark, DATA).collect()}
    assert len(got) == len(docs)
    start = 0
    for doc_id, text in sorted(docs):
        ids = np.array([*want(library, text), 2], "<u4")
        row = got[doc_id]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_what_is_read_can_be_anything(spark):
    docs = spark.createDataFrame([(5, "a b c")], "doc_id long, text string")
    files = token_files.write(docs, ByteLevel.read(PATH), 2)
    rows = token_files.read(files, "greatest", pa.int64(), lambda ids: int(ids.max()), key="k").collect()
    assert [r.asDict() for r in rows] == [{"k": 5, "start": 0, "n_tokens": 4, "greatest": 275}]
