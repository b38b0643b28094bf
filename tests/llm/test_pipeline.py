"""The stages against brute-force versions, and every query against its SQL."""

import os

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_bpe import PATH
from test_line_dedup import brute as brute_lines
from test_near_duplicates import brute as brute_classes
from test_quality_rules import brute as brute_measures

import corpus_pipeline
from ledgerwright.llm import mixing, quality_rules
from ledgerwright.llm.bpe import Codec
from ledgerwright.llm.oracles import ORACLES
from ledgerwright.llm.queries import MIX, MIX_LEVELS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in stages] == [
        "documents", "quality_rules", "line_dedup", "near_duplicates", "source_mix", "byte_bpe"
    ]
    for _, df in stages[1:-1]:
        assert df.dtypes == stages[0][1].dtypes


def test_quality_stage(stages):
    before, after = stages[0][1].collect(), rows_of(stages[1][1])

    def fails(m):
        n, chars, symbols, dup, repeat, lines, longest = m
        return (
            n < 10 or 100 * repeat > 20 * n or 100 * symbols > 30 * n or 100 * dup > 50 * lines
            or chars < 2 * n or chars > 20 * n or longest > 2000
        )

    assert set(after) == {r["doc_id"] for r in before if not fails(brute_measures(r["text"]))}
    assert quality_rules.POLICY == "v3"


def test_line_stage(stages):
    before, after = stages[1][1].collect(), rows_of(stages[2][1])
    want = brute_lines(sorted((r["doc_id"], r["text"]) for r in before))
    assert {i: r["text"] for i, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_near_duplicate_stage(stages):
    before, after = stages[2][1].collect(), rows_of(stages[3][1])
    want = brute_classes(sorted((r["doc_id"], r["text"]) for r in before))
    assert set(after) == set(want.values())


def test_mixing_stage(stages, spark):
    docs = stages[3][1]
    table, cuts = mixing.plan_mix(docs, **MIX)
    want = {
        r["doc_id"]: r["copies"]
        for r in mixing.chosen(table, cuts, list(MIX_LEVELS), MIX["seed"]).collect()
    }
    got = {r["doc_id"]: r["count"] for r in stages[4][1].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_encoding_stage(stages):
    codec = Codec.read(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    texts = rows_of(stages[4][1])
    for r in stages[5][1].collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]["text"])
        assert r["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    expected = sorted(map(repr, want.select(*columns).fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == expected


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11))
