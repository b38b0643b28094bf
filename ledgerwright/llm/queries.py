"""The registered queries of this subpackage: `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.llm import (
    alignment,
    bpe,
    collocations,
    inner_products,
    line_dedup,
    mixing,
    near_duplicates,
    ordinal,
    pii,
    quality_rules,
    sharding,
    token_files,
    url_filters,
)
from ledgerwright.llm.pieces import ByteLevel, SentencePieces
from ledgerwright.llm.shipping import ship
from ledgerwright.llm.texts import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RANKS = "byte_bpe_50k.tiktoken"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
# Ends every document in the token files.
END_ID = 2


def query(function: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_quality_rules(spark, sf_dir):
    """The ledger of all documents with the verdict of the current policy."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.POLICIES["v1"]
    return rows.select(
        "*",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        quality_rules.passes().alias("kept"),
    )


@query
def quality_ablations(spark, sf_dir):
    """Per policy and rule, what the rule alone costs."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


@query
def op2_byte_bpe(spark, sf_dir):
    """Digests of every document's ids and of their decoding."""
    return bpe.digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
    )


# The mix of the corpus: domains by number of source, then language, then source.
MIX_LEVELS = {
    "domain": (
        "case when try_cast(substr(source, 4) as int) < 10 then 'web' "
        "when try_cast(substr(source, 4) as int) < 15 then 'books' else 'forum' end"
    ),
    "language": "lang",
    "origin": "source",
}
MIX = {
    "levels": MIX_LEVELS,
    "weights": {
        "domain": {"web": 5, "books": 3, "forum": 2},
        "language": {"en": 6, "de": 2, "fr": 2, "es": 1},
    },
    "percent": 80,
    "epochs": 2,
    "seed": 20,
}


@query
def op3_source_mix(spark, sf_dir):
    """Every document's leaf, tokens and copies in the mix."""
    rows, cuts = mixing.plan_mix(table(spark, sf_dir, "documents"), **MIX)
    return mixing.chosen(rows, cuts, list(MIX_LEVELS), MIX["seed"])


@query
def op4_kd_shards(spark, sf_dir):
    """All documents in 24 shards of near equal bytes, by length, language and source."""
    docs = table(spark, sf_dir, "documents")
    dims = {
        "chars": F.char_length("text"),
        "lang": sharding.text_code(F.col("lang")),
        "source": sharding.text_code(F.col("source")),
    }
    return sharding.kd_shards(docs, dims, shards=24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_top_products(spark, sf_dir):
    """The five best inner products of every fiftieth vector against all others."""
    return inner_products.top_products(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0
    )


@query
def op10_url_verdicts(spark, sf_dir):
    """Every page's rule and verdict, aliases included."""
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.page_links(pages))


@query
def op5_near_duplicates(spark, sf_dir):
    """Every document with the class of near duplicates that it belongs to."""
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark, sf_dir):
    """Every document's text without lines that stand elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.cleaned(docs, counts=True)


# Grades of the labels: toxic 0, poor 1, good 2.
GRADE = "case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end"
KEEP_FROM = 0.5


@query
def op9_graded_quality(spark, sf_dir):
    """Every document's expected grade, its tail probabilities, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fitted(docs, table(spark, sf_dir, "labels"), F.expr(GRADE), 3)
    rows = ordinal.graded(docs, model)
    return rows.select(
        "doc_id",
        "expected_grade",
        F.get("tails", F.lit(0)).alias("p_not_toxic"),
        F.get("tails", F.lit(1)).alias("p_good"),
        (F.get("tails", F.lit(1)) >= KEEP_FROM).alias("kept"),
    )


@query
def op6_personal_data(spark, sf_dir):
    """Every document's personal data: pattern counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return pii.found(docs, pii.fitted(docs))


@query
def op11_token_files(spark, sf_dir):
    """Every document's place and checksum, read back from the files of token ids."""
    docs = table(spark, sf_dir, "documents")
    files = token_files.write(docs, ByteLevel.read(public_tokenizers.path(BYTE_LEVEL)), END_ID)
    return token_files.read(files, "ids_crc32", pa.int64(), token_files.checksum)


@query
def op12_collocations(spark, sf_dir):
    """The best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_alignment(spark, sf_dir):
    """Every document's groups and links between the tokens of two tokenizers."""
    return alignment.aligned(
        table(spark, sf_dir, "documents"),
        ByteLevel.read(public_tokenizers.path(BYTE_LEVEL), plain=True),
        SentencePieces.read(public_tokenizers.path(PIECES)),
        digest=True,
    )
