"""Phrase collocations by relational mining of occurrences (SETM).

The occurrence relation of length k holds every occurrence of a frequent phrase of k
words: where it stands, and which phrase. It is persisted sorted by piece and position,
as blocks of columns. Its merge-join with itself at the adjacent position gives the
occurrences of k + 1 words; they are counted by group, groups below the threshold go, and
the semi-join with the frequent groups gives the relation that the next length starts
from. A phrase is named by its first k and its last k words, both frequent themselves, so
the join needs no words, and the counts of all beginnings and endings travel along.

A block holds whole documents of one language, so occurrences never have to meet across
blocks. What is shuffled are the distinct groups of a block with their counts, never
occurrences: a word or phrase that stands everywhere is one row per block, and its sums
are partial aggregates. The frequent groups go back to the blocks whole while there are
few of them, and by a join beyond.

The score of a phrase compares its count a with the counts l and r of its two parts at a
cut, floor(1000 * a * n / (l * r)) with n the words of the language; the lowest-scoring
cut counts. A phrase inside a longer frequent phrase of the same count is dropped. Since
counts do not grow with length, it is enough to look at phrases of one more word.

Defined cases: a null or empty text has no words; a null language is `und`. Words and
texts may be of any length; repeated rows count again. An empty table, or one without a
frequent phrase, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwright.llm.pieces import text_slices
from ledgerwright.session import freeze, release

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
NO_LANGUAGE = "und"
# Words of a block, or of a single document; bounds the memory of a task.
BLOCK_WORDS = 1 << 20
# Frequent groups that are sent to every task, some 50 MB; more are joined.
FREQUENT_SENT = 500_000
# Line breaks of all kinds and these marks end a piece.
_PIECE_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_OCCURRENCES = "places binary, codes binary"
_EXACT = "decimal(38,0)"
_LOWER = (1 << 32) - 1
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class _Words:
    """The words of one language in the documents of a block."""

    def __init__(self):
        self.codes = _Codes()
        self.seen: list[int] = []
        self.ends: list[int] = []

    def add(self, text: str) -> None:
        of, seen = self.codes.__getitem__, self.seen
        for piece in text.encode().lower().translate(_PIECE_ENDS).split(b"\n"):
            # Of white space, pieces hold spaces and tabs alone.
            words = piece.split()
            if words:
                seen.extend(map(of, words))
                self.ends.append(len(seen))


def _packed(places: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Places as differences, which are small and mostly one."""
    return np.diff(places, prepend=0).astype("<u4").tobytes(), codes.astype("<u4").tobytes()


def _unpacked(places: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(places, "<u4"), dtype=np.int64), np.frombuffer(codes, "<u4")


def word_blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The occurrences of single words: `lang, n_words, places, codes, words, counts`.

    A place is the number of a word in its block, with one number left out between pieces,
    so that two words are neighbours in a piece if their places are. The code of a word is
    its place in `words`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Words] = {}

        def blocks() -> Iterator[pa.RecordBatch]:
            for language, words in held.items():
                codes = np.array(words.seen, np.int64)
                gaps = np.zeros(len(codes) + 1, np.int64)
                gaps[words.ends] = 1
                places, packed = _packed(np.arange(len(codes)) + np.cumsum(gaps[:-1]), codes)
                columns = [language, len(codes), places, packed, list(words.codes), np.bincount(codes)]
                types = [f.type for f in schema]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(columns, types, strict=True)], schema=schema
                )
            held.clear()

        schema = pa.schema(
            [
                ("lang", pa.string()),
                ("n_words", pa.int64()),
                ("places", pa.binary()),
                ("codes", pa.binary()),
                ("words", pa.list_(pa.string())),
                ("counts", pa.list_(pa.int64())),
            ]
        )
        n = 0
        for batch in batches:
            languages = batch.column(0).to_pylist()
            for first, texts in text_slices(batch.column(1)):
                for language, text in zip(languages[first:], texts, strict=False):
                    if not text:
                        continue
                    words = held.setdefault(language, _Words())
                    n -= len(words.seen)
                    words.add(text)
                    n += len(words.seen)
                    if not words.seen:
                        del held[language]
                    if n >= BLOCK_WORDS:
                        yield from blocks()
                        n = 0
        yield from blocks()

    given = docs.select(
        F.coalesce(docs[lang].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), docs[text].alias("text")
    )
    rows = given.mapInArrow(
        run, f"lang string, n_words long, {_OCCURRENCES}, words array<string>, counts array<long>"
    )
    return rows.withColumn("block", F.monotonically_increasing_id())


class _WordIds:
    """The ids of frequent words, by language."""

    def __init__(self, keys: pa.Table):
        self.of: dict[str, dict[str, int]] = {}
        for lang, word, number in zip(*(keys[c].to_pylist() for c in ("lang", "words", "id")), strict=True):
            self.of.setdefault(lang, {})[word] = number

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        known = self.of.get(row["lang"], {})
        found = np.array([known.get(w, -1) for w in row["words"]], np.int64)
        code = np.flatnonzero(found >= 0)
        return code, found[code]


class _PhraseIds:
    """The ids of frequent phrases, by those of their first and their last words."""

    def __init__(self, keys: pa.Table):
        left, right, ids = (keys[c].to_numpy() for c in ("left", "right", "id"))
        self.left, at_left = np.unique(left, return_inverse=True)
        self.right, at_right = np.unique(right, return_inverse=True)
        both = at_left * len(self.right) + at_right
        order = np.argsort(both)
        self.both, self.ids = both[order], ids[order]

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.array(row["left"], np.int64), np.array(row["right"], np.int64)
        if not len(left) or not len(self.both):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at_left = np.minimum(np.searchsorted(self.left, left), len(self.left) - 1)
        at_right = np.minimum(np.searchsorted(self.right, right), len(self.right) - 1)
        both = at_left * len(self.right) + at_right
        at = np.minimum(np.searchsorted(self.both, both), len(self.both) - 1)
        same = (self.both[at] == both) & (self.left[at_left] == left) & (self.right[at_right] == right)
        code = np.flatnonzero(same)
        return code, self.ids[at[code]]


@contextmanager
def one_block_a_batch(spark: SparkSession) -> Iterator[None]:
    """Rows of blocks, of some MB each, go to Python one by one: a batch of the usual length
    is all blocks of a task, which the executor and its worker would hold at once."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, "1")
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def extended(blocks: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The occurrences of one word more: `block, places, codes, left, right, counts`.

    `keys` has the `id` of every frequent group and the columns `names` by which blocks
    know it; occurrences of other groups go. Each occurrence that is left meets the one at
    the next place. `left` and `right` hold the ids of the two phrases of a group, by code.

    Up to `FREQUENT_SENT` frequent groups are sent to every task; more meet the groups of
    the blocks in a join, which gives each block the codes and ids of its own.
    """
    sent = None
    if keys.count() <= FREQUENT_SENT:
        table = keys.toArrow()
        made = (_WordIds if "words" in names else _PhraseIds)(table)
        sent = blocks.sparkSession.sparkContext.broadcast(made)
        own = ["lang", "words"] if "words" in names else ["left", "right"]
        given = blocks.select("block", "places", "codes", *own)
    else:
        answers = _groups_of(blocks, names).join(keys, names).select("block", "code", "id")
        told = answers.groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("told"))
        given = blocks.join(told, "block").select("block", "places", "codes", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, codes = _unpacked(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                if sent is None:
                    pairs = batch.column(3)[i].values
                    code, name = (pairs.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
                else:
                    row = {c: batch.column(c)[i] for c in own}
                    code, name = sent.value(
                        {c: v.as_py() if c == "lang" else v.values.to_pylist() if c == "words" else v.values.to_numpy()
                         for c, v in row.items()}
                    )
                if not len(code):
                    continue
                frequent = np.zeros(int(max(codes.max(), code.max())) + 1, bool)
                frequent[code] = True
                ids = np.zeros(len(frequent), np.int64)
                ids[code] = name
                kept = frequent[codes]
                places, codes = places[kept], codes[kept].astype(np.int64)
                at = np.flatnonzero(places[1:] == places[:-1] + 1)
                if not len(at):
                    continue
                groups, new, counts = np.unique(
                    codes[at] << 32 | codes[at + 1], return_inverse=True, return_counts=True
                )
                packed = _packed(places[at], new)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1),
                        *[pa.array([x], pa.binary()) for x in packed],
                        *[
                            pa.array([x], pa.list_(pa.int64()))
                            for x in (ids[groups >> 32], ids[groups & 0xFFFFFFFF], counts)
                        ],
                    ],
                    names=["block", "places", "codes", "left", "right", "counts"],
                )

    return given.mapInArrow(
        run,
        f"block long, {_OCCURRENCES}, left array<long>, right array<long>, counts array<long>",
    )


def _groups_of(blocks: DataFrame, names: list[str]) -> DataFrame:
    """`block, code`, the named columns and `n`, one row per distinct group of a block."""
    own = [c for c in names if c == "lang"]
    listed = [c for c in names if c != "lang"]
    zipped = F.arrays_zip(*[F.col(c) for c in listed], F.col("counts"))
    return blocks.select("block", *own, F.posexplode(zipped).alias("code", "group")).select(
        "block",
        "code",
        *own,
        *[F.col(f"group.{c}").alias(c) for c in listed],
        F.col("group.counts").alias("n"),
    )


def _frequent(blocks: DataFrame, names: list[str], min_count: int) -> DataFrame:
    groups = _groups_of(blocks, names)
    if "words" in names:
        counted = groups.groupBy(*names).agg(F.sum("n").alias("a"))
        return counted.filter(F.col("a") >= min_count)
    # Two ids travel as one number: most of what a shuffled row holds.
    pair = F.shiftleft("left", 32).bitwiseOR(F.col("right")).alias("pair")
    counted = groups.select(pair, "n").groupBy("pair").agg(F.sum("n").alias("a"))
    return counted.filter(F.col("a") >= min_count).select(
        F.shiftright("pair", 32).alias("left"), F.col("pair").bitwiseAND(F.lit(_LOWER)).alias("right"), "a"
    )


def _numbered(table: DataFrame, label: str) -> DataFrame:
    """Stored: `table` with an `id` that counts its rows from 0."""
    stored = freeze(table.withColumn("_at", F.monotonically_increasing_id()), label)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per task that wrote the table.
    sizes = {r["part"]: r["n"] for r in stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) >= 1 << 31:
        raise ValueError("more frequent phrases than ids")
    starts = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    first = F.get(F.lit(starts).cast("array<long>"), part.cast("int"))
    return stored.select((first + row).alias("id"), *[c for c in stored.columns if c != "_at"])


def phrases(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    text: str = "text",
    lang: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases of all lengths, and `lang, n` of every language.

    A phrase has `id, lang, words, a`, the counts `starts` of its first 1, 2, ... words
    and `ends` of its last, and `size, inner`: whether a phrase of one more word holds it
    as often.
    """
    blocks = freeze(word_blocks(docs, text, lang), "word-blocks", "zstd", True)
    totals = freeze(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "words-of-languages")
    names = ["lang", "words"]
    found = _frequent(blocks, names, min_count)
    frequent = _numbered(
        found.select(
            "lang",
            F.array("words").alias("words"),
            "a",
            F.array("a").alias("starts"),
            F.array("a").alias("ends"),
        ),
        "phrases-1",
    )
    keys = frequent.select("id", "lang", F.get("words", F.lit(0)).alias("words"))
    levels = []
    for size in range(2, max_words + 1):
        with one_block_a_batch(docs.sparkSession):
            longer = freeze(extended(blocks, keys, names), f"occurrences-{size}", "zstd", True)
        release(blocks)
        blocks, names = longer, ["left", "right"]
        counted = freeze(_frequent(blocks, names, min_count), f"counts-{size}")
        first = frequent.select(F.col("id").alias("left"), "lang", "words", "starts", F.col("a").alias("_l"))
        last = frequent.select(
            F.col("id").alias("right"), F.element_at("words", -1).alias("_word"), "ends", F.col("a").alias("_r")
        )
        new = _numbered(
            counted.join(first, "left")
            .join(last, "right")
            .select(
                "left",
                "right",
                "lang",
                F.concat("words", F.array("_word")).alias("words"),
                "a",
                F.concat("starts", F.array("a")).alias("starts"),
                F.concat("ends", F.array("a")).alias("ends"),
                (F.col("a") >= F.col("_l")).alias("_in_l"),
                (F.col("a") >= F.col("_r")).alias("_in_r"),
            ),
            f"phrases-{size}",
        )
        if size > 2:
            levels.append(_marked(frequent, new))
        frequent, keys = new, new.select("id", "left", "right")
        if frequent.isEmpty():
            break
    release(blocks)
    kept = [*levels, frequent.withColumn("inner", F.lit(False))]
    every = None
    for level in kept:
        rows = level.select("id", "lang", "words", "a", "starts", "ends", "inner")
        every = rows if every is None else every.unionByName(rows)
    return every, totals


def _marked(level: DataFrame, longer: DataFrame) -> DataFrame:
    """`level` with `inner`, true where a phrase of `longer` holds it as often."""
    holding = (
        longer.filter("_in_l").select(F.col("left").alias("id"))
        .unionByName(longer.filter("_in_r").select(F.col("right").alias("id")))
        .distinct()
        .withColumn("inner", F.lit(True))
    )
    return level.join(holding, "id", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))


def _lowest_cut(max_words: int) -> Column:
    """`score, k, l, r` of the lowest-scoring cut after the first k words.

    Products take up to 38 digits, exactly; a score is at most 1000 n.
    """
    cuts = []
    for k in range(1, max_words):
        left, right = f"get(starts, {k - 1})", f"get(ends, size(ends) - {k + 1})"
        score = F.expr(
            "(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000) div "
            f"(cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))"
        )
        cut = F.struct(
            score.alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r")
        )
        cuts.append(F.when(F.size("starts") > k, cut))
    return F.array_min(F.array_compact(F.array(*cuts)))


def collocations(
    docs: DataFrame,
    top: int = TOP,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The best phrases of each language: `lang, rank, phrase, a, l, r, n, score`.

    Equal scores go by falling count, then by the phrase's UTF-8 bytes.
    """
    found, totals = phrases(docs, max_words, min_count, text, lang)
    scored = (
        found.filter(~F.col("inner"))
        .join(totals, "lang")
        .select(
            "lang",
            F.array_join("words", " ").alias("phrase"),
            "a",
            "n",
            _lowest_cut(max_words).alias("cut"),
        )
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (
        scored.withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
