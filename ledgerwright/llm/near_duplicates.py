"""Near-duplicate documents by order MinHash.

A document is the sequence of its five-word shingles, each labelled with how often it has
occurred before. For every hash function the sketch samples the two smallest labelled
shingles and hashes them in their text order, so that two sketches agree where texts
share shingles in the same order - the property that edits preserve and shuffling
destroys. Documents that agree on one, two or four neighbouring samples fall into a
bucket. Small buckets compare all their members, larger ones compare them with their few
most central members first; members that this leaves in different components go through
an exact prefix-filter join on their rarest shingles (see `pivots`).

A candidate is verified on whole texts by banded alignment: labelled shingles common to
both are matched inside the diagonal band that the threshold leaves possible, and the
longest chain of matches in text order counts. The similarity is that chain over the
shingles of both texts, a Jaccard index of ordered shingles; 0.8 or more links the two.
Classes are the connected components of the links.

Equal texts are one node throughout, so thousands of copies cost one row after the first
pass, and a bucket, a pivot or a class may be as large as it likes: buckets are reduced
by partial aggregates, and members meet their pivot in joins of plain stored tables,
which adaptive execution splits where one key is hot.

Defined cases: a null text is in a class of its own. Texts without words are equal to one
another only if their bytes are; a text of one to four words is one shingle. Rows
repeated under one id are one document. An empty table gives an empty result. Extra
columns are ignored by `classes` and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.components import components
from ledgerwright.llm.pivots import crossing, elements, pivoted, unsettled
from ledgerwright.llm.sketches import (
    U64,
    WordHashes,
    constants,
    longest_increasing,
    mix64,
    occurrences,
)
from ledgerwright.llm.texts import fresh, map_rows, repeats, small_batches
from ledgerwright.session import freeze, release

SHINGLE = 5
SAMPLES = 16
SIMILARITY = 0.8
# Neighbouring samples that make a bucket. One sample alone finds a pair at the threshold
# with probability 0.64; the longer ones keep documents that share a passage apart.
RUNS = (1, 2, 4)
# Pivots of a bucket.
CLASSES = 4

_WEIGHTS = constants(SHINGLE, 11)
_FUNCTIONS = constants(SAMPLES, 23)[:, None]
_SHIFTS = constants(SAMPLES, 37)[:, None]
_LABEL, _FIRST, _SECOND = constants(3, 53)


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Occurrence-labelled five-word shingles in text order, as 64-bit hashes."""
    if not words:
        return np.zeros(0, U64)
    h = hashes.of(words)
    if len(h) < SHINGLE:
        h = np.r_[h, np.full(SHINGLE - len(h), U64(len(h)))]
    n = len(h) - SHINGLE + 1
    x = np.zeros(n, U64)
    for i in range(SHINGLE):
        x += h[i : i + n] * _WEIGHTS[i]
    x = mix64(x)
    return mix64(x + occurrences(x) * _LABEL)


def sketch(labelled: np.ndarray) -> np.ndarray:
    """For each function, the two least shingles hashed in text order."""
    ranked = (labelled[None, :] ^ _SHIFTS) * _FUNCTIONS
    first = ranked.argmin(axis=1)
    rows = np.arange(SAMPLES)
    if len(labelled) > 1:
        ranked[rows, first] = ~U64(0)
        second = ranked.argmin(axis=1)
    else:
        second = first
    a, b = labelled[np.minimum(first, second)], labelled[np.maximum(first, second)]
    return mix64(a * _FIRST + mix64(b * _SECOND) + _FUNCTIONS[:, 0])


def _measure() -> Callable[[bytes], tuple]:
    hashes = WordHashes()

    def row(text: bytes | None) -> tuple:
        words = text.split() if text else []
        if not words:
            return 0, None
        return len(words), sketch(shingles(words, hashes)).astype("<u8").tobytes()

    return row


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Ordered shingles in common over shingles of both, by banded alignment.

    A pair at `least` has at least `need` matches, so no more shingles than the rest of
    either text can stand between two matching positions: matches outside that band of
    diagonals cannot belong to a sufficient chain. Below `least` the value is a lower
    bound.
    """
    if not len(a) or not len(b):
        return 0.0
    need = least / (1 + least) * (len(a) + len(b))
    if min(len(a), len(b)) < need:
        return 0.0
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    band = max(len(a), len(b)) - need
    near = np.abs(at_a - at_b) <= band + 1
    if near.sum() < need:
        return 0.0
    order = np.argsort(at_a[near])
    chain = longest_increasing(at_b[near][order])
    return chain / (len(a) + len(b) - chain)


def _nodes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row with the digest of its text; every distinct text with an id and sketch."""
    body = docs[text]
    tagged = docs.select(
        docs[key].alias("_key"),
        F.unhex(F.md5(body.cast("binary"))).alias("_digest"),
        body.cast("binary").alias("_body"),
    )
    rows = freeze(
        map_rows(
            tagged, ["_key", "_digest"], F.col("_body"), _measure, "n_words int, sketch binary"
        ),
        "sketched",
    )
    # Not `first`, whose choice is free: the least key of a digest stands for it.
    named = rows.filter("_digest is not null").groupBy("_digest").agg(
        F.min("_key").alias("_key"), F.max("n_words").alias("n_words"), F.max("sketch").alias("sketch")
    )
    nodes = freeze(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
    return rows.select("_key", "_digest"), nodes


def _bucket_keys(sketches: DataFrame) -> DataFrame:
    """`bucket, node`: one row per bucket that a node falls into."""

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8")
            samples = flat.reshape(len(node), SAMPLES)
            keys = []
            for length in RUNS:
                run_hash = np.zeros_like(samples)
                for i in range(length):
                    run_hash = mix64(run_hash * _FIRST + np.roll(samples, -i, axis=1))
                keys.append(run_hash + U64(length))
            buckets = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(buckets.ravel().view(np.int64)),
                    pa.array(np.repeat(node, buckets.shape[1])),
                ],
                names=["bucket", "node"],
            )

    return sketches.mapInArrow(run, "bucket long, node long")


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored, the pairs of a bucket whose lengths allow the similarity; and the members of
    buckets too large to be compared whole."""
    with_sketch = nodes.filter("sketch is not null")
    pairs, large = pivoted(_bucket_keys(with_sketch.select("node", "sketch")), CLASSES)
    side = with_sketch.select("node", "n_words")
    left = pairs.join(side, "node").withColumnRenamed("n_words", "_n")
    both = left.join(side.withColumnRenamed("node", "pivot"), "pivot")
    shingle_count = [F.greatest(F.col(c) - (SHINGLE - 1), F.lit(1)) for c in ("n_words", "_n")]
    near_length = F.least(*shingle_count) >= SIMILARITY * F.greatest(*shingle_count)
    kept = freeze(both.filter(near_length).select("node", "pivot"), "candidates")
    release(pairs)
    return kept, large


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole texts align; `texts` has `node, body`, one row per node."""
    members = pairs.join(texts.withColumnRenamed("body", "_a"), "node")
    both = members.join(texts.select(F.col("node").alias("pivot"), F.col("body").alias("_b")), "pivot")

    def run(batches):
        hashes = WordHashes()
        last, kept = None, None
        for batch in batches:
            nodes, pivots = batch.column(0), batch.column(1)
            keep = []
            for i in range(batch.num_rows):
                a = shingles(batch.column(2)[i].as_py().split(), hashes)
                # Rows of one pivot stand together after the join.
                if pivots[i] != last:
                    last, kept = pivots[i], shingles(batch.column(3)[i].as_py().split(), hashes)
                keep.append(similarity(a, kept) >= SIMILARITY)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [nodes.filter(mask), pivots.filter(mask)], names=["node", "pivot"]
            )

    return both.select("node", "pivot", "_a", "_b").mapInArrow(run, "node long, pivot long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()


def _texts_of(docs: DataFrame, some: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """`node, body` of the nodes in `some`, each text once.

    Always a shuffled join: the ids asked for grow with the corpus, and a plan that
    broadcasts them while they are few would be another one at scale.
    """
    asked = freeze(
        some.select("node").join(nodes.select("node", "_key", "_digest"), "node"),
        "asked",
    )
    wanted = asked.select(
        "node", F.col("_key").alias("_asked_key"), F.col("_digest").alias("_asked")
    ).hint("merge")
    found = (
        docs.select(docs[key].alias("_key"), docs[text].cast("binary").alias("body"))
        .join(wanted, F.col("_key").eqNullSafe(F.col("_asked_key")))
        .filter(F.unhex(F.md5("body")) == F.col("_asked"))
    )
    found = found.select("node", "body")
    texts = freeze(found.dropDuplicates(["node"]) if repeats(docs, key) else found, "texts")
    release(asked)
    return texts


def _shingle_sets() -> Callable[[bytes], np.ndarray]:
    hashes = WordHashes()
    return lambda body: shingles(body.split(), hashes)


def _completed(
    docs: DataFrame, nodes: DataFrame, large: DataFrame, merged: DataFrame, key: str, text: str
) -> DataFrame:
    """`merged` with the links of large buckets that no pivot has."""
    rest = unsettled(large, merged)
    if rest.isEmpty():
        return merged
    texts = _texts_of(docs, rest, nodes, key, text)
    with small_batches(docs.sparkSession):
        sets = freeze(elements(texts.join(rest, "node"), _shingle_sets), "shingles")
    pairs = crossing(sets, SIMILARITY)
    release(sets, rest)
    with small_batches(docs.sparkSession):
        links = freeze(_verified(pairs, texts), "crossing-links")
    release(texts, pairs)
    if links.isEmpty():
        return merged
    both = links.unionByName(merged.select("node", F.col("component").alias("pivot")))
    return freeze(components(both, "node", "pivot"), "merged")


def _classed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows `_key, _digest`, and per distinct text `_digest, class_id, stays`."""
    rows, nodes = _nodes(docs, key, text)
    pairs, large = _candidates(nodes)
    texts = _texts_of(docs, _ends(pairs), nodes, key, text)
    with small_batches(docs.sparkSession):
        links = freeze(_verified(pairs, texts), "links")
    release(pairs, texts)
    merged = freeze(components(links, "node", "pivot"), "merged")
    merged = _completed(docs, nodes, large, merged, key, text)
    release(links)
    placed = freeze(
        nodes.select("node", "_key", "_digest")
        .join(merged, "node", "left")
        .select("_key", "_digest", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    heads = freeze(
        placed.groupBy("component").agg(F.min(F.struct("_key", "_digest")).alias("head")), "heads"
    )
    classed = freeze(
        placed.join(heads, "component").select(
            "_digest",
            F.col("head._key").alias("class_id"),
            (F.col("head._digest") == F.col("_digest")).alias("stays"),
        ),
        "classed",
    )
    release(nodes, placed, heads, merged)
    return rows, classed


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, class_id` of every row; a class is named by its least id."""
    rows, classed = _classed(docs, key, text)
    return rows.join(classed.drop("stays"), "_digest", "left").select(
        F.col("_key").alias(key), F.coalesce("class_id", "_key").alias("class_id")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, one of each class: the document with the least id."""
    rows, classed = _classed(docs, key, text)
    known = rows.join(classed, "_digest", "left").filter(
        F.col("_digest").isNull()
        | (F.col("stays") & F.col("class_id").eqNullSafe(F.col("_key")))
    )
    kept = freeze(known.groupBy("_key", "_digest").agg(F.count(F.lit(1)).alias("_times")), "kept")
    names = docs.columns
    whole = fresh(docs, "_doc")
    packed = docs.select(
        F.struct(*[docs[c] for c in names]).alias(whole),
        docs[key].alias("_doc_key"),
        F.unhex(F.md5(docs[text].cast("binary"))).alias("_doc_digest"),
    )
    same = F.col("_doc_key").eqNullSafe(F.col("_key")) & F.col("_doc_digest").eqNullSafe(
        F.col("_digest")
    )
    once = packed.join(kept.filter("_times = 1"), same, "left_semi").select(whole)
    # Only rows that repeat under one id have to be told apart.
    again = (
        packed.join(kept.filter("_times > 1"), same, "left_semi")
        .dropDuplicates(["_doc_key", "_doc_digest"])
        .select(whole)
    )
    return once.unionByName(again).select(*[F.col(f"{whole}.`{c}`") for c in names])
