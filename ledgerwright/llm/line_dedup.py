"""Fuzzy line deduplication by MinHash over the whole corpus.

Every line with a word gets a MinHash signature of its character shingles. Bands of the
signature put similar lines into common buckets. Small buckets compare all their members,
larger ones compare them with their most central members first; members that this leaves
in different components go through an exact prefix-filter join on their rarest shingles
(see `pivots`). Pairs are compared by the exact Jaccard index of the shingle sets.
Connected components of the
verified links are found by distributed union-find, and of each component the first line
stays: the one with the least document id, text digest and line number. All others go, equal lines
included; the remaining lines keep their order.

Equal lines are one node after the first pass. Buckets and components are reduced by
partial aggregates and met in joins of plain stored tables, so none is ever gathered.
Texts travel again only for lines in a candidate pair and for documents that lose lines.

Defined cases: lines end at "\\n" alone. A line without a word (white space or nothing)
is never compared and always stays. A line shorter than a shingle is one shingle. A null
text stays null, an empty one empty; a text whose lines all go becomes empty and its
document stays. A document is an id, null or not, with a text: rows that repeat both are
one document at one place, whose lines stay or go together; rows of one id with different
texts are different documents. An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.components import components
from ledgerwright.llm.pivots import crossing, elements, pivoted, unsettled
from ledgerwright.llm.sketches import constants
from ledgerwright.llm.texts import fresh, repeats
from ledgerwright.session import freeze, release

SHINGLE = 8
SIMILARITY = 0.8
# A pair at the threshold shares a band with probability 1 - (1 - 0.8^4)^12 = 0.998, lines
# that have a tenth in common with probability 0.001.
BANDS, ROWS = 12, 4
# Pivots of a bucket.
CLASSES = 8
# Characters hashed at once; bounds the working memory of a task.
CHUNK_CHARS = 1 << 20

_HASHES = BANDS * ROWS
_MUL = (constants(_HASHES, 71) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (constants(_HASHES, 79) >> np.uint64(32)).astype(np.uint32)
_BASE = [np.uint64(x) for x in constants(3, 83)]
_FOLD = constants(ROWS, 89)
_BAND = constants(BANDS, 97)


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all windows of eight characters, by doubling 1, 2, 4, 8.

    Only the upper halves are well mixed. `codes` holds code points.
    """
    h = codes.astype(np.uint64)
    for i, base in enumerate(_BASE):
        step = 1 << i
        h = h[:-step] * base + h[step:]
        h ^= h >> np.uint64(29)
    return h * _BASE[0]


def _padded(line: str) -> str:
    """A line shorter than a shingle, filled with a character that no text contains."""
    return line if len(line) >= SHINGLE else line + "\U0010ffff" * (SHINGLE - len(line))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def band_keys(lines: list[str]) -> np.ndarray:
    """One row of band keys per line: MinHash signatures folded band by band."""
    out = np.empty((len(lines), BANDS), np.uint64)
    at = 0
    while at < len(lines):
        stop, chars = at, 0
        while stop < len(lines) and (stop == at or chars + len(lines[stop]) <= CHUNK_CHARS):
            chars += len(lines[stop])
            stop += 1
        padded = [_padded(x) for x in lines[at:stop]]
        lengths = np.fromiter(map(len, padded), np.int64, len(padded))
        starts = np.cumsum(lengths) - lengths
        h = shingle_hashes(_code_points("".join(padded)))
        # Windows that reach into the next line are not shingles.
        inside = np.ones(len(h), bool)
        for back in range(1, SHINGLE):
            inside[starts[1:] - back] = False
        h = (h[inside] >> np.uint64(32)).astype(np.uint32)
        counts = lengths - (SHINGLE - 1)
        first = np.cumsum(counts) - counts
        for band in range(BANDS):
            key = np.full(len(padded), _BAND[band])
            for row in range(ROWS):
                j = band * ROWS + row
                least = np.minimum.reduceat((h ^ _XOR[j]) * _MUL[j], first)
                key = (key ^ least) * _FOLD[row]
                key ^= key >> np.uint64(31)
            out[at:stop, band] = key
        at = stop
    return out


def _shingle_set(line: str) -> set[int]:
    return set(shingle_hashes(_code_points(_padded(line))).tolist())


def jaccard(a: set[int], b: set[int]) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _text_digest(text: Column) -> Column:
    """What tells documents of one id apart."""
    return F.unhex(F.md5(text.cast("binary")))


def _occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`_key, _doc, line_no, digest, bands` of every line with a word.

    Bands are given with the first occurrence of a line in a batch only.
    """
    given = docs.select(
        docs[key].alias("_key"), _text_digest(docs[text]).alias("_doc"), docs[text].alias("_text")
    )
    schema = given.select("_key", "_doc").schema.add("line_no", "integer").add(
        "digest", "binary"
    ).add("bands", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, digests, new = [], [], [], {}
            for i, text in enumerate(batch.column(2).to_pylist()):
                for n, line in enumerate((text or "").split("\n")):
                    if not line.encode().strip():
                        continue
                    digest = hashlib.md5(line.encode()).digest()
                    owner.append(i)
                    number.append(n)
                    digests.append(digest)
                    new.setdefault(digest, (len(digests) - 1, line))
            bands: list[bytes | None] = [None] * len(digests)
            keys = band_keys([line for _, line in new.values()])
            for (at, _), row in zip(new.values(), keys, strict=True):
                bands[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    batch.column(1).take(pa.array(owner, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.binary()),
                ],
                names=["_key", "_doc", "line_no", "digest", "bands"],
            )

    return given.mapInArrow(run, schema)


def _bucket_rows(lines: DataFrame) -> DataFrame:
    """`bucket, node`: one row per band of a distinct line."""

    def run(batches):
        for batch in batches:
            line = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.repeat(line, BANDS))], names=["bucket", "node"]
            )

    return lines.select("line", "bands").mapInArrow(run, "bucket long, node long")


def _candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored, distinct pairs of a line and a pivot of one of its buckets; and the members
    of buckets too large to be compared whole."""
    return pivoted(_bucket_rows(lines), CLASSES)


def _texts_of(docs: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """`line, body` of the distinct lines asked for, taken from where each first stands.

    Always a shuffled join, as in `cleaned`: what is asked for grows with the corpus, and
    a plan that broadcasts it while it is small would be another one at scale.
    """
    places = freeze(
        asked.groupBy("_key", "_doc").agg(F.collect_set(F.struct("line_no", "line")).alias("_places")),
        "places",
    ).withColumnsRenamed({"_key": "_asked", "_doc": "_asked_doc"}).hint("merge")
    same = F.col("_key").eqNullSafe(F.col("_asked")) & (F.col("_doc") == F.col("_asked_doc"))
    found = (
        docs.select(
            docs[key].alias("_key"),
            _text_digest(docs[text]).alias("_doc"),
            docs[text].alias("_text"),
        )
        .join(places, same)
        .select(F.split("_text", "\n").alias("_lines"), F.explode("_places").alias("p"))
        .select("p.line", F.get("_lines", F.col("p.line_no")).alias("body"))
        .filter("body is not null")
    )
    return found.dropDuplicates(["line"]) if repeats(docs, key) else found


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    members = pairs.join(texts.withColumnRenamed("body", "_a"), "line")
    both = members.join(
        texts.select(F.col("line").alias("pivot"), F.col("body").alias("_b")), "pivot"
    )

    def run(batches):
        for batch in batches:
            last, kept, keep = None, None, []
            pivots = batch.column(1).to_pylist()
            for pivot, a, b in zip(
                pivots, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                # Rows of one pivot stand together after the join.
                if pivot != last:
                    last, kept = pivot, _shingle_set(b)
                keep.append(jaccard(_shingle_set(a), kept) >= SIMILARITY)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)],
                names=["line", "pivot"],
            )

    return both.select("line", "pivot", "_a", "_b").mapInArrow(run, "line long, pivot long")


def _shingle_array(line: str) -> np.ndarray:
    return shingle_hashes(_code_points(_padded(line)))


def _first_places(lines: DataFrame, some: DataFrame) -> DataFrame:
    """`_key, _doc, line_no, line` of where each of some lines first stands."""
    return lines.join(some, "line", "left_semi").select("first.*", "line")


def _completed(
    docs: DataFrame, lines: DataFrame, large: DataFrame, merged: DataFrame, key: str, text: str
) -> DataFrame:
    """`merged` with the links of large buckets that no pivot has."""
    unsettled_nodes = unsettled(large, merged)
    rest = unsettled_nodes.withColumnRenamed("node", "line")
    if rest.isEmpty():
        return merged
    texts = freeze(_texts_of(docs, _first_places(lines, rest), key, text), "unsettled-texts")
    bodies = texts.join(rest, "line").withColumnRenamed("line", "node")
    sets = freeze(elements(bodies, lambda: _shingle_array), "line-shingles")
    pairs = crossing(sets, SIMILARITY)
    release(sets, unsettled_nodes)
    links = freeze(_verified(pairs.withColumnRenamed("node", "line"), texts), "crossing-links")
    release(texts, pairs)
    if links.isEmpty():
        return merged
    both = links.unionByName(
        merged.select(F.col("node").alias("line"), F.col("component").alias("pivot"))
    )
    return freeze(components(both, "line", "pivot"), "line-components")


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_key, _doc, line_no` of every line that goes; `_doc` is the digest of the text."""
    read = freeze(_occurrences(docs, key, text), "lines")
    lines = freeze(
        read.groupBy("digest")
        .agg(
            F.min(F.struct("_key", "_doc", "line_no")).alias("first"),
            F.max("bands").alias("bands"),
            F.count(F.lit(1)).alias("times"),
        )
        .select("digest", "first", "bands", "times")
        .withColumn("line", F.monotonically_increasing_id()),
        "distinct-lines",
    )
    found = freeze(read.drop("bands"), "line-places")
    release(read)
    met, large = _candidates(lines)
    pairs = met.withColumnRenamed("node", "line")
    in_pairs = pairs.select("line").unionByName(pairs.select(F.col("pivot").alias("line"))).distinct()
    texts = freeze(_texts_of(docs, _first_places(lines, in_pairs), key, text), "line-texts")
    links = freeze(_verified(pairs, texts), "line-links")
    release(met, texts)
    merged = freeze(components(links, "line", "pivot"), "line-components")
    merged = _completed(docs, lines, large, merged, key, text)
    release(links)

    # Lines of a component of their own are decided without it.
    known = lines.select("line", "digest", "first", "times")
    alone = known.join(merged.select(F.col("node").alias("line")), "line", "left_anti")
    joined = freeze(
        known.join(merged.withColumnRenamed("node", "line"), "line"), "joined-lines"
    )
    heads = freeze(joined.groupBy("component").agg(F.min("first").alias("head")), "line-heads")
    repeated = freeze(
        alone.filter("times > 1")
        .select("digest", F.col("first").alias("head"))
        .unionByName(joined.join(heads, "component").select("digest", "head")),
        "repeated-lines",
    )
    release(lines, merged, joined, heads)
    return (
        found.select("_key", "_doc", "line_no", "digest")
        .join(repeated, "digest")
        .filter(~F.struct("_key", "_doc", "line_no").eqNullSafe(F.col("head")))
        .select("_key", "_doc", "line_no")
    )


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """The rows of `docs` with `text` less its dropped lines; with `counts`, plus
    `n_lines` and `n_dropped`."""
    gone = freeze(
        dropped_lines(docs, key, text)
        .groupBy("_key", "_doc")
        .agg(F.sort_array(F.collect_set("line_no")).alias("_gone")),
        "dropped",
    ).withColumnsRenamed({"_key": "_gone_key", "_doc": "_gone_doc"}).hint("merge")
    same = F.col("_own_key").eqNullSafe(F.col("_gone_key")) & (
        F.col("_own_doc") == F.col("_gone_doc")
    )
    names = docs.columns
    rest = fresh(docs, "_rest")
    # The text travels as its lines: split below the join, it is split once per row.
    met = docs.select(
        F.struct(*[docs[c] for c in names if c != text]).alias(rest),
        docs[key].alias("_own_key"),
        _text_digest(docs[text]).alias("_own_doc"),
        F.split(docs[text], "\n").alias("_lines"),
    ).join(gone, same, "left")
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.get("_lines", i))
    body = F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(kept), "\n")
    columns = [body.alias(c) if c == text else F.col(f"{rest}.`{c}`") for c in names]
    if counts:
        columns += [
            F.coalesce(F.size("_lines"), F.lit(0)).alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).alias("n_dropped"),
        ]
    return met.select(*columns)
