"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers spell the same bytes, so a byte offset where a token of each ends cuts the
text for both. An interval is cut at the common end nearest to its middle: the ends around
the middle of the first tokenizer are looked up among the second's by bisection, going
outwards until one is found, and both halves go on alone. An interval without a common
end is a leaf, a group of tokens that only correspond as a whole. Ends that were looked up
in vain are not tried again in the halves. All intervals of a level, over all documents of
a block, are cut at once.

Tokens whose bytes overlap are linked. How many documents hold an id pair linked is summed
over the corpus: a block of documents gives each of its distinct pairs once, the sums are
partial aggregates, and the totals go back to the blocks by a join on the pair. What is
shuffled grows with the distinct pairs of blocks, not with the links.

Defined cases: a text that is null or empty, or that either tokenizer does not spell as it
stands, has no tokens: zeros and an empty group text. Strings of special tokens are plain
text. Texts are aligned whole; repeated rows are documents of their own, under null ids as
well. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.pieces import ByteLevel, SentencePieces, after_spaces, text_slices
from ledgerwright.session import freeze

# Tokens of a block, or of a single document; bounds the memory of a task.
BLOCK_TOKENS = 500_000


def shared_groups(
    ends_a: np.ndarray, ends_b: np.ndarray, texts_a: np.ndarray, texts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The first token of either kind of every group, in order.

    `ends_a` and `ends_b` are rising byte offsets over all texts; `texts_a` and `texts_b`
    hold where each text's tokens start, and the number of all tokens at the end. Every
    text has tokens, and both kinds of tokens end each text at one offset.
    """
    first_a, first_b = texts_a[:-1], texts_b[:-1]
    # Of every interval its first tokens, and the range of ends of the first kind that
    # may still be common.
    a, b, low, high = first_a, first_b, first_a, texts_a[1:] - 2
    leaves_a, leaves_b = [first_a[:0]], [first_b[:0]]
    while len(a):
        wide = low <= high
        leaves_a.append(a[~wide])
        leaves_b.append(b[~wide])
        a, b, low, high = a[wide], b[wide], low[wide], high[wide]
        middle = (low + high) // 2
        cut_a, cut_b = np.full(len(a), -1), np.full(len(a), -1)
        # What is left to try on either side of the ends that were looked up.
        below, above = middle - 1, middle.copy()
        pending = np.arange(len(a))
        upwards = True
        while len(pending):
            tried = above[pending] if upwards else below[pending]
            inside = tried <= high[pending] if upwards else tried >= low[pending]
            rows, tried = pending[inside], tried[inside]
            offset = ends_a[tried]
            at = np.searchsorted(ends_b, offset)
            hit = ends_b[at] == offset
            cut_a[rows[hit]], cut_b[rows[hit]] = tried[hit], at[hit]
            if upwards:
                above[rows] += 1
            else:
                below[rows] -= 1
            more = (above[pending] <= high[pending]) | (below[pending] >= low[pending])
            pending = pending[(cut_a[pending] < 0) & more]
            upwards = not upwards
        found = cut_a >= 0
        leaves_a.append(a[~found])
        leaves_b.append(b[~found])
        a, b, low, high = a[found], b[found], low[found], high[found]
        cut_a, cut_b, below, above = cut_a[found], cut_b[found], below[found], above[found]
        a, b = np.concatenate([a, cut_a + 1]), np.concatenate([b, cut_b + 1])
        low, high = np.concatenate([low, above]), np.concatenate([below, high])
    groups_a, groups_b = np.concatenate(leaves_a), np.concatenate(leaves_b)
    order = np.argsort(groups_a)
    return groups_a[order], groups_b[order]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token numbers of every pair whose byte ranges overlap, and where that ends."""
    # Whether a token ends at a byte; no two of a kind end at the same one.
    n_bytes = 1 + max(int(x[-1]) if len(x) else -1 for x in (ends_a, ends_b))
    is_a, is_b = np.zeros(n_bytes, bool), np.zeros(n_bytes, bool)
    is_a[ends_a] = True
    is_b[ends_b] = True
    ends = np.flatnonzero(is_a | is_b)
    # As many tokens end before an end as stand before the one that holds the byte in front.
    return np.cumsum(is_a[ends]) - is_a[ends], np.cumsum(is_b[ends]) - is_b[ends], ends


def sorted_by(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The stable order by two ids; ids of 16 bits each are sorted digit by digit."""
    if max(first.max(initial=0), second.max(initial=0)) >= 1 << 16:
        return np.argsort(first.astype(np.int64) << 32 | second, kind="stable")
    order = np.argsort(second.astype(np.uint16), kind="stable")
    return order[np.argsort(first[order].astype(np.uint16), kind="stable")]


class GroupTexts:
    """Groups as text, `a1,a2|b1;a3|b2,b3`, ids in decimal."""

    def __init__(self, size_a: int, size_b: int):
        # Every id with the mark that follows it inside a group, and at its end.
        self.base = 2 * size_a
        self.marked = [b"%d%s" % (i, m) for i in range(size_a) for m in (b",", b"|")]
        self.marked += [b"%d%s" % (i, m) for i in range(size_b) for m in (b",", b";")]

    def of(self, ids_a, ids_b, groups_a, groups_b, texts_a, texts_b) -> list[bytes]:
        """One text for each text that has tokens."""
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        for ids, groups, others, base in (
            (ids_a, groups_a, groups_b, 0),
            (ids_b, groups_b, np.append(groups_a[1:], len(ids_a)), self.base),
        ):
            sizes = np.diff(np.append(groups, len(ids)))
            last = np.zeros(len(ids), np.int64)
            last[groups + sizes - 1] = 1
            # A group's tokens stand behind all of the other kind that come before them.
            order[np.arange(len(ids)) + np.repeat(others, sizes)] = base + 2 * ids.astype(np.int64) + last
        bounds = (texts_a + texts_b).tolist()
        of = self.marked.__getitem__
        return [
            b"".join(map(of, order[i:j].tolist()))[:-1] for i, j in zip(bounds, bounds[1:], strict=False)
        ]


@dataclass
class Pair:
    """The two tokenizers, as they are broadcast."""

    a: ByteLevel
    b: SentencePieces

    def ready(self) -> Pair:
        """With tables, made once in every worker."""
        if not hasattr(self, "texts"):
            self.bytes_a, self.bytes_b = self.a.spelled(), self.b.spelled()
            self.length_a = np.array([len(x) for x in self.bytes_a])
            self.length_b = np.array([len(x) for x in self.bytes_b])
            self.separable = self.b.separable()
            self.lossless = {bytes([i]) for i in range(256)} <= set(self.bytes_a)
            self.texts = GroupTexts(len(self.bytes_a), len(self.bytes_b))
            self.judged: dict[str, bool] = {}
        return self

    def __getstate__(self):
        return {"a": self.a, "b": self.b}

    def _equal(self, text: str, ids_a: np.ndarray, ids_b: np.ndarray) -> bool:
        spelled = f" {text}".encode()
        return (
            b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == spelled
            and b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == spelled
        )

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text by both, None where they do not spell it."""
        parts = [after_spaces(x) if self.separable else [x] for x in texts]
        both = zip(texts, parts, self.a.ids(texts, spaced=True), self.b.pieced(parts), strict=True)
        out = []
        for text, pieces, ids_a, ids_b in both:
            # The first kind spells all bytes, the second the pieces that it is known to.
            known = self.lossless and self.separable and self.b.unlike.isdisjoint(pieces)
            fits = text and (known or self._equal(text, ids_a, ids_b))
            out.append((ids_a, ids_b) if fits else None)
        return out


def _starts(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in arrays], dtype=np.int64)]).astype(np.int64)


_BLOCK = pa.schema(
    [
        ("keys", pa.list_(pa.int64())),
        ("n_a", pa.list_(pa.int64())),
        ("n_b", pa.list_(pa.int64())),
        ("n_groups", pa.list_(pa.int64())),
        ("n_links", pa.list_(pa.int64())),
        ("groups", pa.list_(pa.binary())),
        ("codes", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
    ]
)


def _aligned_block(keys: list, ids: list, pair: Pair, digest: bool) -> pa.RecordBatch:
    """One row for a block of documents: what is known of each, the codes of all links in
    turn, and the id pairs by code with how many of the documents hold them."""
    held = [x for x in ids if x is not None]
    texts_a, texts_b = _starts([x for x, _ in held]), _starts([x for _, x in held])
    ids_a = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.uint32)
    ids_b = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.uint32)
    # The bytes of a block, or of a single text, are few enough for 32 bits.
    ends_a, ends_b = (np.cumsum(x, dtype=np.int32) for x in (pair.length_a[ids_a], pair.length_b[ids_b]))
    groups_a, groups_b = shared_groups(ends_a, ends_b, texts_a, texts_b)
    spelled = pair.texts.of(ids_a, ids_b, groups_a, groups_b, texts_a, texts_b) if held else []
    if digest:
        spelled = [hashlib.sha256(x).hexdigest().encode() for x in spelled]
    at_a, at_b, ends = links(ends_a, ends_b)
    linked_a, linked_b = ids_a[at_a], ids_b[at_b]
    couples = linked_a.astype(np.int64) << 32 | linked_b
    n_links = np.diff(np.searchsorted(ends, ends_a[texts_a[1:] - 1], "right"), prepend=0)
    # Sorted by pair, the documents of each pair rise.
    order = sorted_by(linked_a, linked_b)
    ordered = couples[order]
    doc = np.repeat(np.arange(len(held)), n_links)[order]
    new_pair = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    new_doc = new_pair | np.append(True, doc[1:] != doc[:-1])[: len(ordered)]
    firsts = np.flatnonzero(new_pair)
    codes = np.empty(len(couples), np.int64)
    codes[order] = np.cumsum(new_pair) - 1
    counts = np.add.reduceat(new_doc.astype(np.int64), firsts) if len(firsts) else firsts
    width = "<u2" if len(firsts) <= 1 << 16 else "<u4"

    full = np.array([x is not None for x in ids], bool)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        out[full] = values
        return out

    in_text = np.diff(np.searchsorted(groups_a, texts_a))
    rest = iter(spelled)
    columns = [
        keys,
        spread(np.diff(texts_a)),
        spread(np.diff(texts_b)),
        spread(in_text),
        spread(n_links),
        [next(rest) if x else b"" for x in full],
        codes.astype(width).tobytes(),
        ordered[firsts],
        counts,
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK
    )


def aligned_blocks(docs: DataFrame, a: ByteLevel, b: SentencePieces, digest: bool, key: str, text: str) -> DataFrame:
    """Blocks of aligned documents, see `_aligned_block`."""
    from pyspark.sql.pandas.types import from_arrow_schema

    pair = docs.sparkSession.sparkContext.broadcast(Pair(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair.value.ready()
        keys, ids, n = [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, texts in text_slices(batch.column(1)):
                for name, made in zip(names[first:], both.encoded([x or "" for x in texts]), strict=False):
                    keys.append(name)
                    ids.append(made)
                    n += 1 + (len(made[0]) if made else 0)
                    if n >= BLOCK_TOKENS:
                        yield _aligned_block(keys, ids, both, digest)
                        keys, ids, n = [], [], 0
        if keys:
            yield _aligned_block(keys, ids, both, digest)

    given = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = given.mapInArrow(run, from_arrow_schema(_BLOCK))
    return rows.withColumn("block", F.monotonically_increasing_id())


def link_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`block, code, pair, n` of the distinct pairs of each block; and stored, `pair, n,
    best`: the documents of the corpus that hold a pair, and whether no pair of the same
    first id is in more."""
    zipped = F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "group")
    rows = blocks.select("block", zipped).select(
        "block", "code", F.col("group.pairs").alias("pair"), F.col("group.counts").alias("n")
    )
    totals = freeze(
        rows.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)), "link-counts"
    )
    highest = totals.groupBy("a").agg(F.max("n").alias("most"))
    judged = totals.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return rows, freeze(judged, "link-totals")


def aligned(
    docs: DataFrame,
    a: ByteLevel,
    b: SentencePieces,
    digest: bool = False,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document `key, n_a, n_b, n_groups, n_links, n_best, count_sum` and its groups
    as text, `groups`, or with `digest` their `groups_sha256`.

    The first tokenizer gets a space and the text, the second puts the space itself.
    """
    blocks = freeze(aligned_blocks(docs, a, b, digest, key, text), "aligned", "zstd")
    rows, totals = link_counts(blocks)
    answers = rows.drop("n").join(totals, "pair")
    told = answers.groupBy("block").agg(F.collect_list(F.struct("code", "n", "best")).alias("told"))
    name = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = [batch.column(c)[i].values for c in range(6)]
                n_links = known[4].to_numpy(zero_copy_only=False)
                sums = [np.zeros(len(n_links), np.int64)] * 2
                if batch.column(7)[i].is_valid:
                    pairs = batch.column(7)[i].values
                    code = pairs.field(0).to_numpy(zero_copy_only=False)
                    width = "<u2" if len(code) <= 1 << 16 else "<u4"
                    codes = np.frombuffer(batch.column(6)[i].as_py(), width)
                    stops = np.cumsum(n_links)
                    sums = []
                    for field in (2, 1):
                        by_code = np.empty(len(code), np.int64)
                        by_code[code] = pairs.field(field).cast(pa.int64()).to_numpy(zero_copy_only=False)
                        upto = np.append(0, np.cumsum(by_code[codes]))
                        sums.append(upto[stops] - upto[stops - n_links])
                yield pa.RecordBatch.from_arrays(
                    [*known[:5], *[pa.array(x) for x in sums], known[5].cast(pa.string())],
                    names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", name],
                )

    names = [f.name for f in _BLOCK][:7]
    return blocks.select("block", *names).join(told, "block", "left").select(*names, "told").mapInArrow(
        run,
        f"`{key}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        f"count_sum long, {name} string",
    )
