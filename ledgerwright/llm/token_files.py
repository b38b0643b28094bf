"""Token ids in binary files: frequency-ranked, byte-aligned, control bytes apart.

Every id is replaced by its rank among the ids of the corpus, the most frequent first, so
that most ranks fit into one byte. A rank takes one to four bytes, least byte first. Its
length is a two-bit code in a control byte for four ranks; control bytes stand in a
section of their own, so that a reader turns each into four lengths by one table lookup
and finds all ranks without a branch.

A file is a sequence of blocks in ascending document order, all numbers least byte first:

    magic "LWT1", then uint32 n_docs, uint64 n_control, uint64 n_data
    n_docs times uint8, 1 where the document has an id, then n_docs times int64, the ids
    n_docs times uint32, the tokens of the document
    n_control control bytes, each document's starting at a byte of its own
    n_data bytes of ranks

The table from rank to id is `ranks.u32` beside the files. Files are written by Spark
tasks straight to a shared folder under names that no other attempt uses, and a manifest
table lists those of the attempts that counted; a task that is repeated leaves at most a
file that nobody reads.

Documents are encoded once and stored, ids are counted with partial sums, and the coded
documents are then laid out by id in ranges of near equal size: rows of one id, or without
one, are told apart by a digest of their tokens and a row number, so that no id is too
large for a range.

Defined cases: a null or empty text has the end id alone. Null ids stand before all
others, rows of one id in the order of their digests. An empty table makes no files and
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.pieces import ByteLevel, slices, text_slices
from ledgerwright.operators.ordered import running_totals
from ledgerwright.session import freeze, release, scratch_path

MAGIC = b"LWT1"
_HEAD = struct.Struct("<4sIQQ")
# Tokens of a block, or of a single document; bounds the memory of a task.
BLOCK_TOKENS = 1_000_000
# A file ends with the block that reaches this.
FILE_BYTES = 128 << 20
# Tokens in a range of documents, on average.
RANGE_TOKENS = 64 << 20
# Tasks that read the files back, at most.
READERS = 10_000

# Four lengths for each control byte.
LENGTHS = (1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)).astype(np.uint8)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each group of the given sizes."""
    return np.arange(counts.sum()) - np.repeat(_starts(counts), counts)


def coded(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Control bytes, data bytes, and how many of each every document has; `ranks` holds
    those of all documents in turn, `counts` how many each has."""
    lengths = np.ones(len(ranks), np.int64)
    for byte in (1, 2, 3):
        lengths += ranks >> np.uint32(8 * byte) > 0
    n_control = (counts + 3) // 4
    codes = np.zeros(4 * n_control.sum(), np.uint8)
    codes[np.repeat(4 * _starts(n_control), counts) + _within(counts)] = lengths - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    upto = np.concatenate([[0], np.cumsum(lengths)])
    data = np.empty(upto[-1], np.uint8)
    data[upto[:-1]] = ranks & np.uint32(255)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        data[upto[longer] + byte] = ranks[longer] >> np.uint32(8 * byte) & np.uint32(255)
    stops = np.cumsum(counts)
    return control, data, n_control, upto[stops] - upto[stops - counts]


def decoded(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents in turn."""
    slots = np.repeat(4 * _starts((counts + 3) // 4), counts) + _within(counts)
    lengths = LENGTHS[control].ravel()[slots].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    ranks = data[at].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        ranks[longer] |= data[at[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive runs of bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


def _stored_ids(
    docs: DataFrame, tokenizer: ByteLevel, width: np.dtype, end_id: int, key: str, text: str
) -> DataFrame:
    """Stored: `_key, _digest, n_tokens, ids, _row`."""
    library = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                rows = [
                    np.append(ids, np.uint32(end_id)).astype(width).tobytes()
                    for ids in library.value.ids([x or "" for x in texts])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(rows)),
                        pa.array([hashlib.md5(x).digest() for x in rows], pa.binary()),
                        pa.array([len(x) // width.itemsize for x in rows], pa.int64()),
                        pa.array(rows, pa.binary()),
                    ],
                    names=["_key", "_digest", "n_tokens", "ids"],
                )

    given = docs.select(docs[key].cast("long").alias("_key"), docs[text].alias("_text"))
    rows = given.mapInArrow(run, "_key long, _digest binary, n_tokens long, ids binary")
    return freeze(rows.withColumn("_row", F.monotonically_increasing_id()), "token-ids", "zstd")


def _by_frequency(rows: DataFrame, width: np.dtype, size: int) -> np.ndarray:
    """All ids of the vocabulary by falling frequency, equal ones ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(ids, width), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["id", "n"])

    counted = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    # Not more rows than the vocabulary has entries.
    for row in counted.collect():
        counts[row["id"]] = row["n"]
    return np.argsort(-counts, kind="stable").astype("<u4")


def _coded_rows(rows: DataFrame, ids_by_rank: np.ndarray, width: np.dtype) -> DataFrame:
    """`_key, _digest, _row, n_tokens, control, data` of every document."""
    order = rows.sparkSession.sparkContext.broadcast(ids_by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.empty(len(order.value), np.uint32)
        rank[order.value] = np.arange(len(rank), dtype=np.uint32)
        for batch in batches:
            counts = batch.column(3).to_numpy(zero_copy_only=False)
            for start, stop in slices(counts.tolist(), BLOCK_TOKENS):
                part = batch.slice(start, stop - start)
                ids = np.frombuffer(b"".join(part.column(4).to_pylist()), width)
                control, data, n_control, n_data = coded(rank[ids], counts[start:stop])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], _binary(control, n_control), _binary(data, n_data)],
                    names=["_key", "_digest", "_row", "n_tokens", "control", "data"],
                )

    return rows.select("_key", "_digest", "_row", "n_tokens", "ids").mapInArrow(
        run, "_key long, _digest binary, _row long, n_tokens long, control binary, data binary"
    )


def _block(keys: pa.Array, counts: np.ndarray, control: bytes, data: bytes) -> list[bytes]:
    return [
        _HEAD.pack(MAGIC, len(counts), len(control), len(data)),
        keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
        keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
        counts.astype("<u4").tobytes(),
        control,
        data,
    ]


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """Write the ordered partitions of `rows`; the manifest `part, seq, path, n_docs, n_tokens`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        out, path, part, seq = None, None, None, 0
        n_docs = n_tokens = n_bytes = 0

        def entry() -> pa.RecordBatch:
            values = [part, seq, path, n_docs, n_tokens]
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in values], names=["part", "seq", "path", "n_docs", "n_tokens"]
            )

        for batch in batches:
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            for start, stop in slices(counts.tolist(), BLOCK_TOKENS):
                rows = batch.slice(start, stop - start)
                if out is None:
                    part = rows.column(4)[0].as_py()
                    path = f"{base}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.lwt"
                    out, n_docs, n_tokens, n_bytes = target.open_output_stream(path), 0, 0, 0
                sections = _block(
                    rows.column(0),
                    counts[start:stop],
                    b"".join(rows.column(2).to_pylist()),
                    b"".join(rows.column(3).to_pylist()),
                )
                for section in sections:
                    out.write(section)
                    n_bytes += len(section)
                n_docs += stop - start
                n_tokens += int(counts[start:stop].sum())
                if n_bytes >= FILE_BYTES:
                    out.close()
                    yield entry()
                    out, seq = None, seq + 1
        if out is not None:
            out.close()
            yield entry()

    return (
        rows.withColumn("_part", F.spark_partition_id())
        .select("_key", "n_tokens", "control", "data", "_part")
        .mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long")
    )


@dataclass
class TokenFiles:
    """Written files: `manifest` has a row per file, in order of `part, seq`, with
    `first`, the tokens of all files before it."""

    folder: str
    manifest: DataFrame
    size: int


def write(
    docs: DataFrame,
    tokenizer: ByteLevel,
    end_id: int,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> TokenFiles:
    """Encode all documents, end each with `end_id`, and write them in ascending order.

    `folder` is a URI that every executor can write to; by default a new one in the
    shared scratch folder.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    size = max(tokenizer.size, end_id + 1)
    width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    rows = _stored_ids(docs, tokenizer, width, end_id, key, text)
    ids_by_rank = _by_frequency(rows, width, size)
    target, base = fs.FileSystem.from_uri(folder)
    target.create_dir(base, recursive=True)
    with target.open_output_stream(f"{base}/ranks.u32") as out:
        out.write(ids_by_rank.tobytes())
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_key").asc_nulls_first(), F.col("_digest"), F.col("_row")]
    laid = (
        _coded_rows(rows, ids_by_rank, width)
        .repartitionByRange(max(parallel, -(-total // RANGE_TOKENS)), *order)
        .sortWithinPartitions(*order)
    )
    written = freeze(_written(laid, folder), "token-manifest")
    release(rows)
    firsts = running_totals(written, ["part", "seq"], {"n_tokens": F.sum("n_tokens")})
    manifest = freeze(
        written.join(
            firsts.select("part", "seq", F.col("n_tokens_before").cast("long").alias("first")), ["part", "seq"]
        ),
        "token-manifest",
    )
    return TokenFiles(folder, manifest, size)


def _blocks(source, ids_by_rank: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, token counts and ids of every block of an open file."""
    while head := source.read(_HEAD.size):
        magic, n_docs, n_control, n_data = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a block of a token file")
        valid = np.frombuffer(source.read(n_docs), np.uint8) == 0
        keys = pa.array(np.frombuffer(source.read(8 * n_docs), "<i8"), mask=valid)
        counts = np.frombuffer(source.read(4 * n_docs), "<u4").astype(np.int64)
        control = np.frombuffer(source.read(n_control), np.uint8)
        data = np.frombuffer(source.read(n_data), np.uint8)
        yield keys, counts, ids_by_rank[decoded(control, data, counts)]


def read(
    files: TokenFiles,
    column: str = "ids",
    kind: pa.DataType | None = None,
    make: Callable[[np.ndarray], object] | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """`key, start, n_tokens` and the ids of every document as array<int>, or under
    another name and type what `make` makes of them, unsigned 32-bit and in order."""
    from pyspark.sql.pandas.types import from_arrow_type

    kind = kind or pa.list_(pa.int32())
    make = make or (lambda ids: ids.astype(np.int32))
    folder = files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = fs.FileSystem.from_uri(folder)
        with source.open_input_stream(f"{base}/ranks.u32") as table:
            ids_by_rank = np.frombuffer(table.read(), "<u4")
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with source.open_input_stream(path) as file:
                    for keys, counts, ids in _blocks(file, ids_by_rank):
                        starts = _starts(counts)
                        made = [make(ids[i : i + n]) for i, n in zip(starts, counts, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(starts + first), pa.array(counts), pa.array(made, kind)],
                            names=[key, "start", "n_tokens", column],
                        )
                        first += int(counts.sum())

    tasks = min(READERS, max(1, files.manifest.count()))
    schema = f"`{key}` long, start long, n_tokens long, `{column}` {from_arrow_type(kind).simpleString()}"
    return files.manifest.select("path", "first").repartition(tasks).mapInArrow(run, schema)


def checksum(ids: np.ndarray) -> int:
    """crc32 of the ids as unsigned 32-bit numbers, least byte first."""
    return zlib.crc32(ids.astype("<u4").tobytes())
