"""Exact top-k inner products.

Vectors become integers, floor(256 x). They are ranged by descending length into packed
blocks, so that the first blocks raise every query's k-th best score early. Each vector is
also kept rotated by the eigenvectors of the second-moment matrix (the right singular
vectors of the data), which puts most of every product into the leading coordinates. A
block is skipped for a group of queries when the product of lengths cannot reach their
scores; inside a block, the partial product over the leading coordinates plus the
Cauchy-Schwarz bound on the rest decides which products are computed, exactly and on the
integers.

Defined cases: vectors that are null or hold null or non-finite components take no part.
Shorter vectors count as padded with zeros; an empty vector scores 0 with all. Repeated
rows are candidates of their own; rows with the query's id are never its candidates. Ties
go to the smaller id. An empty table gives an empty result. Extra columns are ignored.
Components beyond 2**31 and products beyond 2**53 are refused rather than rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.session import freeze

SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 1024
BLOCKS_PER_KEY = 4
# Share of the squared length that the leading coordinates should hold.
LEADING = 0.8
_PACKED = "n int, top double, ids binary, vectors binary"
_SCORES = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """`vec_id, v, length2` of the vectors that take part."""
    v = vectors[vector]
    sound = v.isNotNull() & F.forall(
        v,
        lambda x: x.isNotNull()
        & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) != float("inf")),
    )
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return (
        vectors.filter(sound)
        .select(vectors[key].alias("vec_id"), whole.alias("v"))
        .withColumn("length2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        .filter("vec_id is not null")
    )


def _rows(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        full = np.zeros((len(ids), dim))
        full[np.repeat(np.arange(len(ids)), lengths), _within(lengths)] = flat
        yield ids, full


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _packed(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """The rows in their order, `size` to a packed block that stays inside its partition."""

    def run(batches):
        def block(ids, vectors):
            top = float(np.sqrt((vectors**2).sum(axis=1).max()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([len(ids)], pa.int32()),
                    pa.array([top]),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([vectors.tobytes()], pa.binary()),
                ],
                names=["n", "top", "ids", "vectors"],
            )

        held_ids, held = np.zeros(0, np.int64), np.zeros((0, dim))
        for ids, vectors in _rows(batches, dim):
            held_ids, held = np.concatenate([held_ids, ids]), np.concatenate([held, vectors])
            while len(held_ids) >= size:
                yield block(held_ids[:size], held[:size])
                held_ids, held = held_ids[size:], held[size:]
        if len(held_ids):
            yield block(held_ids, held)

    return rows.select("vec_id", "v").mapInArrow(run, _PACKED)


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """The eigenvectors of the second-moment matrix, strongest first, and how many of them
    hold most of the squared length. dim x dim numbers reach the driver, whatever the rows.
    """

    def moments(batches):
        total = np.zeros((dim, dim))
        for _, vectors in _rows(batches, dim):
            total += vectors.T @ vectors
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(dim * dim), pa.int64()),
                pa.array(total.ravel()),
            ],
            names=["cell", "value"],
        )

    cells = (
        rows.select("vec_id", "v")
        .mapInArrow(moments, "cell long, value double")
        .groupBy("cell")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    matrix = np.zeros(dim * dim)
    for cell in cells:
        matrix[cell["cell"]] = cell["value"]
    values, basis = np.linalg.eigh(matrix.reshape(dim, dim))
    values = np.clip(values[::-1], 0, None)
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(basis[:, ::-1]), int(np.searchsorted(held, LEADING) + 1)


def _best(pairs: DataFrame, dim: int, k: int, basis: np.ndarray, leading: int) -> DataFrame:
    """The k best of each block for each query, of those that can still reach the query's
    floor; `pairs` holds a block of candidates beside a block of queries and their floors.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                c = np.frombuffer(row["vectors"]).reshape(-1, dim)
                qids = np.frombuffer(row["q_ids"], np.int64)
                q = np.frombuffer(row["q_vectors"]).reshape(-1, dim)
                floor = np.frombuffer(row["floors"]) if row["floors"] is not None else None
                out = _search(ids, c, qids, q, floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in out], names=["query_id", "vec_id", "score"]
                )

    def _search(ids, c, qids, q, floor):
        limit = np.abs(c).max(initial=0)
        if limit >= 2**31 or limit * np.abs(q).max(initial=0) * dim >= 2**53:
            raise ValueError("vector components are too large for exact products")
        rc, rq = c @ basis, q @ basis
        rest_c = np.sqrt((rc[:, leading:] ** 2).sum(axis=1))
        rest_q = np.sqrt((rq[:, leading:] ** 2).sum(axis=1))
        length_c = np.sqrt((c**2).sum(axis=1))
        length_q = np.sqrt((q**2).sum(axis=1))
        found = []
        for i in range(len(qids)):
            at = np.flatnonzero(ids != qids[i])
            best = -np.inf if floor is None else floor[i]
            # Room for rounding in the rotated products; the integer products are exact.
            slack = 1e-9 * (1 + length_q[i] * length_c.max(initial=0))
            if best > -np.inf:
                at = at[length_q[i] * length_c[at] + slack >= best]
                if len(at) == 0:
                    continue
                bound = rc[at, :leading] @ rq[i, :leading] + rest_c[at] * rest_q[i]
                at = at[bound + slack >= best]
            if len(at) == 0:
                continue
            score = np.rint(c[at] @ q[i]).astype(np.int64)
            order = np.lexsort((ids[at], -score))[:k]
            keep = order[score[order] >= best] if best > -np.inf else order
            found.append((np.full(len(keep), qids[i]), ids[at][keep], score[keep]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return pairs.mapInArrow(run, _SCORES)


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _with_floors(queries: DataFrame, best: DataFrame, k: int, dim: int) -> DataFrame:
    """Query blocks with each query's k-th best score so far (none yet: minus infinity)."""
    floors = (
        best.filter(F.col("rank") == k)
        .join(
            queries.select("q_block", F.col("q_ids")).mapInArrow(
                _ids, "q_block long, query_id long"
            ),
            "query_id",
        )
        .groupBy("q_block")
        .agg(F.collect_list(F.struct("query_id", "score")).alias("known"))
    )

    def attach(batches):
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            packed, least = [], []
            for ids, known in zip(columns["q_ids"], columns["known"], strict=True):
                score = {x["query_id"]: float(x["score"]) for x in known or ()}
                floor = np.array([score.get(i, -np.inf) for i in np.frombuffer(ids, np.int64).tolist()])
                packed.append(floor.tobytes())
                least.append(float(floor.min(initial=np.inf)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("q_block"),
                    batch.column("q_top"),
                    batch.column("q_ids"),
                    batch.column("q_vectors"),
                    pa.array(packed, pa.binary()),
                    pa.array(least),
                ],
                names=["q_block", "q_top", "q_ids", "q_vectors", "floors", "least"],
            )

    return queries.join(floors, "q_block", "left").mapInArrow(
        attach,
        "q_block long, q_top double, q_ids binary, q_vectors binary, floors binary, least double",
    )


def _ids(batches):
    for batch in batches:
        blocks, ids = [], []
        for block, packed in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
        ):
            own = np.frombuffer(packed, np.int64)
            ids.append(own)
            blocks.append(np.full(len(own), block))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(blocks) if blocks else np.zeros(0, np.int64)),
                pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)),
            ],
            names=["q_block", "query_id"],
        )


def top_products(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k best candidates of each query.

    `queries` is a condition on `vec_id` that names the query rows. Each block of
    candidates meets the blocks of queries that it can still serve, in an equi-join; a
    block is at most `BLOCK` rows of `dim` numbers.
    """
    rows = freeze(integers(vectors, key, vector), "vectors")
    asked = freeze(rows.filter(queries).dropDuplicates(["vec_id"]), "queries")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n_asked = asked.count()
    dim = max(1, size["dim"] or 1)
    basis, leading = rotation(rows, dim)

    n_blocks = max(1, -(-size["n"] // BLOCK))
    ranged = rows.repartitionByRange(n_blocks, F.col("length2").desc(), "vec_id")
    blocks = freeze(
        _packed(ranged.sortWithinPartitions(F.col("length2").desc(), "vec_id"), dim, BLOCK)
        .withColumn("block", F.monotonically_increasing_id() % 8_589_934_592 + F.spark_partition_id()),
        "blocks",
    )
    if not n_asked:
        return rows.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score long"
        )
    # Few, so packing them needs no shuffle: one partition for each block of queries.
    packed = freeze(
        _packed(asked.coalesce(-(-n_asked // QUERY_BLOCK)), dim, QUERY_BLOCK).withColumn(
            "raw", F.monotonically_increasing_id()
        ),
        "query-blocks",
    )
    numbered = packed.select("raw").withColumn(
        "q_block", F.row_number().over(Window.orderBy("raw")).cast("long")
    )
    asked_blocks = freeze(
        packed.join(numbered, "raw").select(
            "q_block",
            F.col("top").alias("q_top"),
            F.col("ids").alias("q_ids"),
            F.col("vectors").alias("q_vectors"),
        ),
        "query-blocks",
    )
    n_query_blocks = asked_blocks.count()
    # Blocks of queries are repeated, so that a join key has a few blocks of candidates.
    salts = max(1, blocks.count() // BLOCKS_PER_KEY)

    def paired(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        dealt = candidates.withColumns(
            {
                "q_block": F.explode(F.sequence(F.lit(1), F.lit(n_query_blocks)).cast("array<long>")),
                "salt": F.pmod(F.col("block"), F.lit(salts)),
            }
        )
        repeated = asking.withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))
        )
        return dealt.join(repeated, ["q_block", "salt"])

    longest = blocks.agg(F.max("top")).first()[0]
    first = blocks.filter(F.col("top") >= longest)
    seeds = freeze(
        _top(
            _best(
                paired(first, asked_blocks.withColumn("floors", F.lit(None).cast("binary"))),
                dim,
                k,
                basis,
                leading,
            ),
            k,
        ),
        "seeds",
    )
    asking = freeze(_with_floors(asked_blocks, seeds, k, dim), "asking")
    rest = paired(blocks.filter(F.col("top") < longest), asking).filter(
        F.col("top") * F.col("q_top") * (1 + 1e-9) >= F.col("least")
    )
    more = _best(rest, dim, k, basis, leading)
    return _top(seeds.drop("rank").unionByName(more), k)
