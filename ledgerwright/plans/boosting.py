"""Gradient boosting on histograms, continued from stored margins.

Features are cut once into bins of near equal numbers of rows, from exact counts of all
values. Features of few bins share a byte, as digits of one number (a code), and the sums
of a feature's bins are those of the codes, added up. A job then grows several trees: its
tasks hold their rows, sum gradients and Hessians per node, feature and bin, and exchange
only those sums (a barrier stage), so that every task finds the same splits. Of two
children only the smaller one is summed; its sibling is the parent less that. At the end of
a job the margin of every row is stored and the next job starts from there: no tree is
grown twice, and a lost executor costs the trees of one job.

Sums are exchanged through files in the shared scratch folder, as Spark's own `allGather`
looks for the answer once a second, six times for each tree. It is used where Python cannot
open that folder.

Gradients are multiples of 2^-28, summed as 64-bit integers, exact in any order. The model
therefore does not depend on how rows are dealt out, and a difference of sums is the sum
itself.

After each job the new trees score the validation rows, which are not part of the barrier
stage, and the average precision of every round is computed distributed:
precision only counts where a positive row stands, so the tasks get the margins of the
positive rows and count their own rows between them. What is shuffled are those counts, not
a row per validation row and round; that is the way beyond `POSITIVES_SENT`.

All training rows are used. Up to a documented number the tasks hold them in memory, more in
mapped files of their own, which the system writes out as it needs to.

A row finds its leaf without walking the tree: every code has the set of leaves that it
leaves open, as bits, and the first leaf that all codes of the row leave open is its own.
"""

from __future__ import annotations

import base64
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.operators.ordered import running_totals
from ledgerwright.plans.metrics import average_precision
from ledgerwright.session import freeze, release, remove, scratch_path

# Bins of a feature, and codes of features that share a byte.
BINS = 256
# Training rows that all tasks together hold in memory; more are held in mapped files.
LABELLED_ROWS = 8_000_000
# Training rows that are worth a task of their own.
TASK_ROWS = 150_000
# Rows of a block; sums of a block are exact up to weights of 2^10.
BLOCK_ROWS = 1 << 14
# Rows that are scored at once, and validation rows that are ordered at once.
SCORED_ROWS = 1 << 14
ORDERED_ROWS = 1 << 18
# Margins of positive validation rows, over the rounds of a job, that are sent to every task.
POSITIVES_SENT = 8_000_000
# Trees of one job.
JOB_ROUNDS = 75
# Gradients are whole numbers of steps, this many to one.
_GRAIN = float(1 << 28)
# Leaves that a set of bits can tell apart.
_LEAVES = 64
# Splits that gain less are rounding.
_LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """Parameters of the ensemble; `scale` is the weight of positive rows."""

    rounds: int = 1200
    rate: float = 0.03
    depth: int = 6
    least_weight: float = 5.0
    row_share: float = 0.8
    column_share: float = 0.8
    l1: float = 0.1
    l2: float = 2.0
    scale: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """A binary tree as arrays: node i has the children 2i + 1 and 2i + 2.

    A row goes right where its bin of `feature` exceeds `cut`; a node without a feature
    (-1) adds `value` to the margin. `gain` is what each split gained.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node in which every row of `bins` (rows, features) ends."""
        ends = self.feature < 0
        feature = np.where(ends, 0, self.feature)
        # No bin is above the last one: a row stays in a node without a feature.
        cut = np.where(ends, BINS, self.cut)
        left = np.where(ends, np.arange(len(ends)), 2 * np.arange(len(ends)) + 1)
        flat = np.ascontiguousarray(bins).ravel()
        row = np.arange(len(bins)) * bins.shape[1]
        node = np.zeros(len(bins), np.int64)
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            right = flat.take(row + feature.take(node)) > cut.take(node)
            node = left.take(node) + right
        return node

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(bins)]

    def packed(self) -> bytes:
        return np.concatenate([self.feature, self.cut, self.value, self.gain]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        feature, cut, value, gain = np.frombuffer(data, "<f8").reshape(4, -1)
        return cls(feature.astype(np.int64), cut.astype(np.int64), value, gain)


@dataclass(frozen=True)
class Packing:
    """Which features share a code: per group its features, the first one the lowest digit.

    `sizes` are the bins of every feature; those of a group multiply to `BINS` at most.
    """

    sizes: tuple[int, ...]
    groups: tuple[tuple[int, ...], ...]

    @classmethod
    def of(cls, sizes: Sequence[int]) -> Packing:
        """Features by falling number of bins, each to the first group with room for it."""
        groups: list[list[int]] = []
        for feature in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for group in groups:
                if math.prod(sizes[i] for i in group) * sizes[feature] <= BINS:
                    group.append(feature)
                    break
            else:
                groups.append([feature])
        return cls(tuple(sizes), tuple(map(tuple, groups)))

    @cached_property
    def places(self) -> list[tuple[int, int]]:
        """Group of every feature, and what its bins are multiplied by."""
        found = [(0, 1)] * len(self.sizes)
        for number, group in enumerate(self.groups):
            stride = 1
            for feature in group:
                found[feature] = (number, stride)
                stride *= self.sizes[feature]
        return found

    def width(self, group: int) -> int:
        """How many codes a group has."""
        return math.prod(self.sizes[i] for i in self.groups[group])

    def bins_of_codes(self, feature: int) -> np.ndarray:
        """The feature's bin for every code of its group."""
        return np.arange(BINS) // self.places[feature][1] % self.sizes[feature]

    def unpacked(self, codes: np.ndarray) -> np.ndarray:
        """Bins (rows, features) of `codes` (groups, rows)."""
        out = np.empty((codes.shape[1], len(self.sizes)), np.uint8)
        for feature, (group, _) in enumerate(self.places):
            out[:, feature] = self.bins_of_codes(feature)[codes[group]]
        return out

    def sums_of_bins(self, sums: Sequence[np.ndarray], columns: np.ndarray) -> np.ndarray:
        """From sums per code (kinds, nodes, codes) of the groups of `columns`, in turn, the
        sums of the bins of these features, one feature after the other."""
        at = {group: i for i, group in enumerate(self.groups_of(columns))}
        parts = []
        for feature in columns:
            group, _ = self.places[feature]
            members = self.groups[group]
            given = sums[at[group]]
            # The first feature of a group is the last axis.
            cube = given.reshape(*given.shape[:2], *[self.sizes[i] for i in reversed(members)])
            axis = 1 + len(members) - members.index(feature)
            parts.append(cube.sum(axis=tuple(a for a in range(2, cube.ndim) if a != axis)))
        return np.concatenate(parts, axis=2)

    def groups_of(self, columns: np.ndarray) -> list[int]:
        return sorted({self.places[i][0] for i in columns})


@dataclass
class Scorer:
    """A tree as tables: per group of features that it uses the leaves left open by every
    code, the first leaf the lowest bit, and the value of every leaf.

    The last leaf has no bit, as it is what remains. Leaves below a node without a feature
    all have its value. Deeper trees than `_LEAVES` allows are walked.
    """

    open: list[tuple[int, np.ndarray]]
    values: np.ndarray
    walked: tuple[Tree, Packing] | None = None

    @classmethod
    def of(cls, tree: Tree, packing: Packing) -> Scorer:
        leaves = (len(tree.feature) + 1) // 2
        if leaves > _LEAVES:
            return cls([], np.zeros(0), (tree, packing))
        every = (1 << (leaves - 1)) - 1
        tables: dict[int, np.ndarray] = {}
        node = np.zeros(leaves, np.int64)
        width, first = leaves, 0
        while width > 1:
            for i in range(leaves // width):
                at = first + i
                feature = int(tree.feature[at])
                # Nodes below one without a feature have none either.
                if feature < 0:
                    continue
                left = ((1 << (width // 2)) - 1) << (i * width)
                table = tables.setdefault(packing.places[feature][0], np.full(BINS, every, np.int64))
                table[packing.bins_of_codes(feature) > tree.cut[at]] &= every & ~left
                node[i * width : (i + 1) * width] = np.repeat([2 * at + 1, 2 * at + 2], width // 2)
            first, width = 2 * first + 1, width // 2
        # By the exponent of a leaf's bit as a floating point number; none has exponent 0.
        values = np.zeros(1023 + _LEAVES)
        values[1023 : 1023 + leaves - 1] = tree.value[node[:-1]]
        values[0] = tree.value[node[-1]]
        return cls(sorted(tables.items()), values)


def add_margins(scorers: Sequence[Scorer], codes: np.ndarray, margin: np.ndarray, each=None) -> None:
    """Adds to the margins of rows what each of the trees says, in turn. `each` is called
    after every tree with its number, when `codes` (groups, rows) are `SCORED_ROWS` at most."""
    for start in range(0, codes.shape[1], SCORED_ROWS):
        part = codes[:, start : start + SCORED_ROWS]
        index = part.astype(np.intp)
        sums = margin[start : start + SCORED_ROWS]
        left, bits, found = (np.empty(len(sums), t) for t in (np.int64, np.int64, np.float64))
        for number, scorer in enumerate(scorers):
            if scorer.walked:
                tree, packing = scorer.walked
                sums += tree.margin(packing.unpacked(part))
            elif not scorer.open:
                sums += scorer.values[0]
            else:
                (group, table), *others = scorer.open
                np.take(table, index[group], out=left, mode="clip")
                for group, table in others:
                    np.take(table, index[group], out=bits, mode="clip")
                    np.bitwise_and(left, bits, out=left)
                np.negative(left, out=bits)
                np.bitwise_and(left, bits, out=left)
                np.copyto(found, left)
                np.right_shift(found.view(np.int64), 52, out=bits)
                np.take(scorer.values, bits, out=found, mode="clip")
                sums += found
            if each:
                each(number)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def sampled(keys: np.ndarray, number: int, settings: Settings) -> np.ndarray:
    """Whether a tree sees a row: decided by tree and row alone, so that any task can tell."""
    salt = _mixed(np.array([number * 2 + 1, settings.seed], np.uint64))
    drawn = _mixed(keys ^ salt[0] ^ (salt[1] << np.uint64(1)))
    return (drawn >> np.uint64(11)) * 2.0**-53 < settings.row_share


def columns_of(number: int, n_features: int, settings: Settings) -> np.ndarray:
    """The features that a tree may use, ascending."""
    drawn = np.random.default_rng([settings.seed, number]).permutation(n_features)
    return np.sort(drawn[: max(1, int(settings.column_share * n_features))])


def gradients(
    margin: np.ndarray, label: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted logistic loss, in whole steps."""
    p = 1.0 / (1.0 + np.exp(-margin))
    weight = np.where(label > 0, settings.scale, 1.0)
    first, second = (p - label) * weight, p * (1.0 - p) * weight
    return np.round(first * _GRAIN), np.round(second * _GRAIN)


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(g: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    return _shrunk(g, settings.l1) ** 2 / (h + settings.l2)


def _running(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums of the bins of every feature; `starts` is where each feature begins."""
    running = np.cumsum(sums, axis=2)
    before = running[:, :, starts[1:] - 1]
    widths = np.diff([*starts, sums.shape[2]])
    running[:, :, starts[1] if len(starts) > 1 else sums.shape[2] :] -= np.repeat(before, widths[1:], axis=2)
    return running


def best_splits(
    running: np.ndarray, starts: np.ndarray, columns: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin on the left, gain and sums on the left (2, nodes) for every node of
    `running` (2, nodes, bins of all columns); feature -1 where no split gains. The first
    feature and bin win ties."""
    end = (starts[1] if len(starts) > 1 else running.shape[2]) - 1
    steps = running[:, :, end : end + 1]
    left, right, total = running / _GRAIN, (steps - running) / _GRAIN, steps / _GRAIN
    gain = (
        _score(left[0], left[1], settings)
        + _score(right[0], right[1], settings)
        - _score(total[0], total[1], settings)
    ) / 2
    allowed = (left[1] >= settings.least_weight) & (right[1] >= settings.least_weight)
    flat = np.where(allowed, gain, -np.inf)
    best = flat.argmax(axis=1)
    nodes = np.arange(len(best))
    gains = flat[nodes, best]
    at = np.searchsorted(starts, best, side="right") - 1
    return np.where(gains > _LEAST_GAIN, columns[at], -1), best - starts[at], gains, running[:, nodes, best]


class _Rows:
    """A block of training rows of a task, and the rows of it that a tree sees.

    All that is kept from level to level is in one buffer, in memory or mapped.
    """

    def __init__(self, row: dict, n_groups: int, buffer: Callable[[int], np.ndarray]):
        n = len(row["label"])
        parts = [
            ("codes", "u1", n_groups), ("picked", "u1", n_groups), ("label", "u1", 1),
            ("keys", "<u8", 1), ("margin", "<f8", 1), ("g", "<f8", 1), ("h", "<f8", 1),
            ("_at", "<i4", 1), ("_place", "<i4", 1),
        ]
        # Eight bytes a row at most come first, so that all stays aligned.
        parts.sort(key=lambda part: -np.dtype(part[1]).itemsize)
        held, start = buffer(sum(np.dtype(kind).itemsize * times for _, kind, times in parts) * n), 0
        for name, kind, times in parts:
            stop = start + np.dtype(kind).itemsize * times * n
            setattr(self, name, held[start:stop].view(kind))
            start = stop
        self.codes = self.codes.reshape(n_groups, n)
        self.codes[:] = np.frombuffer(row["bins"], np.uint8).reshape(n_groups, n)
        self.label[:] = np.frombuffer(row["label"], np.uint8)
        self.keys[:] = np.frombuffer(row["row_key"], "<u8")
        self.margin[:] = np.frombuffer(row["margin"], "<f8")
        self.seen = self.left = 0

    def begin(self, number: int, settings: Settings) -> None:
        """The rows that a tree sees, all in its root."""
        seen = np.flatnonzero(sampled(self.keys, number, settings))
        self.seen = self.left = len(seen)
        g, h = gradients(self.margin[seen], self.label[seen].astype(np.float64), settings)
        self.g[: self.seen], self.h[: self.seen] = g, h
        for group, codes in enumerate(self.codes):
            self.picked[group * self.seen : (group + 1) * self.seen] = codes[seen]
        self._at[: self.seen] = np.arange(self.seen)
        self._place[: self.seen] = 0

    def descend(self, split_of: np.ndarray, group: np.ndarray, goes_right: np.ndarray, wanted: np.ndarray):
        """Moves rows to the children of their nodes; rows of nodes that do not split are
        left out from now on. The rows whose child is `wanted` for its node, and which.

        `split_of` numbers the nodes that split, which are decided by a code of `group` each.
        """
        at, place = self._at[: self.left].astype(np.intp), split_of[self._place[: self.left]]
        if len(group) < len(split_of):
            inside = place >= 0
            at, place = at[inside], place[inside]
            self.left = len(at)
            self._at[: self.left] = at
        code = self.picked.take(group.take(place) * self.seen + at)
        goes = goes_right.take(place * BINS + code)
        self._place[: self.left] = 2 * place + goes
        held = np.flatnonzero(goes == wanted.take(place))
        return at[held], place[held]

    def sums(self, rows: np.ndarray | None, place: np.ndarray | None, n: int, groups, packing: Packing):
        """Per group the sums of both derivatives per place and code, in steps; all rows
        seen are in place 0 if `rows` is None."""
        g, h = self.g[: self.seen], self.h[: self.seen]
        if rows is not None:
            g, h = g.take(rows), h.take(rows)
        for group in groups:
            codes, width = self.picked[group * self.seen : (group + 1) * self.seen], packing.width(group)
            key = codes.astype(np.intp) if rows is None else place * width + codes.take(rows)
            # Whole numbers below 2^53, so far.
            yield np.array([np.bincount(key, x, n * width) for x in (g, h)]).astype(np.int64).reshape(2, n, width)


def _added_up(blocks: list[_Rows], found: Iterable, n: int, columns: np.ndarray, packing: Packing) -> np.ndarray:
    groups = packing.groups_of(columns)
    totals = [np.zeros((2, n, packing.width(group)), np.int64) for group in groups]
    for block, (rows, place) in zip(blocks, found, strict=True):
        for total, part in zip(totals, block.sums(rows, place, n, groups, packing), strict=True):
            total += part
    return packing.sums_of_bins(totals, columns)


def grow(
    blocks: list[_Rows],
    columns: np.ndarray,
    packing: Packing,
    settings: Settings,
    summed: Callable[[np.ndarray], np.ndarray],
) -> Tree:
    """A tree from the rows of this task that it sees; `summed` adds an array over all tasks."""
    n_nodes = 2 ** (settings.depth + 1) - 1
    tree = Tree(
        np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes), np.zeros(n_nodes)
    )
    starts = np.cumsum([0, *[packing.sizes[i] for i in columns[:-1]]])
    nodes = np.zeros(1, np.int64)
    # Sums of the nodes to be split, filled from the smaller child and its sibling.
    sums = summed(_added_up(blocks, [(None, None)] * len(blocks), 1, columns, packing))
    totals = sums[:, :, : packing.sizes[columns[0]]].sum(axis=2)
    tree.value[0] = _leaf_value(totals, settings)[0]
    for depth in range(settings.depth):
        feature, cut, gain, on_left = best_splits(_running(sums, starts), starts, columns, settings)
        split = feature >= 0
        if not split.any():
            break
        parents = nodes[split]
        tree.feature[parents], tree.cut[parents], tree.gain[parents] = feature[split], cut[split], gain[split]
        left = on_left[:, split]
        right = totals[:, split] - left
        children = np.stack([2 * parents + 1, 2 * parents + 2], axis=1)
        child_totals = np.stack([left, right], axis=2)
        tree.value[children] = _leaf_value(child_totals, settings)
        if depth + 1 == settings.depth:
            break
        n = len(parents)
        split_of = np.full(len(nodes), -1)
        split_of[split] = np.arange(n)
        group = np.array([packing.places[i][0] for i in feature[split]])
        goes_right = np.concatenate(
            [packing.bins_of_codes(i) > c for i, c in zip(feature[split], cut[split], strict=True)]
        )
        smaller = right[1] < left[1]
        # One block after the other, as its sums are taken.
        found = (block.descend(split_of, group, goes_right, smaller) for block in blocks)
        part = summed(_added_up(blocks, found, n, columns, packing))
        both = np.empty((2, n, 2, part.shape[2]), np.int64)
        which, lesser = np.arange(n), smaller.astype(np.int64)
        both[:, which, lesser] = part
        both[:, which, 1 - lesser] = sums[:, split] - part
        sums = both.reshape(2, 2 * n, -1)
        totals = child_totals.reshape(2, -1)
        nodes = children.ravel()
    return tree


def _leaf_value(totals: np.ndarray, settings: Settings) -> np.ndarray:
    g, h = totals / _GRAIN
    return -settings.rate * _shrunk(g, settings.l1) / (h + settings.l2)


def borders(rows: DataFrame, names: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature the least value of every bin but the first, at most `bins` - 1.

    Values are counted exactly; a bin takes the next values until it has its share of the
    rows, and equal values stay together.
    """
    cells = F.array(
        *[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)]
    )
    values = rows.select(F.explode(cells).alias("cell")).select("cell.*").filter("value is not null")
    counted = running_totals(values, ["value"], {"n": F.count(F.lit(1))}, by=["feature"])
    # Not more rows than bins of all features.
    found = (
        counted.withColumn("bin", F.expr(f"n_before * {bins} div n_all"))
        .groupBy("feature", "bin")
        .agg(F.min("value").alias("least"))
        .collect()
    )
    least = [sorted(r["least"] for r in found if r["feature"] == i) for i in range(len(names))]
    return [np.array(x[1:], np.float64) for x in least]


def _codes(batch: pa.RecordBatch, first: int, cuts: Sequence[np.ndarray], packing: Packing) -> np.ndarray:
    """The codes of a batch's feature columns, (groups, rows); a null is the least value."""
    out = np.zeros((len(packing.groups), batch.num_rows), np.uint8)
    for i, (cut, (group, stride)) in enumerate(zip(cuts, packing.places, strict=True)):
        values = batch.column(first + i).fill_null(-math.inf).to_numpy(zero_copy_only=False)
        out[group] += (np.searchsorted(cut, values, side="right") * stride).astype(np.uint8)
    return out


_COLUMNS = ("bins", "label", "row_key", "margin")
_BLOCK = "bins binary, label binary, row_key binary, margin binary"


def _blocks(rows: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray], packing: Packing) -> DataFrame:
    """Rows as blocks of bytes: codes by group, labels, hashes of the ids and margins of 0."""

    def made(codes: np.ndarray, label: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        values = [codes.tobytes(), label.tobytes(), keys.tobytes(), np.zeros(len(label), "<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=list(_COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype("<i8")
            held.append((_codes(batch, 2, cuts, packing), label, keys))
            n += len(label)
            if n >= BLOCK_ROWS:
                joined = [np.concatenate(x, axis=-1) for x in zip(*held, strict=True)]
                whole = n - n % BLOCK_ROWS
                for i in range(0, whole, BLOCK_ROWS):
                    yield made(*[np.ascontiguousarray(x[..., i : i + BLOCK_ROWS]) for x in joined])
                held, n = [tuple(np.ascontiguousarray(x[..., whole:]) for x in joined)], n - whole
        if n:
            yield made(*[np.concatenate(x, axis=-1) for x in zip(*held, strict=True)])

    key = F.xxhash64("transaction_id").alias("_key")
    return rows.select("label", key, *[F.col(c).cast("double") for c in names]).mapInArrow(run, _BLOCK)


class _Exchange:
    """Sums over the tasks of a barrier stage, by a file of each task for each sum.

    A task that has all files of a sum knows that the others have read those of the sum
    before, and deletes its own.
    """

    def __init__(self, folder: str, task):
        self.files, path = pafs.FileSystem.from_uri(folder)
        # A stage that is tried again must not meet the files of the first attempt, so that its
        # tasks agree on a name, by the slow exchange.
        self.path = f"{path}/{task.allGather(uuid.uuid4().hex)[0]}"
        self.files.create_dir(self.path, recursive=True)
        self.mine, self.tasks, self.number = task.partitionId(), len(task.getTaskInfos()), 0

    def _name(self, number: int, task: int) -> str:
        return f"{self.path}/{number}-{task}"

    def __call__(self, values: np.ndarray) -> np.ndarray:
        own = self._name(self.number, self.mine)
        with self.files.open_output_stream(f"{own}.new") as out:
            out.write(values.tobytes())
        # A file under its final name is whole.
        self.files.move(f"{own}.new", own)
        total = values.copy()
        for other in range(self.tasks):
            if other != self.mine:
                total += np.frombuffer(self._read(self._name(self.number, other)), values.dtype).reshape(values.shape)
        if self.number:
            self.files.delete_file(self._name(self.number - 1, self.mine))
        self.number += 1
        return total

    def _read(self, name: str) -> bytes:
        pause = 0.0002
        while True:
            try:
                with self.files.open_input_stream(name) as given:
                    return given.read()
            except FileNotFoundError:
                time.sleep(pause)
                pause = min(2 * pause, 0.01)


def _exchange_folder(spark: SparkSession) -> str | None:
    """A new shared folder, if Python can open it."""
    path = scratch_path(spark, "boosting-sums")
    try:
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
    except (pa.ArrowException, OSError):
        return None
    return path


def _gathered(task, values: np.ndarray) -> np.ndarray:
    """`values` summed over the tasks of the barrier stage, by Spark's own exchange."""
    said = task.allGather(base64.b64encode(values.tobytes()).decode())
    return sum(np.frombuffer(base64.b64decode(x), values.dtype) for x in said).reshape(values.shape)


def _mapped() -> Callable[[int], np.ndarray]:
    """Buffers in files that are mapped into memory, and gone with the task."""

    def made(n: int) -> np.ndarray:
        with tempfile.TemporaryFile() as file:
            return np.memmap(file, np.uint8, "w+", shape=(max(1, n),))[:n]

    return made


def continued(
    blocks: DataFrame,
    packing: Packing,
    first: int,
    count: int,
    settings: Settings,
    folder: str | None = None,
    in_memory: bool = True,
) -> DataFrame:
    """`blocks` after `count` more trees, numbered from `first`; one row has `trees`.

    Tasks exchange their sums in `folder`, or through Spark without one.
    """
    n_groups = len(packing.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        task = BarrierTaskContext.get()
        if len(task.getTaskInfos()) == 1:
            summed = lambda x: x
        elif folder:
            summed = _Exchange(folder, task)
        else:
            summed = lambda x: _gathered(task, x)
        buffer = (lambda n: np.empty(n, np.uint8)) if in_memory else _mapped()
        rows = [_Rows(r, n_groups, buffer) for batch in batches for r in batch.select(list(_COLUMNS)).to_pylist()]
        trees = []
        for number in range(first, first + count):
            for block in rows:
                block.begin(number, settings)
            tree = grow(rows, columns_of(number, len(packing.sizes), settings), packing, settings, summed)
            scorer = [Scorer.of(tree, packing)]
            for block in rows:
                add_margins(scorer, block.codes, block.margin)
            trees.append(tree.packed())
        for block in rows:
            values = [x.tobytes() for x in (block.codes, block.label, block.keys, block.margin)]
            yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, values, strict=True)) | {"trees": None}], schema=schema)
        if task.partitionId() == 0:
            yield pa.RecordBatch.from_pylist([dict.fromkeys(_COLUMNS, b"") | {"trees": trees}], schema=schema)

    schema = pa.schema([*[(c, pa.binary()) for c in _COLUMNS], ("trees", pa.list_(pa.binary()))])
    return blocks.mapInArrow(run, f"{_BLOCK}, trees array<binary>", barrier=True)


@contextmanager
def _block_by_block(spark: SparkSession) -> Iterator[None]:
    """Blocks go to Python one by one, not all blocks of a task at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rows_of(row: dict, packing: Packing, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and margins of a block's rows, or of some of them."""
    codes = np.frombuffer(row["bins"], np.uint8).reshape(len(packing.groups), -1)
    margin = np.frombuffer(row["margin"], "<f8").copy()
    return (codes, margin) if only is None else (codes[:, only], margin[only])


def _steps(row: dict, scorers: list[Scorer], packing: Packing, only: np.ndarray | None = None) -> np.ndarray:
    """The margins of a block's rows, or of some of them, after each of the trees."""
    codes, margin = _rows_of(row, packing, only)
    out = np.empty((len(scorers), len(margin)))
    for start in range(0, len(margin), SCORED_ROWS):
        part = margin[start : start + SCORED_ROWS]

        def kept(number: int, part=part, start=start) -> None:
            out[number, start : start + len(part)] = part

        add_margins(scorers, codes[:, start : start + SCORED_ROWS], part, kept)
    return out


def _positive_margins(
    blocks: DataFrame, scorers: list[Scorer], packing: Packing
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per round the distinct margins of the positive rows, ascending, and how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = np.flatnonzero(np.frombuffer(row["label"], np.uint8))
                if len(held):
                    steps = _steps(row, scorers, packing, held)
                    yield pa.RecordBatch.from_arrays([pa.array([steps.tobytes()], pa.binary())], names=["steps"])

    # At most `POSITIVES_SENT` values, as the caller has counted.
    found = blocks.mapInArrow(run, "steps binary").collect()
    parts = [np.frombuffer(r["steps"], "<f8").reshape(len(scorers), -1) for r in found]
    margins = np.concatenate([np.zeros((len(scorers), 0)), *parts], axis=1)
    return [np.unique(x, return_counts=True) for x in margins]


def counts_between(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many of `values` are below the first of the ascending `known`, from there to the
    second, and so on."""
    if len(known) >= len(values):
        return np.bincount(np.searchsorted(known, values, side="right"), minlength=len(known) + 1)
    below = np.searchsorted(np.sort(values), known, side="left")
    return np.diff(below, prepend=0, append=len(values))


def _counted(blocks: DataFrame, scorers: list[Scorer], packing: Packing, known) -> DataFrame:
    """`blocks` of validation rows after the trees, and per task and round a row with how many
    of its rows are below the first of the `known` margins, from there to the second, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = [x for x, _ in known.value]
        counts = [np.zeros(len(x) + 1, np.int64) for x in margins]

        def scored(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            given = [_rows_of(row, packing) for row in rows]
            for scorer, x, n in zip(scorers, margins, counts, strict=True):
                for codes, margin in given:
                    add_margins([scorer], codes, margin)
                n += counts_between(x, np.concatenate([margin for _, margin in given]))
            for row, (_, margin) in zip(rows, given, strict=True):
                made = [row["bins"], row["label"], row["row_key"], margin.tobytes(), None, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in zip(made, schema.types, strict=True)], schema=schema
                )

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if sum(len(r["label"]) for r in held) >= ORDERED_ROWS:
                    yield from scored(held)
                    held = []
        if held:
            yield from scored(held)
        for i, n in enumerate(counts):
            made = [b"", b"", b"", b"", i, n.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(made, schema.types, strict=True)], schema=schema
            )

    schema = pa.schema(
        [*[(c, pa.binary()) for c in _COLUMNS], ("round", pa.int64()), ("counts", pa.binary())]
    )
    return blocks.mapInArrow(run, f"{_BLOCK}, round long, counts binary")


def _precisions_of_counts(counted: DataFrame, known, count: int) -> list[float]:
    """The average precision of every round of a job, from the counts of its tasks."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("round")[0].as_py()
        _, times = known.value[number]
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        # Rows and positives at or above each margin.
        alerts = total[::-1].cumsum()[::-1][1:]
        hits = times[::-1].cumsum()[::-1]
        precision = float((times / max(1, times.sum()) * (hits / alerts)).sum())
        return pa.table({"round": pa.array([number], pa.int64()), "precision": pa.array([precision])})

    counts = counted.filter("round is not null").select("round", "counts")
    found = counts.groupBy("round").applyInArrow(run, "round long, precision double")
    precisions = {r["round"]: r["precision"] for r in found.collect()}
    return [precisions.get(i, 0.0) for i in range(count)]


def _validated(
    held_out: DataFrame, trees: list[Tree], first: int, packing: Packing, positives: int
) -> tuple[DataFrame, list[float]]:
    """Stored: the validation blocks after the trees; and the average precision of every round."""
    blocks = held_out.select(*_COLUMNS).filter(F.length("label") > 0)
    scorers = [Scorer.of(tree, packing) for tree in trees]
    with _block_by_block(held_out.sparkSession):
        if positives * len(trees) > POSITIVES_SENT:
            tried = freeze(_tried(blocks, scorers, packing), "boosting-validation", large_rows=True)
            return tried, _precisions(tried, first, len(trees))
        known = held_out.sparkSession.sparkContext.broadcast(_positive_margins(blocks, scorers, packing))
        counted = freeze(_counted(blocks, scorers, packing, known), "boosting-validation")
    found = _precisions_of_counts(counted, known, len(trees))
    known.unpersist()
    return counted, found


def _tried(blocks: DataFrame, scorers: list[Scorer], packing: Packing) -> DataFrame:
    """`blocks` of validation rows with their margins after each of the trees, in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                steps = _steps(row, scorers, packing)
                made = [row["bins"], row["label"], row["row_key"], steps[-1].astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([x], pa.binary()) for x in made],
                        pa.array([steps.ravel()], pa.list_(pa.float64())),
                    ],
                    names=[*_COLUMNS, "steps"],
                )

    return blocks.mapInArrow(run, f"{_BLOCK}, steps array<double>")


def _precisions(tried: DataFrame, first: int, count: int) -> list[float]:
    """The average precision of every round of a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(label)
                for i in range(count):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, first + i)),
                            pa.array(np.frombuffer(label, np.uint8).astype(np.int64)),
                            pa.array(steps[i * n : (i + 1) * n]),
                        ],
                        names=["round", "label", "score"],
                    )

    scored = tried.select("label", "steps").mapInArrow(run, "round long, label long, score double")
    found = {r["round"]: r["average_precision"] for r in average_precision(scored, ["round"]).collect()}
    return [found.get(first + i, 0.0) for i in range(count)]


@dataclass
class Ensemble:
    """Grown trees over binned features, and what validation said of every round."""

    names: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    precisions: tuple[float, ...] = ()

    @property
    def best_round(self) -> int:
        """How many trees the model keeps."""
        return len(self.trees)

    @property
    def best_score(self) -> float | None:
        return max(self.precisions) if self.precisions else None

    def importances(self) -> np.ndarray:
        """Each feature's share of the gain of all splits."""
        total = np.zeros(len(self.names))
        for tree in self.trees:
            used = tree.feature >= 0
            np.add.at(total, tree.feature[used], tree.gain[used])
        return total / (total.sum() or 1.0)

    def scored(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """`keep` of every row with its probability as `score`."""
        packing = Packing.of([len(cut) + 1 for cut in self.cuts])
        scorers = [Scorer.of(tree, packing) for tree in self.trees]
        model = rows.sparkSession.sparkContext.broadcast((self.cuts, packing, scorers))
        given = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.names)])
        n = len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, packing, scorers = model.value
            for batch in batches:
                margin = np.zeros(batch.num_rows)
                add_margins(scorers, _codes(batch, n, cuts, packing), margin)
                score = 1.0 / (1.0 + np.exp(-margin))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n], pa.array(score)], names=[*batch.schema.names[:n], "score"]
                )

        schema = given.select(*keep).schema.add("score", "double")
        return given.mapInArrow(run, schema)


def _bounded(train: DataFrame, most: int) -> tuple[DataFrame, int]:
    """All training rows, or of more than `most` a share by a hash of the id. Not for a fit,
    which takes every row."""
    n = train.count()
    if n <= most:
        return train, n
    bucket = F.pmod(F.xxhash64(F.lit("boosting"), "transaction_id"), F.lit(1 << 20))
    return train.filter(bucket < (most << 20) // n), most


def fit(
    train: DataFrame,
    validation: DataFrame | None,
    names: Sequence[str],
    settings: Settings,
    patience: int,
    labelled_rows: int = LABELLED_ROWS,
    job_rounds: int = JOB_ROUNDS,
    bins: int = BINS,
    tasks: int | None = None,
) -> Ensemble:
    """An ensemble over the feature columns `names`.

    Both tables have `transaction_id, label` and the features. With validation rows the
    ensemble ends at the round of the best average precision, and boosting ends when
    `patience` rounds have not improved on it. All training rows are used; up to
    `labelled_rows` the tasks hold them in memory, more in mapped files. `tasks` overrides
    how many tasks share them; the model is the same either way.
    """
    spark = train.sparkSession
    names = list(names)
    n = train.count()
    cuts = borders(train, names, bins)
    packing = Packing.of([len(cut) + 1 for cut in cuts])
    tasks = tasks or max(1, min(-(-n // TASK_ROWS), spark.sparkContext.defaultParallelism))
    dealt = train.repartition(tasks, "transaction_id")
    blocks = freeze(_blocks(dealt, names, cuts, packing), "boosting-rows")
    held_out = None if validation is None else freeze(_blocks(validation, names, cuts, packing), "boosting-validation")
    positives = 0 if validation is None else validation.filter("label > 0").count()
    trees: list[Tree] = []
    precisions: list[float] = []
    while len(trees) < settings.rounds:
        first, count = len(trees), min(job_rounds, settings.rounds - len(trees))
        # Exactly `tasks` tasks, as all of them have to run at once.
        given = blocks.select(*_COLUMNS).filter(F.length("label") > 0).repartition(tasks)
        folder = _exchange_folder(spark) if tasks > 1 else None
        with _block_by_block(spark):
            grown = freeze(
                continued(given, packing, first, count, settings, folder, n <= labelled_rows), "boosting-rows"
            )
        if folder:
            remove(spark, folder)
        packed = grown.filter("trees is not null").select("trees").first()["trees"]
        new = [Tree.unpacked(bytes(x)) for x in packed]
        trees += new
        release(blocks)
        blocks = grown
        if held_out is None:
            continue
        tried, found = _validated(held_out, new, first, packing, positives)
        precisions += found
        release(held_out)
        held_out = tried
        best = precisions.index(max(precisions))
        if len(precisions) - (best + 1) >= patience:
            break
    release(blocks)
    if held_out is None:
        return Ensemble(names, cuts, trees)
    release(held_out)
    kept = _watched(precisions, patience)
    return Ensemble(names, cuts, trees[: kept.index(max(kept)) + 1], tuple(kept))


def _watched(precisions: Sequence[float], patience: int) -> list[float]:
    """The rounds up to the one at which patience ended, however many a job has grown."""
    best = 0
    for i, value in enumerate(precisions):
        if value > precisions[best]:
            best = i
        if i - best >= patience:
            return list(precisions[: i + 1])
    return list(precisions)
