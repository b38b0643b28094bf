"""Quality grades by ordinal regression on hashed text.

Cumulative-link model: P(grade <= k) = logistic(threshold_k - w . x), one weight vector
shared by all grades and thresholds kept in order by construction (each is the one before
plus an exponential). Features are hashed words (present or not) and the shares, in
tenths, of words of certain shapes. From the model every document gets its expected grade
and the probability of each tail, grade k or better, by which it can be selected.

The model is fitted on a bounded sample of the labelled documents: `SAMPLE` of them, the
least by a hash of the id, whatever the number of labels. All documents are scored, whole,
in one pass without a shuffle.

Defined cases: a null or empty text has no words, only the features of that; it scores
like any other. Labels without a grade, or whose document is missing, are not sampled;
contradicting labels of one document all count. Of rows that share an id the model sees
the text of the least digest; all are scored, one by one. An empty table gives an empty
result. Without labels, or with labels of one grade only, no word counts, and every
document gets the shares of the grades seen. Extra columns are ignored by `graded` and
kept by `selected`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.sketches import U64, WordHashes
from ledgerwright.llm.texts import fresh, map_rows, utf8
from ledgerwright.session import freeze

SAMPLE = 12_000
BITS = 17
STEPS = 4000
RATE = 0.05
DECAY = 1e-4
BATCH = 64
# A feature that fewer sampled documents show has no weight, nor has one whose share of
# documents differs between better and worse grades by fewer standard errors.
LEAST_DOCUMENTS = 5
LEAST_Z = 6.0
SEED = 9

_EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_=+~`^/\\"
_SHAPES = 6


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The distinct feature numbers of a text, below 2**BITS."""
    words = text.split()
    bare = [w.strip(_EDGES).lower() for w in words]
    n = max(1, len(words))
    shapes = (
        sum(map(bytes.isupper, words)),
        sum(1 for w, b in zip(words, bare, strict=True) if len(w) > len(b) + 1),
        bare.count(b""),
        sum(map(bytes.isdigit, bare)),
        len(words) - len(set(words)),
        sum(1 for w in words if len(w) > 30),
    )
    hashed = hashes.of(bare) >> U64(64 - BITS)
    marks = [
        hashes[b"\0shape %d %d" % (i, 10 * count // n)] >> (64 - BITS) for i, count in enumerate(shapes)
    ]
    return np.unique(np.r_[hashed, np.array(marks, U64)]).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to K - 1, given feature numbers."""
        return _logistic(self.weights[x].sum() - self.thresholds)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _telling(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Which features separate some grade and better from what is below it."""
    index = np.concatenate(rows)
    owner = np.repeat(grades, [len(r) for r in rows])
    count = np.bincount(index, minlength=1 << BITS)
    share = count / len(rows)
    z = np.zeros(1 << BITS)
    for k in range(1, n_grades):
        high = max(1, (grades >= k).sum())
        low = max(1, len(grades) - high)
        above = np.bincount(index, owner >= k, minlength=1 << BITS)
        error = np.sqrt(share * (1 - share) * (1 / high + 1 / low)) + 1e-12
        z = np.maximum(z, np.abs(above / high - (count - above) / low) / error)
    return (count >= LEAST_DOCUMENTS) & (z >= LEAST_Z)


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood by Adam over shuffled batches; deterministic."""
    if len(set(grades.tolist())) < 2:
        return neutral(grades, n_grades)
    w = np.zeros(1 << BITS)
    used = _telling(rows, grades, n_grades)
    rows = [r[used[r]] for r in rows]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # first threshold, then the logarithms of the steps
    theta = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    m, v = np.zeros_like(w), np.zeros_like(w)
    mt, vt = np.zeros_like(theta), np.zeros_like(theta)
    random = np.random.default_rng(SEED)
    step = 0
    for _ in range(-(-STEPS * BATCH // len(rows))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            step += 1
            lengths = [len(rows[i]) for i in batch]
            index = np.concatenate([rows[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), lengths)
            score = np.bincount(owner, w[index], minlength=len(batch))
            cuts = np.r_[-np.inf, np.r_[theta[0], theta[0] + np.cumsum(np.exp(theta[1:]))], np.inf]
            y = grades[batch]
            upper, lower = _cdf(cuts[y + 1] - score), _cdf(cuts[y] - score)
            mass = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
            gs = (du - dl) / len(batch)  # of the negative log-likelihood, by the score
            touched, where = np.unique(index, return_inverse=True)
            g = np.bincount(where, gs[owner]) + DECAY * w[touched]
            by_cut = np.zeros(len(cuts) - 2)
            np.add.at(by_cut, np.minimum(y, len(by_cut) - 1), np.where(y < len(by_cut), -du, 0) / len(batch))
            np.add.at(by_cut, np.maximum(y - 1, 0), np.where(y > 0, dl, 0) / len(batch))
            # a step moves all thresholds from its own on
            onward = np.cumsum(by_cut[::-1])[::-1]
            gt = np.r_[onward[0], onward[1:] * np.exp(theta[1:])]
            rate = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            m[touched] = 0.9 * m[touched] + 0.1 * g
            v[touched] = 0.999 * v[touched] + 0.001 * g * g
            w[touched] -= rate * m[touched] / (np.sqrt(v[touched]) + 1e-8)
            mt, vt = 0.9 * mt + 0.1 * gt, 0.999 * vt + 0.001 * gt * gt
            theta = theta - rate * mt / (np.sqrt(vt) + 1e-8)
    return Model(w, np.r_[theta[0], theta[0] + np.cumsum(np.exp(theta[1:]))])


def neutral(grades: np.ndarray, n_grades: int) -> Model:
    """The model that looks at no word: the share of each grade, every grade having been
    seen once more than it was."""
    seen = np.bincount(grades, minlength=n_grades) + 1
    share = np.cumsum(seen)[:-1] / seen.sum()
    return Model(np.zeros(1 << BITS), np.log(share / (1 - share)))


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.where(np.isposinf(x), 1.0, np.where(np.isneginf(x), 0.0, _logistic(np.nan_to_num(x, posinf=0, neginf=0))))


def sampled(labels: DataFrame, grade: Column, key: str, size: int = SAMPLE) -> DataFrame:
    """`_id, grade` of at most `size` labels, the least by a hash of the id."""
    return (
        labels.select(labels[key].alias("_id"), grade.cast("int").alias("grade"))
        .filter("_id is not null and grade is not null")
        .orderBy(F.xxhash64("_id", F.lit(SEED)), "_id", "grade")
        .limit(size)
    )


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    grade: Column,
    n_grades: int,
    key: str = "doc_id",
    text: str = "text",
    size: int = SAMPLE,
) -> Model:
    """The model; one task fits it, on no more than `size` rows of feature numbers."""
    # At most `size` ids: small enough for every executor.
    chosen = F.broadcast(freeze(sampled(labels, grade, key, size), "sample"))
    body = utf8(docs[text])
    found = (
        docs.select(docs[key].alias("_id"), F.md5(body).alias("_digest"), body.alias("_body"))
        .join(chosen, "_id")
        # Of rows that share an id, the one of the least digest: `size` rows at most.
        .groupBy("_id", "grade")
        .agg(F.min_by("_body", "_digest").alias("_body"))
    )

    def make():
        hashes = WordHashes()
        return lambda body: (features(body, hashes).tolist(),)

    rows = freeze(map_rows(found, ["_id", "grade"], F.col("_body"), make, "x array<int>"), "features")

    def fit(batches):
        grades, xs = [], []
        for batch in batches:
            grades += batch.column(0).to_pylist()
            xs += [np.array(x, np.int64) for x in batch.column(1).to_pylist()]
        model = fit_rows(xs, np.array(grades, np.int64), n_grades)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()]), pa.array([model.thresholds.tobytes()])],
            names=["weights", "thresholds"],
        )

    ordered = rows.select("grade", "x").repartition(1).sortWithinPartitions(F.xxhash64("x"), "grade")
    got = ordered.mapInArrow(fit, "weights binary, thresholds binary").first()
    if got is None:
        return neutral(np.zeros(0, np.int64), n_grades)
    return Model(np.frombuffer(got["weights"]), np.frombuffer(got["thresholds"]))


def graded(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, expected_grade, tails` with tails[k - 1] = P(grade >= k)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        hashes = WordHashes()
        value = shared.value

        def row(body: bytes) -> tuple:
            tails = value.tails(features(body, hashes))
            return float(tails.sum()), tails.tolist()

        return row

    return map_rows(docs, [key], utf8(docs[text]), make, "expected_grade double, tails array<double>")


def selected(
    docs: DataFrame, model: Model, least: int, probability: float, text: str = "text"
) -> DataFrame:
    """The rows of `docs` whose grade is `least` or better with the given probability."""
    whole, body = fresh(docs, "_doc"), fresh(docs, "_body")
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias(whole), docs[text].alias(body))
    return (
        graded(packed, model, whole, body)
        .filter(F.get("tails", F.lit(least - 1)) >= probability)
        .select(*[F.col(f"{whole}.`{c}`") for c in names])
    )
