"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field
adds what they miss: its variables are the tokens that could be part of an entity, linked
to their neighbours in a chain, and through one hub per group to all tokens of the
document that are equal or similar (the same last digits, the same name before an @).
Loopy belief propagation carries labels along these links, so that a number written once
in full marks its bare repetition pages later. Tokens inside a pattern's span are evidence
and keep their label. A hub makes the links of a group linear in its size.

The weights are fitted by pseudo-likelihood on a bounded sample, `SAMPLE` documents that
hold a digit or an @, the least by a hash of the id. Their labels are the patterns'
spans; each span's disguised twin (its plus sign, separators or domain gone) and each part
of a span of several tokens is added twice, linked with the span's label and alone
without one, which teaches the field to follow links and not shapes. Documents are then labelled whole, in one pass without a
shuffle.

Defined cases: a null or empty text has no spans. Spans are in code points, the end
exclusive. Repeated rows are labelled one by one; an empty table gives an empty result
(and a sample without spans gives weights under which nothing is added). Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.texts import map_rows, utf8
from ledgerwright.session import freeze

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE = 3_000
# Characters of a sampled document that the field is fitted on.
SAMPLE_CHARS = 100_000
ROUNDS = 300
SWEEPS = 20
DAMPING = 0.5
BELIEF = 0.5
KEY_DIGITS = 7
SEED = 6

Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from inside it, so no start inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# Anchored at the start of a word and possessive, so a word is read once.
_TOKEN = re.compile(
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*"
)
_EDGES = ".,;:!?\"'()[]{}<>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost without overlap for each kind; by start, then kind."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _NAME_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append((start, 0, last))
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _bucket(n: int, steps: tuple[int, ...]) -> int:
    return bisect_right(steps, n)


_DIGIT_STEPS, _DOT_STEPS = (1, 4, 7, 10, 14, 20), (1, 2, 3, 4)
N_FEATURES = len(_DIGIT_STEPS) + len(_DOT_STEPS) + 2 + 7


def token_features(token: str) -> np.ndarray:
    """What a token looks like, as zeros and ones."""
    x = np.zeros(N_FEATURES)
    digits = len(_NOT_DIGIT.sub("", token))
    x[_bucket(digits, _DIGIT_STEPS)] = 1
    dots = len(_DIGIT_STEPS) + 1
    x[dots + _bucket(token.count("."), _DOT_STEPS)] = 1
    rest = dots + len(_DOT_STEPS) + 1
    x[rest:] = (
        "@" in token,
        token.startswith("+"),
        "(" in token,
        "-" in token,
        any(c.isalpha() for c in token),
        "=" in token or '"' in token,
        digits == len(token),
    )
    return x


def link_keys(token: str) -> list[str]:
    """What makes tokens similar: their last digits, or the name before an @."""
    keys = []
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= KEY_DIGITS:
        keys.append(f"#{digits[-KEY_DIGITS:]}")
    name = token.split("@")[0].strip(_EDGES).lower()
    if name and ("@" in token or any(c.isalpha() for c in name)):
        keys.append(f"@{name}")
    return keys


@dataclass(frozen=True)
class Field:
    """Weights: label by feature, label by next label, and label agreement along links."""

    shape: np.ndarray
    chain: np.ndarray
    link: float

    @property
    def spoke(self) -> float:
        """The weight from token to hub under which two tokens agree as `link` wants."""
        low, high, others = 0.0, 20.0, len(LABELS) - 1
        for _ in range(60):
            u = (low + high) / 2
            got = np.log((np.exp(2 * u) + others) / (2 * np.exp(u) + others - 1))
            low, high = (u, high) if got < self.link else (low, u)
        return low


@dataclass
class Graph:
    """The variables of a document and their links."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    evidence: np.ndarray  # label known from a pattern, or -1
    chain: list[tuple[int, int]]
    groups: list[list[int]]


def graph_of(text: str, base: list[Span]) -> Graph:
    """Tokens with a digit or an @, and the words equal to a name before an @."""
    places = {(m.start(), m.end()) for m in _TOKEN.finditer(text)}
    names = {
        name
        for start, kind, end in base
        if kind == 0
        for name in [text[start:end].split("@")[0]]
        if len(name) > 3 and not _DIGIT.search(name)
    }
    if names:
        # One pass over the words, however many names there are.
        folded = {n.lower() for n in names}
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if m.group().strip(_EDGES).lower() in folded:
                places.add((m.start(), m.end()))
    spans = sorted(places)
    starts = [s for s, _, _ in base]
    longest = max((e - s for s, _, e in base), default=0)
    evidence = np.full(len(spans), -1)
    groups: dict[str, list[int]] = {}
    for i, (start, end) in enumerate(spans):
        j = bisect_right(starts, end - 1) - 1
        while j >= 0 and base[j][0] > start - longest - 1:
            if base[j][2] > start:
                evidence[i] = base[j][1] + 1
                break
            j -= 1
        for key in link_keys(text[start:end]):
            groups.setdefault(key, []).append(i)
    chain = [
        (i, i + 1)
        for i in range(len(spans) - 1)
        if spans[i + 1][0] - spans[i][1] <= 2 and not text[spans[i][1] : spans[i + 1][0]].strip()
    ]
    features = (
        np.array([token_features(text[s:e]) for s, e in spans]) if spans else np.zeros((0, N_FEATURES))
    )
    return Graph(spans, features, evidence, chain, [g for g in groups.values() if len(g) > 1])


def beliefs(graph: Graph, field: Field) -> np.ndarray:
    """Marginals of every token by loopy sum-product with damping."""
    n, k = len(graph.spans), len(LABELS)
    unary = graph.features @ field.shape.T
    known = graph.evidence >= 0
    unary[known] = -60.0
    unary[np.flatnonzero(known), graph.evidence[known]] = 0.0
    hubs = [(n + g, i) for g, members in enumerate(graph.groups) for i in members]
    pairs = graph.chain + hubs
    unary = np.vstack([unary, np.zeros((len(graph.groups), k))])
    if not pairs:
        return _normal(unary)[:n]
    a, b = np.array(pairs).T
    source, target = np.r_[a, b], np.r_[b, a]
    back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
    agree = field.spoke * np.eye(k)
    weights = np.stack([field.chain] * len(graph.chain) + [agree] * len(hubs))
    weights = np.concatenate([weights, weights.transpose(0, 2, 1)])
    messages = np.zeros((len(source), k))
    for _ in range(SWEEPS):
        total = unary.copy()
        np.add.at(total, target, messages)
        out = total[source] - messages[back]
        out = out - out.max(axis=1, keepdims=True)
        sent = _log_sum(weights + out[:, :, None])
        sent -= sent.max(axis=1, keepdims=True)
        change = np.abs(sent - messages).max()
        messages = DAMPING * messages + (1 - DAMPING) * sent
        if change < 1e-3:
            break
    total = unary.copy()
    np.add.at(total, target, messages)
    return _normal(total)[:n]


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def _normal(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans of tokens that no pattern covers but the field labels; neighbours of one
    label are one span, without the punctuation around it."""
    graph = graph_of(text, base)
    open_tokens = graph.evidence < 0
    if not open_tokens.any() or not (graph.chain or graph.groups):
        return []
    p = beliefs(graph, field)
    label = p.argmax(axis=1)
    sure = open_tokens & (label > 0) & (p.max(axis=1) > BELIEF)
    joined = set(graph.chain)
    spans: list[Span] = []
    for i in np.flatnonzero(sure).tolist():
        start, end = graph.spans[i]
        kind = int(label[i]) - 1
        if spans and i and sure[i - 1] and (i - 1, i) in joined and spans[-1][1] == kind:
            spans[-1] = (spans[-1][0], kind, end)
        else:
            spans.append((start, kind, end))
    trimmed = []
    for start, kind, end in spans:
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip(_EDGES))
        end -= len(piece) - len(piece.rstrip(_EDGES))
        if start < end:
            trimmed.append((start, kind, end))
    return trimmed


def _disguised(token: str, kind: int) -> str:
    """The same entity, in a form that no pattern finds."""
    if kind == 0:
        return token.split("@")[0]
    digits = _NOT_DIGIT.sub("", token)
    return digits if kind == 1 else "/".join((digits[:3], digits[3:]))


def fit_field(texts: list[str]) -> Field:
    """Pseudo-likelihood: each token given the labels of its neighbours and links."""
    k = len(LABELS)
    xs, ys, before, after, linked = [], [], [], [], []

    def example(x, y, left, right, labels):
        xs.append(x)
        ys.append(y)
        before.append(left)
        after.append(right)
        votes = np.zeros(k)
        votes[list(set(labels))] = 1
        linked.append(votes)

    for text in texts:
        base = base_spans(text)
        graph = graph_of(text, base)
        y = np.maximum(graph.evidence, 0)
        left, right = np.full(len(y), -1), np.full(len(y), -1)
        for i, j in graph.chain:
            right[i], left[j] = y[j], y[i]
        others: list[list[int]] = [[] for _ in y]
        for group in graph.groups:
            present = set(y[group].tolist())
            for i in group:
                others[i] += [v for v in present if v != y[i] or (y[group] == v).sum() > 1]
        for i in range(len(y)):
            example(graph.features[i], y[i], left[i], right[i], others[i])
        for start, kind, end in base:
            twin = token_features(_disguised(text[start:end], kind))
            example(twin, kind + 1, -1, -1, [kind + 1])
            example(twin, 0, -1, -1, [])
            parts = [i for i, (s, e) in enumerate(graph.spans) if s < end and e > start]
            if len(parts) > 1:
                for i in parts:
                    example(graph.features[i], kind + 1, -1, -1, [kind + 1])
                    example(graph.features[i], 0, -1, -1, [])
    shape, chain, link = np.zeros((k, N_FEATURES)), np.zeros((k, k)), 1.0
    if not any(ys):
        return Field(np.vstack([np.full(N_FEATURES, 5.0), np.zeros((k - 1, N_FEATURES))]), chain, link)
    x, y = np.array(xs), np.array(ys)
    before, after, linked = np.array(before), np.array(after), np.array(linked)
    # one-hot of the neighbours' labels; none is all zeros
    one = np.vstack([np.eye(k), np.zeros(k)])
    prev, following = one[before], one[after]
    target = np.eye(k)[y]
    moments = [np.zeros_like(shape), np.zeros_like(chain), 0.0]
    squares = [np.zeros_like(shape), np.zeros_like(chain), 0.0]
    for step in range(1, ROUNDS + 1):
        p = _normal(x @ shape.T + prev @ chain + following @ chain.T + link * linked)
        d = (p - target) / len(y)
        gradients = [
            d.T @ x + 1e-4 * shape,
            prev.T @ d + d.T @ following + 1e-4 * chain,
            float((d * linked).sum()) + 1e-4 * link,
        ]
        moves = []
        for i, g in enumerate(gradients):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            squares[i] = 0.999 * squares[i] + 0.001 * g * g
            rate = 0.1 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            moves.append(rate * moments[i] / (np.sqrt(squares[i]) + 1e-8))
        shape, chain, link = shape - moves[0], chain - moves[1], link - float(moves[2])
    return Field(shape, chain, max(link, 0.0))


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SAMPLE) -> Field:
    """The field, fitted by one task on no more than `size` documents, of each at most
    `SAMPLE_CHARS` characters; of rows that share an id, the text of the least digest."""
    chosen = (
        docs.filter(docs[text].rlike("[0-9@]"))
        .select(docs[key].alias("_id"))
        .orderBy(F.xxhash64("_id", F.lit(SEED)), "_id")
        .limit(size)
        .distinct()
        .withColumnRenamed("_id", "_chosen")
    )
    ids = F.broadcast(freeze(chosen, "pii-sample"))  # at most `size` ids
    start = F.substring(docs[text], 1, SAMPLE_CHARS)
    body = docs.select(docs[key].alias("_id"), start.alias("_body")).join(
        ids, F.col("_id").eqNullSafe(F.col("_chosen"))
    )
    sample = freeze(
        body.groupBy("_chosen").agg(F.min_by("_body", F.md5(F.col("_body").cast("binary"))).alias("_body")),
        "pii-texts",
    )

    def fit(batches):
        texts = [t for batch in batches for t in batch.column(0).to_pylist() if t]
        field = fit_field(texts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([field.shape.tobytes()]),
                pa.array([field.chain.tobytes()]),
                pa.array([field.link]),
            ],
            names=["shape", "chain", "link"],
        )

    ordered = sample.select("_body").repartition(1).sortWithinPartitions(F.xxhash64("_body"), "_body")
    got = ordered.mapInArrow(fit, "shape binary, chain binary, link double").first()
    if got is None:
        return fit_field([])
    k = len(LABELS)
    return Field(
        np.frombuffer(got["shape"]).reshape(k, -1),
        np.frombuffer(got["chain"]).reshape(k, k),
        got["link"],
    )


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, the counts and digest of the patterns' spans, and all spans."""
    k = len(LABELS)
    packed = (field.shape.tobytes(), field.chain.tobytes(), field.link)

    def make():
        own = Field(
            np.frombuffer(packed[0]).reshape(k, -1), np.frombuffer(packed[1]).reshape(k, k), packed[2]
        )

        def row(body: bytes) -> tuple:
            content = body.decode()
            base = base_spans(content)
            every = sorted(base + added_spans(content, base, own)) if _possible(content) else base
            counts = [0] * len(KINDS)
            for _, kind, _ in base:
                counts[kind] += 1
            digest = hashlib.sha256(_listed(base).encode()).hexdigest()
            return (*counts, digest, _listed(every))

        return row

    schema = "".join(f"n_{kind} long, " for kind in KINDS) + "base_sha256 string, spans string"
    return map_rows(docs, [key], utf8(docs[text]), make, schema)


def _possible(text: str) -> bool:
    return "@" in text or _DIGIT.search(text) is not None
