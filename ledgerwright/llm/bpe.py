"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is itself
a vocabulary entry; any other is merged with a heap over linked bytes, in n log n of its
length. A bounded memo per task stands in front of both, keyed by the piece of text
between single spaces, which repeats far more often than it varies.

Defined cases: a null or empty text has no ids and decodes to no bytes. Texts are encoded
whole, whatever their length. Repeated rows are encoded one by one; an empty table gives
an empty one. Special tokens are never produced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import regex
import xxhash
from pyspark.sql import DataFrame

from ledgerwright.llm.texts import map_rows, utf8

# Entries of a memo's generation; about 80 MB.
MEMO_ENTRIES = 300_000
# Longer pieces are not worth keeping.
MEMO_CHARS = 64
_LOW = (1 << 32) - 1


class PerfectHash:
    """A minimal perfect hash: n byte strings to the slots 0 to n - 1, no slot unused.

    Keys are hashed once to 64 bits and grouped into buckets; each bucket, largest first,
    gets the first displacement that sends all its keys to free slots.
    """

    def __init__(self, keys: list[bytes]):
        n = self.size = max(1, len(keys))
        self.n_buckets = max(1, n // 2)
        self.shift = [0] * self.n_buckets
        self.slots = [0] * len(keys)
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(self.n_buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != len(keys):
            raise ValueError("vocabulary entries repeat")
        for at, h in enumerate(hashes):
            low, high = h & _LOW, h >> 32
            buckets[low % self.n_buckets].append((low, high, at))
        taken = bytearray(n)
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        for b in order:
            if len(buckets[b]) < 2:
                break
            d = 0
            while True:
                slots = {self._mixed(low, high, d) for low, high, _ in buckets[b]}
                if len(slots) == len(buckets[b]) and not any(map(taken.__getitem__, slots)):
                    break
                d += 1
            self.shift[b] = d
            for low, high, at in buckets[b]:
                self.slots[at] = slot = self._mixed(low, high, d)
                taken[slot] = 1
        # A bucket of one takes any free slot, which a negative shift names outright.
        free = (slot for slot in range(n) if not taken[slot])
        for b in order:
            if len(buckets[b]) == 1:
                self.slots[buckets[b][0][2]] = slot = next(free)
                self.shift[b] = -slot - 1

    def _mixed(self, low: int, high: int, d: int) -> int:
        return ((low + (high | 1) * d) ^ (high >> 7)) % self.size

    def slot(self, key: bytes) -> int:
        """The key's slot; for a string that is no key, any slot."""
        h = xxhash.xxh3_64_intdigest(key)
        low, high = h & _LOW, h >> 32
        d = self.shift[low % self.n_buckets]
        if d < 0:
            return -d - 1
        return self._mixed(low, high, d)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair merges first, leftmost on ties.

    The bytes form a linked list and the heap holds the pairs; an entry whose left or
    right part has since changed is stale and skipped.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # the start of the part to the left
    get = ranks.get
    heap = [
        (r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None
    ]
    heapify(heap)
    while heap:
        rank, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i] = stop
        end[middle] = 0
        if stop < n:
            before[stop] = i
            after = end[stop]
            if (r := get(piece[i:after])) is not None:
                heappush(heap, (r, i, after))
        left = before[i]
        if left >= 0 and (r := get(piece[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    ids = []
    i = 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Memo(dict):
    """What `make` gives for each key, in two generations: when the younger one is full it
    becomes the older, whose entries come back when they are asked for again. Long keys
    are not kept."""

    def __init__(self, make: Callable[[str], str]):
        self.make = make
        self.old: dict[str, str] = {}

    def __missing__(self, key: str) -> str:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Codec:
    """Encoder and decoder over a rank file's entries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = pattern
        entries = list(ranks)
        self.hash = PerfectHash(entries)
        self.entry = [b""] * self.hash.size
        self.id = [0] * self.hash.size
        for key, slot in zip(entries, self.hash.slots, strict=True):
            self.entry[slot] = key
            self.id[slot] = ranks[key]
        self.bytes_of = {str(rank): key for key, rank in ranks.items()}
        self._encode: Callable[[str], str] | None = None

    @classmethod
    def read(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            return cls({base64.b64decode(key): int(rank) for key, rank in pairs}, pattern)

    def pretoken(self, piece: bytes) -> list[int]:
        slot = self.hash.slot(piece)
        if self.entry[slot] == piece:
            return [self.id[slot]]
        return merge(piece, self.ranks)

    def encoder(self) -> Callable[[str], str]:
        """A function from a text to its ids, in decimal and joined by single spaces.

        Tasks of one worker share it, and with it the memo.
        """
        if self._encode is None:
            self._encode = self._encoder()
        return self._encode

    def _encoder(self) -> Callable[[str], str]:
        split = regex.compile(self.pattern).findall
        # White space beside a space: there, a piece between spaces is not independent.
        uneven = regex.compile(r"^ |[^\S ] |  | [^\S ]| $").search
        pretoken = self.pretoken

        # Pre-tokens that several pieces share, such as a word with and without a comma.
        part = _Memo(lambda x: " ".join([str(i) for i in pretoken(x.encode())])).__getitem__

        def spelled(piece: str) -> str:
            return " ".join(map(part, split(piece)))

        memo = _Memo(spelled)

        def encode(text: str) -> str:
            if not text:
                return ""
            if uneven(text):
                return spelled(text)
            # A space between two visible characters opens a pre-token, and the match of
            # the pattern on either side does not look across it.
            first, *rest = text.split(" ")
            parts = [memo[first]]
            parts += map(memo.__getitem__, [f" {piece}" for piece in rest])
            return " ".join(parts)

        return encode

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def shipped(df: DataFrame, path: str, pattern: str):
    """The codec on every executor, once each: a vocabulary's size bounds it."""
    return df.sparkSession.sparkContext.broadcast(Codec.read(path, pattern))


def encoded(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key, n_tokens, ids` with the ids of the whole text as array<int>."""
    codec = shipped(docs, path, pattern)

    def make():
        encode = codec.value.encoder()

        def row(data: bytes) -> tuple:
            ids = [int(i) for i in encode(data.decode()).split()]
            return len(ids), ids

        return row

    return map_rows(docs, [key], utf8(docs[text]), make, "n_tokens long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key, data`: the bytes that the ids stand for; null ids give no bytes."""
    codec = shipped(rows, path, pattern)

    def make():
        value = codec.value
        return lambda x: (value.decode(" ".join(map(str, x or ()))),)

    return map_rows(rows, [key], rows[ids], make, "data binary")


def digests(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key, n_tokens, ids_sha256, decoded_sha256` of an encoding and its decoding."""
    codec = shipped(docs, path, pattern)

    def make():
        value = codec.value
        encode = value.encoder()

        def row(data: bytes) -> tuple:
            ids = encode(data.decode())
            return (
                ids.count(" ") + 1 if ids else 0,
                hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(value.decode(ids)).hexdigest(),
            )

        return row

    return map_rows(
        docs,
        [key],
        utf8(docs[text]),
        make,
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
