"""Encoding whole texts by the tokenizer libraries, each distinct piece of text once.

A text is cut before every space that follows a visible character. There both kinds of
tokenizer end a token whatever stands around it: a byte-level pattern starts a new
pre-token at such a space, and a vocabulary in which no entry holds a space mark behind
another character cannot join across it. So a piece has the same tokens everywhere, and a
bounded memo per worker remembers them. A tokenizer without that property gets the whole
text in one piece.

A library object is broadcast as the bytes of its vocabulary file, whose size bounds it,
and made anew in every worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces in a generation of a memo; about 80 MB.
MEMO_PIECES = 400_000
# Characters of text cut up at once; bounds the working memory of a task.
SLICE_CHARS = 1 << 20
_UNEVEN = re.compile(r"\s ").search
_CUT = re.compile(r"(?<=\S) ").split
_BREAK = re.compile(r"(?<=\S)\n(?=\S)").split
# Marks that end a pre-token of letters and are one themselves.
_MARKS = frozenset(".,;:!?")
# How byte-level entries write a space.
_SPACE_LETTER = "\u0120"
# Words that the library gets at once.
_WORDS_AT_ONCE = 256
# Pieces whose spelling is compared at once.
_COMPARED_AT_ONCE = 512


def after_spaces(text: str) -> list[str]:
    """The pieces of a space and the text, each without the space that it starts with."""
    if not _UNEVEN(f" {text}"):
        return text.split(" ")
    first, *rest = _CUT(f" {text}")
    return [first[1:], *rest]


def _words(text: str, spaced: bool) -> tuple[list[str], list[int]]:
    """The pieces of a text, or with `spaced` of a space and the text, and which of them
    start a line.

    A line break between visible characters is a token of its own. Pieces are given
    without the space that they start with; all do but the first of a line, and with
    `spaced` that of the first line does, too.
    """
    words, lines = text.split(), text.split("\n")
    firsts, at = [], 0
    for line in lines:
        firsts.append(at)
        at += line.count(" ") + 1
    # Nothing but the words, with a space or line break between any two.
    if at == len(words) and len(" ".join(words)) == len(text):
        return words, firsts
    # Other white space than single spaces and line breaks between visible characters.
    cuts = [_CUT(line) for line in _BREAK(f" {text}" if spaced else text)]
    if spaced:
        cuts[0][0] = cuts[0][0][1:]
    firsts, words = [], []
    for pieces in cuts:
        firsts.append(len(words))
        words += pieces
    return words, firsts


def _byte_letters() -> dict[int, str]:
    """Byte to the letter that byte-level entries write it as: itself where it prints,
    else the code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes stay within `most`, or of a single row."""
    start, held, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield start, at
            start, held = at, 0
        held += size
    if at >= start:
        yield start, at + 1


def text_slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a string column in slices of bounded size, each with its first row."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for start, stop in slices(sizes.tolist(), SLICE_CHARS):
        yield start, column.slice(start, stop - start).to_pylist()


class _Memo:
    """The ids of pieces, in two generations: when the younger one is full it becomes the
    older, whose pieces come back when they are asked for again."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, missing: set[str], make: Callable[[list[str]], dict[str, bytes]]) -> dict[str, bytes]:
        """The ids of pieces that the younger generation lacks: the older one's, and those
        that a function makes, which may give more than it is asked for."""
        get = self.old.get
        known = {p: ids for p in missing if (ids := get(p)) is not None}
        made = make([p for p in missing if p not in known]) if len(known) < len(missing) else {}
        self.add(known | made)
        return known | made

    def add(self, made: dict[str, bytes]) -> None:
        if len(self.young) + len(made) > MEMO_PIECES:
            self.old, self.young = self.young, {}
        self.young.update(made)


class ByteLevel:
    """A byte-level BPE of the tokenizers library, from the contents of its JSON file.

    With `plain`, the strings of special tokens are ordinary text.
    """

    def __init__(self, contents: bytes, plain: bool = False):
        self.contents = contents
        self.plain = plain
        self._ready = False

    def __getstate__(self):
        return {"contents": self.contents, "plain": self.plain, "_ready": False}

    @classmethod
    def read(cls, path: str, plain: bool = False) -> ByteLevel:
        with open(path, "rb") as file:
            return cls(file.read(), plain)

    @property
    def size(self) -> int:
        """One more than the greatest id."""
        rules = json.loads(self.contents)
        added = [t["id"] for t in rules.get("added_tokens", ())]
        return 1 + max([*rules["model"]["vocab"].values(), *added])

    def spelled(self) -> list[bytes]:
        """The bytes that each id stands for; special tokens for their own text."""
        rules = json.loads(self.contents)
        byte = {c: b for b, c in _byte_letters().items()}
        out = [b""] * self.size
        for token in rules.get("added_tokens", ()):
            out[token["id"]] = token["content"].encode()
        for entry, at in rules["model"]["vocab"].items():
            out[at] = bytes(byte[c] for c in entry)
        return out

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._library = Tokenizer.from_str(self.contents.decode())
        self._library.encode_special_tokens = self.plain
        self._split = self._library.pre_tokenizer
        rules = json.loads(self.contents)
        before = rules.get("pre_tokenizer") or {}
        added = rules.get("added_tokens", ())
        self._special = [] if self.plain else [t["content"] for t in added]
        self.cuts = bool(
            rules.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            and not any(t["content"].isalpha() for t in added)
        )
        self._letters = _byte_letters()
        # The model alone, for words written as letters between spaces.
        self._words_only = Tokenizer(self._library.model)
        self._words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        entries = rules["model"]["vocab"]
        self._size = np.zeros(self.size, np.int64)
        self._size[list(entries.values())] = [len(x) for x in entries]
        self._line = np.array(self._encode(["\n"])[0], "<u4").tobytes()
        self.cuts = self.cuts and len(self._line) == 4
        self._spaced, self._bare = _Memo(), _Memo()
        self._ready = True

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, written as letters."""
        if not words:
            return []
        batch = [" ".join(words[i : i + _WORDS_AT_ONCE]) for i in range(0, len(words), _WORDS_AT_ONCE)]
        ids = np.concatenate([np.array(x, "<u4") for x in self._words_of_all(batch)])
        # Where as many letters have been written as the words have.
        written = np.cumsum(self._size[ids])
        stops = np.searchsorted(written, np.cumsum([len(w) for w in words])) + 1
        data, stops = ids.tobytes(), (4 * stops).tolist()
        return [data[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def _words_of_all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._words_only.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], lead: str, before: bytes) -> dict[str, bytes]:
        """The ids of pieces that follow `lead`, a space or nothing, with `before` in front;
        those of words that were only seen with a mark as well."""
        # Nearly all pieces are a word, with or without a mark behind it.
        words, marked, others, out = {}, [], [], {}
        start = _SPACE_LETTER if lead else ""
        for piece in pieces:
            word = piece[:-1] if piece[-1:] in _MARKS else piece
            if not word.isalpha():
                others.append(piece)
                continue
            if word.isascii():
                words[word] = start + word
            elif max(word) < "\u0250":
                words[word] = start + word.encode().decode("latin-1").translate(self._letters)
            else:
                others.append(piece)
                continue
            if word is not piece:
                marked.append(piece)
        split = {}
        for piece in others:
            if any(s in piece for s in self._special):
                out[piece] = before + np.array(self._encode([lead + piece])[0], "<u4").tobytes()
            else:
                split[piece] = [x for x, _ in self._split.pre_tokenize_str(lead + piece)] if lead + piece else []
        letters = dict.fromkeys(words.values())
        for parts in split.values():
            letters |= dict.fromkeys(parts)
        letters |= dict.fromkeys(_MARKS)
        of = dict(zip(letters, self._word_ids(list(letters)), strict=True))
        if before:
            of_word = {word: before + of[x] for word, x in words.items()}
        else:
            of_word = {word: of[x] for word, x in words.items()}
        # Also words that were only seen with a mark: they will be.
        out.update(of_word)
        for piece in marked:
            out[piece] = of_word[piece[:-1]] + of[piece[-1]]
        for piece, parts in split.items():
            out[piece] = before + b"".join([of[x] for x in parts])
        return out

    def separable(self) -> bool:
        """Whether texts may be cut into pieces."""
        if not self._ready:
            self._load()
        return self.cuts

    def ids(self, texts: list[str], spaced: bool = False) -> Iterator[np.ndarray]:
        """The ids of every text, or with `spaced` of a space and the text, as the library
        gives them for the whole."""
        if not self.separable():
            yield from (np.array(x, "<u4") for x in self._encode([f" {x}" if spaced else x for x in texts]))
            return
        rows, absent, absent_bare = [], set(), set()
        get, get_bare = self._spaced.young.get, self._bare.young.get
        for text in texts:
            keys, firsts = _words(text, spaced)
            values = list(map(get, keys))
            gaps_bare = []
            for i in firsts[1:] if spaced else firsts:
                ids = get_bare(keys[i])
                if ids is None:
                    gaps_bare.append(i)
                    absent_bare.add(keys[i])
                values[i] = ids or b""
            gaps = [i for i, ids in enumerate(values) if ids is None]
            absent.update([keys[i] for i in gaps])
            rows.append((values, keys, gaps, gaps_bare))
        new = self._spaced.of(absent, lambda pieces: self._learn(pieces, " ", b""))
        new_bare = self._bare.of(absent_bare, lambda pieces: self._learn(pieces, "", self._line))
        for values, keys, gaps, gaps_bare in rows:
            for i in gaps:
                values[i] = new[keys[i]]
            for i in gaps_bare:
                values[i] = new_bare[keys[i]]
            ids = np.frombuffer(b"".join(values), "<u4")
            # No line break stands before the first line.
            yield ids if spaced else ids[1:]


class SentencePieces:
    """A model of the sentencepiece library that puts a space before every text, from the
    contents of its file."""

    def __init__(self, contents: bytes):
        self.contents = contents
        self._ready = False

    def __getstate__(self):
        return {"contents": self.contents, "_ready": False}

    @classmethod
    def read(cls, path: str) -> SentencePieces:
        with open(path, "rb") as file:
            return cls(file.read())

    def _load(self) -> None:
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_proto=self.contents)
        entries = [self._library.id_to_piece(i) for i in range(self._library.get_piece_size())]
        self.cuts = not any(re.search("[^\u2581]\u2581", x) for x in entries)
        # An empty text gets no space before it, so a space alone is looked up.
        self._space = np.array([self._library.piece_to_id("\u2581")], "<u4").tobytes()
        self._bytes = [
            bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("\u2581", " ").encode()
            for x in entries
        ]
        self._memo = _Memo()
        # Pieces that the tokens do not spell as they stand, of those ever seen.
        self.unlike: set[str] = set()
        self._ready = True

    def separable(self) -> bool:
        if not self._ready:
            self._load()
        return self.cuts

    def spelled(self) -> list[bytes]:
        """The bytes that each id stands for."""
        if not self._ready:
            self._load()
        return self._bytes

    def pieced(self, parts: list[list[str]]) -> Iterator[np.ndarray]:
        """The ids of texts given as their pieces, all of which follow a space."""
        if not self._ready:
            self._load()
        get, rows, absent = self._memo.young.get, [], set()
        for part in parts:
            values = list(map(get, part))
            gaps = [i for i, ids in enumerate(values) if ids is None]
            absent.update([part[i] for i in gaps])
            rows.append((values, gaps))
        new = self._memo.of(absent, self._made)
        for part, (values, gaps) in zip(parts, rows, strict=True):
            for i in gaps:
                values[i] = new[part[i]]
            yield np.frombuffer(b"".join(values), "<u4")

    def _made(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces; those that the tokens do not spell are noted as `unlike`."""
        given = [p for p in pieces if p]
        rows = self._library.encode(given, num_threads=1)
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), "<u4", counts.sum())
        data, stops = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
        made = {p: data[i:j] for p, i, j in zip(given, [0, *stops], stops, strict=False)}
        of = self._bytes.__getitem__
        for at in range(0, len(given), _COMPARED_AT_ONCE):
            some, ids = given[at : at + _COMPARED_AT_ONCE], rows[at : at + _COMPARED_AT_ONCE]
            # Written in turn the same, and each of the same length: each the same.
            spelled = [b"".join(map(of, x)) for x in ids]
            if spelled != f" {'\0 '.join(some)}".encode().split(b"\0"):
                wrong = (p for p, x in zip(some, spelled, strict=True) if x != b" " + p.encode())
                self.unlike.update(wrong)
        if len(given) < len(pieces):
            made[""] = self._space
        return made
