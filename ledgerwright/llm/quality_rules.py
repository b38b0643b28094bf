"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
failure bit per rule; policies are versioned masks over those bits, so that changing a
policy, comparing two or asking what one rule costs never reads a text again.

Defined cases: a null text has no words, so it measures 0 everywhere and fails
`few_words`; an empty text or one of white space alone likewise. Texts of any length are
measured whole. Repeated rows are judged one by one; an empty table gives an empty
ledger. Extra columns are ignored by `ledger` and kept by `accepted`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.texts import fresh, map_rows, utf8

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_lines long, longest_word long"
)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside a window of five words that occurs twice or more in the text."""
    shifted = [words[i:] for i in range(WINDOW)]
    if len(words) < WINDOW or len(set(zip(*shifted, strict=False))) == len(words) - WINDOW + 1:
        return 0
    windows = list(zip(*shifted, strict=False))
    times = Counter(windows)
    covered = reach = 0
    for start, window in enumerate(windows):
        if times[window] > 1:
            covered += start + WINDOW - max(reach, start)
            reach = start + WINDOW
    return covered


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of `MEASURES`; the longest word in bytes."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _CONTINUATION + SPACES)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        max(map(len, words), default=0),
    )


def _over(part: str, whole: str, percent: int) -> Column:
    return 100 * F.col(part) > percent * F.col(whole)


# A rule's place is its bit. Rules are only ever appended, so stored ledgers stay valid.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: _over("n_repeat_words", "n_words", 20),
    "symbols": lambda: _over("n_symbols", "n_words", 30),
    "repeated_lines": lambda: _over("n_dup_lines", "n_lines", 50),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 20 * F.col("n_words"),
    "endless_word": lambda: F.col("longest_word") > 2000,
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


def mask(*rules: str) -> int:
    return sum(BIT[r] for r in rules)


# A policy is never edited; a change is a new version.
POLICIES: dict[str, int] = {
    "v1": mask("few_words", "repeated_words"),
    "v2": mask("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "v3": mask(*RULES),
}
POLICY = "v3"


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, all measurements, and `fail_bits` with one bit per failed rule."""
    return _judged(map_rows(docs, [key], utf8(docs[text]), lambda: measure, MEASURES))


def _judged(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(failed(), F.lit(BIT[name])).otherwise(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: str = POLICY) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def accepted(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`; one pass, no shuffle."""
    names = docs.columns
    key = fresh(docs, "_row")
    body = fresh(docs, "_body")
    # The text travels once, beside the rest of the row.
    packed = docs.select(
        F.struct(F.lit(0).alias(body), *[docs[c] for c in names if c != text]).alias(key), docs[text].alias(body)
    )
    judged = _judged(map_rows(packed, [key, body], body, lambda: measure, MEASURES))
    return judged.filter(passes(policy)).select(
        *[F.col(body).alias(c) if c == text else F.col(f"{key}.`{c}`") for c in names]
    )


def ablations(rows: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """What each rule of each policy does: `policy, rule, n_failed, n_only, n_kept`.

    `n_failed` counts documents failing the rule, `n_only` those that no other rule of
    the policy rejects (dropping the rule would keep them) and `n_kept` those the whole
    policy keeps. The ledger is first counted by its distinct bit patterns, at most two
    to the number of rules, so that everything after is a handful of rows.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(
            F.lit(p).alias("policy"),
            F.lit(r).alias("rule"),
            F.lit(m).cast("long").alias("mask"),
            F.lit(BIT[r]).cast("long").alias("bit"),
        )
        for p, m in policies.items()
        for r in RULES
        if BIT[r] & m
    ]
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))

    def counted(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    return (
        patterns.withColumn("c", F.explode(F.array(*cases)))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            counted(hit.bitwiseAND(F.col("c.bit")) != 0).alias("n_failed"),
            counted(hit == F.col("c.bit")).alias("n_only"),
            counted(hit == 0).alias("n_kept"),
        )
    )
