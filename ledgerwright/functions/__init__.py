"""Column functions shared by all plans."""

from ledgerwright.functions.columns import (
    clip_log1p,
    confusion_flags,
    count_where,
    finite_or_null,
    fraud_rate,
    hash_bucket,
    order_key,
    published_rate,
    ratio,
    safe_divide,
    squish,
    sum_where,
    with_calendar,
)

__all__ = [
    "clip_log1p",
    "confusion_flags",
    "count_where",
    "finite_or_null",
    "fraud_rate",
    "hash_bucket",
    "order_key",
    "published_rate",
    "ratio",
    "safe_divide",
    "squish",
    "sum_where",
    "with_calendar",
]
