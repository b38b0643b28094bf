"""Transaction-ledger analytics as composable PySpark DataFrame transformations."""

from ledgerwright.plans.products import Products

__all__ = ["Products"]
