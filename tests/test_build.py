"""Groups of products built into stored tables."""

import os

import pytest

from ledgerwright import Products
from ledgerwright.plans.products import BY_DAY, GROUPS, build


@pytest.mark.parametrize("group", sorted(GROUPS))
def test_every_product_is_stored_with_all_its_columns(spark, ledger, tmp_path, group):
    rows = [{"step": s, "nameorig": f"C{s % 5}", "amount": f"{s}.00"} for s in range(1, 60)]
    target = str(tmp_path / group)
    counts = {r["product"]: r["row_count"] for r in build(Products(ledger(*rows)), group, target).collect()}
    fresh = Products(ledger(*rows))
    assert set(counts) == set(GROUPS[group])
    for name in GROUPS[group]:
        stored, product = spark.read.parquet(f"{target}/{name}"), getattr(fresh, name)
        assert set(stored.columns) == set(product.columns), name
        assert stored.count() == counts[name] == product.count(), name
        if name in BY_DAY:
            assert any(d.startswith("simulation_day=") for d in os.listdir(f"{target}/{name}"))
