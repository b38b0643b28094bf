"""Registered queries against their SQL on the smallest data set, and their plans."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from registry.oracles import ORACLES, oracle
from registry.queries import QUERIES, bind
from registry.shapes import SHAPES, columns_of

DATA = "/root/testdata/sf0.001"
SQL_FREE = {
    "dataset_version",
    "train_logistic_regression",
    "train_random_forest",
    "train_gradient_boosting",
    "score_dataset",
    "feature_importance",
    "rank_by_importance",
}
# Built from projections only, or cheap enough to explain without running jobs first.
EXPLAINED = [
    "int_customer_transaction_features",
    "dim_customer",
    "join_star_fact_dims",
    "mart_transaction_behavior",
    "mart_customer_risk",
    "mart_fraud_training_features",
    "baseline_rules_metrics",
    "graph_overview",
    "pr_curve",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == SQL_FREE
    assert set(ORACLES) <= set(QUERIES)
    assert set(SHAPES) == set(ORACLES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    columns = [c for c, _ in columns_of(SHAPES[name])]
    got = Counter(repr(tuple(r)) for r in bind(name)(spark, DATA).select(*columns).collect())
    listed = ", ".join(columns)
    want = Counter(
        repr(r) for r in duck.execute(f"select {listed} from ({oracle(name)})").fetchall()
    )
    assert got == want
    assert got, "the comparison must not be empty"


@pytest.mark.parametrize("name", EXPLAINED)
def test_plans_have_no_cross_products(spark, name):
    plan = bind(name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_history_takes_one_shuffle_and_one_sort(spark, tmp_path):
    from ledgerwright import Products
    from ledgerwright.sources.orders_ledger import read_orders_ledger

    p = Products(read_orders_ledger(spark, DATA)).frozen("fact")
    plan = p.features._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_scans_read_only_needed_columns(spark):
    from ledgerwright import Products
    from ledgerwright.sources.orders_ledger import read_orders_ledger

    p = Products(read_orders_ledger(spark, DATA)).frozen("fact")
    plan = p.ml_dataset.select("is_fraud", "dataset_split")._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]
    assert "destination_account_id" not in plan.split("ReadSchema")[1]
