"""The feature windows against a direct Python evaluation, whole and in blocks."""

import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerwright.operators.history import account_history
from ledgerwright.operators.ordered import BLOCK, range_layout
from ledgerwright.plans.staging import to_fact

COLUMNS = [
    "customer_transaction_number",
    "previous_transaction_amount",
    "previous_transaction_step",
    "next_transaction_amount",
    "hours_since_previous_transaction",
    "transaction_count_last_10",
    "avg_last_10_transactions",
    "std_last_10_transactions",
    "historical_transaction_count",
    "customer_average_amount",
    "cumulative_transaction_value",
    "transaction_count_24h",
    "transaction_count_7d",
    "amount_to_customer_average_ratio",
    "amount_zscore_last_10",
]


def expected(rows):
    accounts = defaultdict(list)
    for r in rows:
        accounts[r.origin_account_id].append(r)
    out = []
    for members in accounts.values():
        members.sort(key=lambda r: (r.simulation_step, r.transaction_id))
        amounts = [
            None if r.transaction_amount is None else float(r.transaction_amount)
            for r in members
        ]
        for i, r in enumerate(members):
            last = [a for a in amounts[max(0, i - 10) : i] if a is not None]
            prior = [a for a in amounts[:i] if a is not None]
            average = sum(prior) / len(prior) if prior else None
            deviation = statistics.stdev(last) if len(last) > 1 else None
            earlier = [m.simulation_step for m in members]
            step = r.simulation_step
            previous = members[i - 1] if i else None
            out.append(
                (
                    r.transaction_id,
                    i + 1,
                    amounts[i - 1] if i else None,
                    previous.simulation_step if i else None,
                    amounts[i + 1] if i + 1 < len(amounts) else None,
                    step - previous.simulation_step if i else None,
                    min(i, 10),
                    sum(last) / len(last) if last else None,
                    deviation,
                    i,
                    average,
                    sum(prior) if prior else None,
                    sum(step - 24 <= s <= step - 1 for s in earlier),
                    sum(step - 168 <= s <= step - 1 for s in earlier),
                    amounts[i] / average if average and amounts[i] else None,
                    (amounts[i] - sum(last) / len(last)) / deviation
                    if deviation and amounts[i] is not None
                    else None,
                )
            )
    return out


def canonical(rows):
    def plain(v):
        if v is None:
            return "-"
        if isinstance(v, str):
            return v
        v = float(v)
        return f"{0.0 if math.isclose(v, 0.0, abs_tol=1e-7) else v:.4f}"

    return sorted(tuple(plain(v) for v in row) for row in rows)


def compare(features, rows):
    got = features.select("transaction_id", *COLUMNS).collect()
    assert canonical(got) == canonical(expected(rows))


@pytest.fixture(scope="module")
def skewed(spark, ledger):
    """One account with most rows, a group of identical rows, several small accounts."""
    seed = random.Random(7)
    rows = [
        {"step": seed.randint(1, 200), "amount": f"{seed.randint(1, 999)}.25", "nameorig": "C1"}
        for _ in range(300)
    ]
    rows += [{"step": 50, "amount": "77.00", "nameorig": "C1"}] * 120
    rows += [{"step": 30, "amount": "5.00", "nameorig": "C2"}] * 90
    # Amounts that could not be read.
    rows += [{"step": s, "amount": "n/a", "nameorig": "C1"} for s in range(1, 200, 9)]
    rows += [
        {"step": seed.randint(1, 400), "amount": f"{seed.randint(1, 99)}.50", "nameorig": f"C{n}"}
        for n in range(3, 12)
        for _ in range(seed.randint(1, 15))
    ]
    fact = to_fact(ledger(*rows), lenient=True).repartition(8)
    return fact.cache(), fact.collect()


def test_whole_accounts_match_direct_evaluation(skewed):
    fact, rows = skewed
    compare(account_history(fact), rows)


@pytest.mark.parametrize("hot_rows", [1, 80, 200])
def test_blocks_match_direct_evaluation(skewed, hot_rows, many_blocks):
    fact, rows = skewed
    compare(account_history(fact, hot_rows=hot_rows), rows)


def test_blocks_keep_the_columns_and_types(skewed):
    fact, _ = skewed
    assert account_history(fact, hot_rows=1).dtypes == account_history(fact).dtypes


def test_identical_rows_span_several_blocks(skewed, many_blocks):
    fact, _ = skewed
    laid = range_layout(
        fact.filter("origin_account_id = 'C2'").withColumn(
            "tie", F.monotonically_increasing_id()
        ),
        "simulation_step",
        "transaction_id",
        "tie",
    )
    sizes = [r["count"] for r in laid.groupBy(BLOCK).count().collect()]
    assert sum(sizes) == 90 and len(sizes) >= 4 and max(sizes) < 45


def test_same_hour_rows_count_as_rows_but_not_as_time(spark, ledger):
    fact = to_fact(
        ledger(
            {"step": 10, "amount": "1.00"},
            {"step": 10, "amount": "2.00"},
            {"step": 34, "amount": "3.00"},
            {"step": 35, "amount": "4.00"},
        )
    )
    rows = account_history(fact).orderBy("customer_transaction_number").collect()
    assert [r.transaction_count_last_10 for r in rows] == [0, 1, 2, 3]
    assert [r.transaction_count_24h for r in rows] == [0, 0, 2, 1]


def test_equal_amounts_have_no_zscore(ledger):
    fact = to_fact(ledger(*[{"step": s} for s in (1, 2, 3)]))
    rows = account_history(fact).orderBy("simulation_step").collect()
    assert [r.std_last_10_transactions for r in rows] == [None, None, 0.0]
    assert rows[2].amount_zscore_last_10 is None
    assert rows[0].customer_average_amount is None


@pytest.fixture()
def few_partitions(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def test_blocks_are_bounded_by_rows(spark, skewed, few_partitions, many_blocks, monkeypatch):
    from ledgerwright.operators import history

    layouts = []
    original = history.range_layout

    def watched(*args, **kwargs):
        layouts.append(original(*args, **kwargs))
        return layouts[-1]

    monkeypatch.setattr(history, "range_layout", watched)
    fact, rows = skewed
    compare(account_history(fact, hot_rows=40), rows)
    sizes = [r["count"] for r in layouts[0].groupBy(BLOCK).count().collect()]
    assert len(sizes) > 6 and max(sizes) <= 120


def test_rows_without_an_account_are_split_too(spark, skewed, many_blocks):
    fact, _ = skewed
    unknown = F.col("origin_account_id") == "C1"
    holed = fact.withColumn(
        "origin_account_id", F.when(~unknown, F.col("origin_account_id"))
    )
    whole, split = account_history(holed), account_history(holed, hot_rows=50)
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()
    none = split.filter("origin_account_id is null")
    assert none.count() == fact.filter(unknown).count()
    assert none.agg(F.max("customer_transaction_number")).first()[0] == none.count()
