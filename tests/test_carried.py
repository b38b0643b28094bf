"""Features loaded day by day against the full build."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerwright.operators import carried
from ledgerwright.operators.carried import FeatureStore
from ledgerwright.operators.history import account_history
from ledgerwright.plans.staging import to_fact
from ledgerwright.session import freeze


@pytest.fixture(scope="module")
def facts(ledger):
    seed = random.Random(7)
    rows = []
    for i in range(420):
        # One account has a third of the rows, some rows have no account or no amount.
        account = seed.choice(["C1", None, *[f"C{n}" for n in range(2, 12)]])
        step = seed.choice([1, 24, 25, 200]) if i % 5 == 0 else seed.randint(1, 290)
        rows.append(
            {
                "step": step,
                "nameorig": "C1" if i % 3 == 0 else account,
                "amount": None if i % 11 == 0 else f"{seed.randint(1, 400)}.25",
                "oldbalanceorg": f"{i}.00",
            }
        )
    return to_fact(ledger(*rows)).cache()


def rows_of(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("hot_rows", [2_000_000, 20])
def test_loads_by_day_equal_the_full_build(spark, facts, tmp_path, hot_rows):
    store = FeatureStore(spark, str(tmp_path / "store"), hot_rows)
    late = F.col("oldbalanceorg") if "oldbalanceorg" in facts.columns else F.col("origin_balance_before")
    # Of the days 1, 5 and 9 the last hours, and some rows of any hour, come a load later.
    for end in (1, 5, 9):
        held_back = (F.col("simulation_step") > 24 * end - 6) | (F.pmod(late.cast("int"), F.lit(4)) == 0)
        store.load(facts.filter(F.col("simulation_day") <= end).filter(
            (F.col("simulation_day") < end) | ~held_back
        ))
    store.load(facts)
    store.load(facts)
    want = account_history(facts)
    assert rows_of(store.read(), want.columns) == rows_of(want, want.columns)


def test_one_row_per_account_is_all_that_is_carried(spark, facts, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.load(facts.filter("simulation_day <= 9"))
    state = store.state.read()
    accounts = facts.filter("simulation_day <= 8").select("origin_account_id").distinct().count()
    assert state.count() == accounts
    assert state.filter("size(tail) > 10 or size(hours) > 168").isEmpty()
    # What comes next needs no older facts.
    store.load(facts.filter("simulation_day >= 9"))
    want = account_history(facts)
    assert rows_of(store.read(), want.columns) == rows_of(want, want.columns)


def test_a_load_that_dies_changes_nothing(spark, facts, tmp_path, monkeypatch):
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.load(facts.filter("simulation_day <= 5"))
    want = account_history(facts.filter("simulation_day <= 5"))
    before = rows_of(store.read(), want.columns)
    assert before == rows_of(want, want.columns)

    def dies(*given, **named):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(store.features, "write", dies)
        with pytest.raises(RuntimeError):
            store.load(facts)
    assert rows_of(store.read(), want.columns) == before
    store.load(facts)
    want = account_history(facts)
    assert rows_of(store.read(), want.columns) == rows_of(want, want.columns)


def test_nothing_to_load(spark, facts, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    assert store.load(facts.limit(0)) is None


def test_new_rows_are_shuffled_once(spark, facts, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.load(facts.filter("simulation_day <= 6"))
    store.load(facts.filter("simulation_day between 6 and 9"))
    # A row whose next one is known for good is read without a join.
    seen = store.features.read()
    following = F.ceil((F.col("simulation_step") + F.lead("hours_since_previous_transaction").over(
        Window.partitionBy("origin_account_id").orderBy("simulation_step", "transaction_id")
    )) / 24)
    known = seen.withColumn("next_day", following).filter("simulation_day > 6 and next_day < 9")
    assert not known.isEmpty() and known.filter(carried.OPEN).isEmpty()
    state = store.state.read(store.features.manifest().notes["state"])
    rows = freeze(facts.filter("simulation_day >= 9"))
    # The new rows and those of the state: by account, and the state and its accounts to meet.
    plan = carried.continued_history(rows, state, 13)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5
