import hashlib

import pytest
from pyspark.errors import PySparkException

from ledgerwright.plans.staging import enrich, stage, to_fact


def test_types_and_ids_are_trimmed(ledger):
    raw = ledger(
        {"type": "  cash_out ", "nameorig": "\tC7\t"},
        {"type": "Transfer\n", "namedest": " \t C8 "},
        {"type": "\tpayment"},
    )
    rows = stage(raw).collect()
    assert [r.transaction_type for r in rows] == ["CASH_OUT", "TRANSFER", "PAYMENT"]
    assert rows[0].origin_account_id == "C7"
    assert rows[1].destination_account_id == "C8"


def test_bad_money_raises_unless_lenient(ledger):
    raw = ledger({"amount": "n/a"})
    with pytest.raises(PySparkException):
        stage(raw).collect()
    assert stage(raw, lenient=True).first().transaction_amount is None


def test_days_and_hours(ledger):
    raw = ledger(*[{"step": s} for s in (1, 24, 25, 168, 169)])
    rows = enrich(stage(raw)).orderBy("simulation_step").collect()
    assert [r.simulation_day for r in rows] == [1, 1, 2, 7, 8]
    assert [r.simulation_hour for r in rows] == [0, 23, 0, 23, 0]


def test_steps_before_the_first_fall_on_day_zero(ledger):
    row = enrich(stage(ledger({"step": 0}))).first()
    assert (row.simulation_day, row.simulation_hour) == (0, -1)


def test_destination_kinds_and_balance_changes(ledger):
    raw = ledger({"namedest": "M1"}, {"namedest": "C1"}, {"namedest": "X1"})
    rows = enrich(stage(raw)).collect()
    assert [r.destination_account_type for r in rows] == ["MERCHANT", "CUSTOMER", "UNKNOWN"]
    assert str(rows[0].origin_balance_delta) == "-10.00"


def test_transaction_id_is_the_digest_of_the_attributes(ledger):
    text = "1|PAYMENT|10.00|C1|100.00|90.00|M1|0.00|0.00|false|false"
    expected = hashlib.md5(text.encode()).hexdigest().upper()
    assert to_fact(ledger({})).first().transaction_id == expected


def test_identical_rows_share_an_id(ledger):
    ids = [r.transaction_id for r in to_fact(ledger({}, {}, {"step": 2})).collect()]
    assert ids[0] == ids[1] != ids[2]
