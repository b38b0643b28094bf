"""The labelled dataset: features, temporal split, sampling, modelling columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import hash_bucket, ratio, with_calendar

# Last steps of the training and validation periods, the share of
# legitimate training rows that is kept, and the columns handed to models.
TRAIN_END_STEP = 322
VALIDATION_END_STEP = 375
SAMPLE_PERCENT = 5
SPLITS = ["TRAIN", "VALIDATION", "TEST"]
RISKY_TYPES = ["TRANSFER", "CASH_OUT"]
CASH_TYPES = ["CASH_IN", "CASH_OUT"]
TRAINING_COLUMNS = [
    "transaction_id",
    "origin_account_id",
    "destination_account_id",
    "simulation_step",
    "simulation_hour",
    "simulation_week",
    "day_of_simulation_week",
    "transaction_type",
    "transaction_family",
    "balance_direction",
    "destination_account_type",
    "transaction_amount",
    "log_transaction_amount",
    "origin_balance_before",
    "destination_balance_before",
    "amount_to_origin_balance_ratio",
    "amount_to_destination_balance_ratio",
    "origin_has_sufficient_balance",
    "destination_has_recorded_balance",
    "is_merchant_destination",
    "is_transfer",
    "is_cash_transaction",
    "is_higher_fraud_risk_type",
    "customer_transaction_number",
    "has_previous_transaction",
    "previous_transaction_amount",
    "hours_since_previous_transaction",
    "days_since_previous_transaction",
    "transaction_count_last_10",
    "avg_last_10_transactions",
    "std_last_10_transactions",
    "has_full_10_transaction_history",
    "historical_transaction_count",
    "customer_average_amount",
    "cumulative_transaction_value",
    "amount_vs_customer_average",
    "amount_to_customer_average_ratio",
    "amount_zscore_last_10",
    "transaction_count_24h",
    "transaction_count_7d",
    "baseline_rule_flag",
    "is_fraud",
    "simulation_day",
]
NOT_MODELLED = [
    "origin_account_id",
    "destination_account_id",
    "is_transfer",
    "is_cash_transaction",
    "is_higher_fraud_risk_type",
    "has_full_10_transaction_history",
    "simulation_day",
]
HISTORY_COLUMNS = [
    "customer_transaction_number",
    "has_previous_transaction",
    "previous_transaction_amount",
    "hours_since_previous_transaction",
    "days_since_previous_transaction",
    "transaction_count_last_10",
    "avg_last_10_transactions",
    "std_last_10_transactions",
    "has_full_10_transaction_history",
    "historical_transaction_count",
    "customer_average_amount",
    "cumulative_transaction_value",
    "amount_vs_customer_average",
    "amount_to_customer_average_ratio",
    "amount_zscore_last_10",
    "transaction_count_24h",
    "transaction_count_7d",
]
MODEL_COLUMNS = [c for c in TRAINING_COLUMNS if c not in NOT_MODELLED] + ["dataset_split"]


def training_features(features: DataFrame, types: DataFrame) -> DataFrame:
    """One row per transaction with what is known before or at its time, plus the label."""
    history = {
        "has_previous_transaction": F.col("previous_transaction_amount").isNotNull(),
        "has_full_10_transaction_history": F.col("transaction_count_last_10") == 10,
    }
    doubles = ["previous_transaction_amount", "cumulative_transaction_value"]
    return _labelled(
        features.withColumns(history | {c: F.col(c).cast("double") for c in doubles}),
        types,
        TRAINING_COLUMNS,
    )


def row_features(fact: DataFrame, types: DataFrame) -> DataFrame:
    """`training_features` without the account's history: a projection of the fact rows,
    for profiles, rules and metrics that need no more."""
    return _labelled(fact, types, [c for c in TRAINING_COLUMNS if c not in HISTORY_COLUMNS])


def _labelled(rows: DataFrame, types: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that follow from a row alone.

    The type lookup is the only join. Week and weekday are functions of the day, which
    the rows hold, so the calendar is not read.
    """
    families = types.select("transaction_type", "transaction_family", "balance_direction")
    amount = F.col("transaction_amount")
    origin, destination = (
        F.col("origin_balance_before"),
        F.col("destination_balance_before"),
    )
    kind = F.col("transaction_type")
    derived = {
        "log_transaction_amount": F.log1p(amount.cast("double")),
        "amount_to_origin_balance_ratio": ratio(amount, origin),
        "amount_to_destination_balance_ratio": ratio(amount, destination),
        "origin_has_sufficient_balance": origin >= amount,
        "destination_has_recorded_balance": destination > 0,
        "is_merchant_destination": F.col("destination_account_type") == "MERCHANT",
        "is_transfer": kind == "TRANSFER",
        "is_cash_transaction": kind.isin(*CASH_TYPES),
        "is_higher_fraud_risk_type": kind.isin(*RISKY_TYPES),
        "baseline_rule_flag": F.col("is_flagged_fraud"),
    }
    as_double = [
        "transaction_amount",
        "origin_balance_before",
        "destination_balance_before",
    ]
    return (
        with_calendar(rows.join(F.broadcast(families), "transaction_type"))
        .withColumns(derived)
        .withColumns({c: F.col(c).cast("double") for c in as_double})
        .select(*columns)
    )


def split_of_step(
    train_end: int = TRAIN_END_STEP,
    validation_end: int = VALIDATION_END_STEP,
    step: str = "simulation_step",
) -> Column:
    """The split of a row: everything up to `train_end`, then `validation_end`, then the rest."""
    return (
        F.when(F.col(step) <= train_end, "TRAIN")
        .when(F.col(step) <= validation_end, "VALIDATION")
        .otherwise("TEST")
    )


def temporal_split(
    df: DataFrame, train_end: int = TRAIN_END_STEP, validation_end: int = VALIDATION_END_STEP
) -> DataFrame:
    """Add `dataset_split`."""
    return df.withColumn("dataset_split", split_of_step(train_end, validation_end))


def downsample(
    df: DataFrame,
    keep: Column,
    percent: int = SAMPLE_PERCENT,
    hex_id: str = "transaction_id",
) -> DataFrame:
    """All rows of `keep` and a repeatable `percent` of the others, chosen by id."""
    return df.filter(keep | (hash_bucket(F.col(hex_id)) < percent))


def modeling_rows(dataset: DataFrame, percent: int = SAMPLE_PERCENT) -> DataFrame:
    """The modelling columns of all splits, with the training split sampled."""
    return sampled_rows(dataset, percent).select(*MODEL_COLUMNS)


def sampled_rows(dataset: DataFrame, percent: int = SAMPLE_PERCENT) -> DataFrame:
    """All columns of all splits, with the legitimate training rows sampled."""
    in_training = F.col("dataset_split") == "TRAIN"
    return downsample(dataset, F.col("is_fraud") | ~in_training, percent)


def ablated(columns: list[str]) -> list[str]:
    """A feature list without the two features that state the balance rule outright."""
    rule = {"amount_to_origin_balance_ratio", "origin_has_sufficient_balance"}
    return [c for c in columns if c not in rule]
