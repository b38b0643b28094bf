"""Consistency checks of the data products. Each returns the violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.functions import count_where, ratio
from ledgerwright.operators import checks
from ledgerwright.operators.ordered import global_rank
from ledgerwright.plans.marts import ANOMALY_RATIO, RISK_KEYS
from ledgerwright.plans.training import CASH_TYPES, RISKY_TYPES, split_of_step

TOLERANCE = 1e-6


def any_of(*conditions: Column) -> Column:
    """True when any condition is true; an undecided condition is not a violation."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def deviates(stored: Column, expected: Column) -> Column:
    """The stored value is missing, superfluous or further off than the tolerance."""
    return (stored.isNull() != expected.isNull()) | F.coalesce(
        F.abs(stored - expected) > TOLERANCE, F.lit(False)
    )


def money_negative() -> Column:
    """A negative amount or balance."""
    money = [
        "transaction_amount",
        "origin_balance_before",
        "origin_balance_after",
        "destination_balance_before",
        "destination_balance_after",
    ]
    return any_of(*[F.col(c) < 0 for c in money])


def negative_balances(staged: DataFrame) -> DataFrame:
    """Staged rows with a negative amount or balance."""
    return staged.filter(money_negative())


def time_out_of_range() -> Column:
    """A day before the first or an hour outside 0..23."""
    return any_of(F.col("simulation_day") < 1, ~F.col("simulation_hour").between(0, 23))


def invalid_time(enriched: DataFrame) -> DataFrame:
    """Rows before day one or outside the 24 hours of a day."""
    return enriched.filter(time_out_of_range())


def row_count_mismatch(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Both row counts when they differ."""
    left_count, right_count = (
        df.agg(F.count(F.lit(1)).alias("row_count")) for df in (left, right)
    )
    return checks.differing_totals(left_count, right_count, ["row_count"], names)


def duplicate_sequence(features: DataFrame) -> DataFrame:
    """Accounts that carry a sequence number twice."""
    return checks.unique(features, ["origin_account_id", "customer_transaction_number"])


def sequence_broken() -> Column:
    """The link to the previous transaction contradicts the number."""
    number = F.col("customer_transaction_number")
    hours = F.col("hours_since_previous_transaction")
    links = [
        F.col(c)
        for c in (
            "previous_transaction_amount",
            "previous_transaction_step",
            "hours_since_previous_transaction",
            "days_since_previous_transaction",
        )
    ]
    elapsed = F.col("simulation_step") - F.col("previous_transaction_step")
    return any_of(
        number < 1,
        *[(number > 1) == link.isNull() for link in links],
        elapsed < 0,
        hours != elapsed,
        deviates(F.col("days_since_previous_transaction"), hours / 24.0),
    )


def inconsistent_sequence(features: DataFrame) -> DataFrame:
    """Rows whose link to the previous transaction contradicts their number."""
    return features.filter(sequence_broken())


def history_broken() -> Column:
    """History counts, averages or derived values do not fit together."""
    amount = F.col("transaction_amount").cast("double")
    earlier, last = F.col("historical_transaction_count"), F.col("transaction_count_last_10")
    day, week = F.col("transaction_count_24h"), F.col("transaction_count_7d")
    average, deviation = F.col("customer_average_amount"), F.col("std_last_10_transactions")
    zscore = F.when(
        deviation > 0, (amount - F.col("avg_last_10_transactions")) / deviation
    )
    return any_of(
        earlier != F.col("customer_transaction_number") - 1,
        last != F.least(earlier, F.lit(10)),
        F.least(last, day, week) < 0,
        day > week,
        week > earlier,
        *[
            F.col(c).isNull() == (earlier > 0)
            for c in (
                "customer_average_amount",
                "cumulative_transaction_value",
                "amount_vs_customer_average",
            )
        ],
        deviation.isNull() == (last >= 2),
        deviates(F.col("amount_vs_customer_average"), amount - average),
        deviates(F.col("amount_to_customer_average_ratio"), ratio(amount, average)),
        deviates(F.col("amount_zscore_last_10"), zscore),
    )


def inconsistent_history(features: DataFrame) -> DataFrame:
    """Rows whose history counts, averages or derived values do not fit together."""
    return features.filter(history_broken())


def customer_broken() -> Column:
    """Seen backwards in time, or counts that do not add up."""
    originated, received, total = (
        F.col(f"{kind}_transaction_count")
        for kind in ("originated", "received", "total_involved")
    )
    return any_of(
        F.col("first_seen_step") > F.col("last_seen_step"),
        F.col("first_seen_day") > F.col("last_seen_day"),
        F.least(originated, received) < 0,
        originated + received != total,
        total <= 0,
    )


def inconsistent_customers(customers: DataFrame) -> DataFrame:
    """Customers seen backwards in time or with counts that do not add up."""
    return customers.filter(customer_broken())


def calendar_broken() -> Column:
    """A calendar value out of range, or wrongly called complete."""
    hours = F.col("observed_hour_count")
    return any_of(
        F.col("simulation_week") < 1,
        ~F.col("day_of_simulation_week").between(1, 7),
        F.col("first_simulation_step") > F.col("last_simulation_step"),
        ~hours.between(1, 24),
        F.col("is_complete_day") != (hours == 24),
    )


def inconsistent_days(days: DataFrame) -> DataFrame:
    """Calendar rows outside their ranges or wrongly called complete."""
    return days.filter(calendar_broken())


def type_metrics_broken() -> Column:
    """Fraud, detection and rate columns contradict each other."""
    frauds, detected = F.col("fraudulent_transaction_count"), F.col("detected_fraud_count")
    missed, rate = F.col("missed_fraud_count"), F.col("fraud_detection_rate_percent")
    return any_of(
        F.col("transaction_count") <= 0,
        frauds > F.col("transaction_count"),
        F.greatest(detected, missed) > frauds,
        detected + missed != frauds,
        detected > F.col("flagged_transaction_count"),
        ~F.col("fraud_rate_percent").between(0, 100),
        rate.isNull() == (frauds > 0),
        ~rate.between(0, 100),
    )


def inconsistent_type_metrics(by_type: DataFrame) -> DataFrame:
    """Types whose fraud, detection and rate columns contradict each other."""
    return by_type.filter(type_metrics_broken())


def inconsistent_daily(daily: DataFrame) -> DataFrame:
    """Days whose stored previous, rolling or running values differ from recomputed ones."""
    in_order = Window.orderBy("simulation_day")
    week = in_order.rowsBetween(-6, Window.currentRow)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count, frauds = F.col("transaction_count"), F.col("fraudulent_transaction_count")
    rate = F.col("fraud_rate_percent")
    expected = daily.withColumns(
        {
            "expected_previous_rate": F.lag("fraud_rate_percent").over(in_order),
            "expected_rolling_count": F.sum(count).over(week),
            "expected_rolling_frauds": F.sum(frauds).over(week),
            "expected_running_count": F.sum(count).over(so_far),
            "expected_running_frauds": F.sum(frauds).over(so_far),
        }
    )
    previous = F.col("expected_previous_rate")
    return expected.filter(
        any_of(
            count <= 0,
            ~frauds.between(0, count),
            ~rate.between(0, 100),
            ~F.col("rolling_7d_fraud_rate_percent").between(0, 100),
            F.col("rolling_7d_transaction_count") != F.col("expected_rolling_count"),
            F.col("rolling_7d_fraud_count") != F.col("expected_rolling_frauds"),
            F.col("cumulative_transaction_count") != F.col("expected_running_count"),
            F.col("cumulative_fraud_count") != F.col("expected_running_frauds"),
            deviates(F.col("previous_day_fraud_rate_percent"), previous),
            deviates(F.col("fraud_rate_change_percentage_points"), rate - previous),
        )
    )


def inconsistent_customer_risk(risk: DataFrame) -> DataFrame:
    """Customers whose measures, level or rank break the rules of the risk mart."""
    frauds, anomalies = (
        F.col("fraudulent_transaction_count"),
        F.col("high_value_anomaly_count"),
    )
    anomalous = (anomalies > 0) | (F.col("maximum_amount_to_average_ratio") >= ANOMALY_RATIO)
    level = F.when(frauds > 0, "HIGH").when(anomalous, "MEDIUM").otherwise("LOW")
    return global_rank(risk, RISK_KEYS, "expected_risk_rank").filter(
        any_of(
            F.col("transaction_count") < 2,
            F.col("first_seen_day") > F.col("last_seen_day"),
            ~frauds.between(0, F.col("transaction_count")),
            F.col("fraudulent_transaction_amount") < 0,
            anomalies < 0,
            ~F.col("fraud_rate_percent").between(0, 100),
            F.col("average_hours_between_transactions") < 0,
            F.col("customer_risk_rank") != F.col("expected_risk_rank"),
            F.col("customer_risk_level") != level,
        )
    )


def duplicate_behavior(behavior: DataFrame) -> DataFrame:
    """Repeated (day, type, role) combinations."""
    return checks.unique(behavior, ["simulation_day", "transaction_type", "customer_role"])


TOTALS = [
    "transaction_count",
    "transaction_amount_total",
    "fraudulent_transaction_count",
    "fraudulent_transaction_amount",
    "flagged_transaction_count",
]


def mart_totals(mart: DataFrame) -> DataFrame:
    """The five totals every mart must share, as one row."""
    return mart.agg(*[F.sum(m).alias(m) for m in TOTALS])


def behavior_totals_mismatch(hourly: DataFrame, behavior: DataFrame) -> DataFrame:
    """Totals of the behaviour mart against those of the fact rows."""
    return checks.differing_totals(
        mart_totals(hourly), mart_totals(behavior), TOTALS, ("fact", "mart")
    )


def mart_agreement(daily: DataFrame, by_type: DataFrame, behavior: DataFrame) -> DataFrame:
    """(measure, agrees): whether the three marts show the same five totals."""
    tables = {"daily": daily, "type": by_type, "behavior": behavior}
    rows = [
        mart_totals(df).select(
            *[F.col(m).cast("decimal(38,2)").alias(m) for m in TOTALS]
        ).unpivot([], TOTALS, "measure", "total")
        for df in tables.values()
    ]
    stacked = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return stacked.groupBy("measure").agg(
        (F.min("total") == F.max("total")).alias("agrees")
    )


def training_broken() -> Column:
    """A feature differs from its definition."""
    amount = F.col("transaction_amount")
    origin, destination = F.col("origin_balance_before"), F.col("destination_balance_before")
    kind = F.col("transaction_type")
    earlier, last = F.col("historical_transaction_count"), F.col("transaction_count_last_10")
    flags = {
        "origin_has_sufficient_balance": origin >= amount,
        "destination_has_recorded_balance": destination > 0,
        "is_merchant_destination": F.col("destination_account_type") == "MERCHANT",
        "is_transfer": kind == "TRANSFER",
        "is_cash_transaction": kind.isin(*CASH_TYPES),
        "is_higher_fraud_risk_type": kind.isin(*RISKY_TYPES),
        "has_previous_transaction": F.col("previous_transaction_amount").isNotNull(),
        "has_full_10_transaction_history": last == 10,
    }
    return any_of(
        amount < 0,
        F.col("log_transaction_amount") < 0,
        deviates(F.col("log_transaction_amount"), F.log1p(amount)),
        deviates(F.col("amount_to_origin_balance_ratio"), ratio(amount, origin)),
        deviates(F.col("amount_to_destination_balance_ratio"), ratio(amount, destination)),
        *[F.col(name) != expected for name, expected in flags.items()],
        earlier != F.col("customer_transaction_number") - 1,
        last != F.least(earlier, F.lit(10)),
        F.col("transaction_count_24h") > F.col("transaction_count_7d"),
        F.col("transaction_count_7d") > earlier,
    )


def inconsistent_training(training: DataFrame) -> DataFrame:
    """Training rows with a feature that differs from its definition."""
    return training.filter(training_broken())


def training_totals_mismatch(fact: DataFrame, training: DataFrame) -> DataFrame:
    """Counts and amounts of the training table against those of the fact rows."""

    def totals(df: DataFrame, flag: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(F.col("transaction_amount").cast("decimal(18,2)")).alias("amount_total"),
            count_where(F.col("is_fraud")).alias("fraud_count"),
            count_where(F.col(flag)).alias("flagged_count"),
        )

    return checks.differing_totals(
        totals(fact, "is_flagged_fraud"),
        totals(training, "baseline_rule_flag"),
        ["row_count", "amount_total", "fraud_count", "flagged_count"],
        ("fact", "training"),
    )


def split_misplaced() -> Column:
    """The stored split is not the one of the row's step."""
    return F.col("dataset_split") != split_of_step()


def misplaced_splits(dataset: DataFrame) -> DataFrame:
    """Rows whose split does not fit their step."""
    return dataset.filter(split_misplaced())


def one_class_splits(dataset: DataFrame) -> DataFrame:
    """Splits that lack frauds or legitimate rows."""
    return (
        dataset.groupBy("dataset_split")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            count_where(F.col("is_fraud")).alias("fraud_count"),
            count_where(~F.col("is_fraud")).alias("legitimate_count"),
        )
        .filter((F.col("fraud_count") == 0) | (F.col("legitimate_count") == 0))
    )


def count_violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(check_name, table_name, failures) of all row rules of a table, from one pass."""
    counted = df.agg(*[count_where(rule).alias(check) for check, rule in rules.items()])
    return counted.unpivot([], list(rules), "check_name", "failures").select(
        "check_name", F.lit(table).alias("table_name"), "failures"
    )


def count_rows(failures: DataFrame, table: str, check: str) -> DataFrame:
    """The same for a check that returns its violations as rows."""
    return failures.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), "failures"
    )
