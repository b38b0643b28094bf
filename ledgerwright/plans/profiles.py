"""Profiles of the raw ledger and of the labelled dataset, and rule baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import confusion_flags, count_where, fraud_rate, safe_divide
from ledgerwright.operators.ordered import exact_quantiles
from ledgerwright.plans.training import RISKY_TYPES

# Quantile of the high-value rule, tolerance (in money) of the drain rule.
HIGH_VALUE_QUANTILE = 0.99
DRAIN_TOLERANCE = 0.01


def raw_profile(raw: DataFrame) -> DataFrame:
    """Size, time span, amounts and fraud share of the raw ledger.

    Folded to one row per type first, so the distinct count costs no extra shuffle.
    """
    by_type = raw.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        count_where(F.col("isfraud") == 1).alias("frauds"),
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"),
        F.count("amount").alias("amounts"),
    )
    total, frauds = F.sum("n"), F.sum("frauds")
    return by_type.agg(
        total.alias("transaction_count"),
        F.min("first_step").alias("first_step"),
        F.max("last_step").alias("last_step"),
        F.count("type").alias("distinct_types"),
        frauds.alias("fraud_count"),
        F.sum("total").alias("total_amount"),
        safe_divide(F.sum("total"), F.sum("amounts")).alias("average_amount"),
        fraud_rate(frauds, total).alias("fraud_percent"),
    )


def raw_fraud_summary(raw: DataFrame) -> DataFrame:
    """Count, time span and fraud share of the raw ledger."""
    frauds = count_where(F.col("isfraud") == 1)
    return raw.agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        frauds.alias("fraud_count"),
        fraud_rate(frauds, F.count(F.lit(1))).alias("fraud_percent"),
    )


def type_totals(staged: DataFrame) -> DataFrame:
    """Count, amount and frauds per type; the measure compared between storage formats."""
    return staged.groupBy("transaction_type").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("transaction_amount").alias("transaction_amount_total"),
        count_where(F.col("is_fraud")).alias("fraudulent_transaction_count"),
    )


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, counting repetitions, with the side's name."""
    return (
        left.exceptAll(right)
        .withColumn("only_in", F.lit("left"))
        .unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
    )


def class_share(dataset: DataFrame, by: str, *extra: Column) -> DataFrame:
    """Rows, frauds and fraud percentage per value of `by`."""
    frauds = count_where(F.col("is_fraud"))
    return dataset.groupBy(by).agg(
        *extra,
        F.count(F.lit(1)).alias("transaction_count"),
        frauds.alias("fraud_count"),
        fraud_rate(frauds, F.count(F.lit(1))).alias("fraud_rate_percent"),
    )


def split_summary(dataset: DataFrame) -> DataFrame:
    """Time span and class balance of every split."""
    return class_share(
        dataset,
        "dataset_split",
        F.min("simulation_step").alias("minimum_step"),
        F.max("simulation_step").alias("maximum_step"),
    )


def type_summary(dataset: DataFrame) -> DataFrame:
    """Class balance of every transaction type."""
    return class_share(dataset, "transaction_type")


def amount_by_class(dataset: DataFrame) -> DataFrame:
    """Mean, median and upper quantiles of the amount per class."""
    amounts = dataset.select("is_fraud", F.col("transaction_amount").alias("amount"))
    exact = F.sum(F.col("amount").cast("decimal(18,2)"))
    means = amounts.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        safe_divide(exact, F.count("amount")).alias("average_amount"),
    )
    quantiles = exact_quantiles(
        amounts,
        ["amount"],
        {"median_amount": 0.5, "percentile_90": 0.9, "percentile_99": 0.99},
        by=["is_fraud"],
    ).drop("feature")
    return means.join(quantiles, "is_fraud")


def history_by_class(dataset: DataFrame) -> DataFrame:
    """Mean and median of the history features per class."""
    history = {
        "previous_transactions": "historical_transaction_count",
        "transactions_24h": "transaction_count_24h",
        "transactions_7d": "transaction_count_7d",
    }
    means = dataset.groupBy("is_fraud").agg(
        *[F.avg(column).alias(f"average_{label}") for label, column in history.items()],
        F.avg("hours_since_previous_transaction").alias("average_hours_since_previous"),
    )
    medians = exact_quantiles(
        dataset, list(history.values()), {"median": 0.5}, by=["is_fraud"]
    )
    wide = medians.groupBy("is_fraud").agg(
        *[
            F.max(F.when(F.col("feature") == column, F.col("median"))).alias(f"median_{label}")
            for label, column in history.items()
        ]
    )
    return means.join(wide, "is_fraud")


def high_value_threshold(dataset: DataFrame, quantile: float = HIGH_VALUE_QUANTILE) -> DataFrame:
    """One row: the amount quantile of the legitimate training rows."""
    legitimate = dataset.filter((F.col("dataset_split") == "TRAIN") & ~F.col("is_fraud"))
    return exact_quantiles(legitimate, ["transaction_amount"], {"threshold": quantile}).select(
        "threshold"
    )


def with_threshold(dataset: DataFrame) -> DataFrame:
    """Every row next to the high-value threshold, which enters as a scalar subquery."""
    return dataset.withColumn("threshold", high_value_threshold(dataset).scalar())


def high_value_rule(dataset: DataFrame) -> DataFrame:
    """Recall and false alerts of the high-value rule in every split."""
    fraud = F.col("is_fraud")
    high = F.col("transaction_amount") >= F.col("threshold")
    return (
        with_threshold(dataset)
        .groupBy("dataset_split")
        .agg(
            F.max("threshold").alias("high_value_threshold"),
            count_where(fraud & high).alias("detected_frauds"),
            count_where(fraud).alias("total_frauds"),
            safe_divide(count_where(fraud & high), count_where(fraud), 100.0).alias(
                "fraud_recall_percent"
            ),
            count_where(~fraud & high).alias("legitimate_alerts"),
        )
    )


def rule_predictions() -> dict[str, Column]:
    """The four baseline rules as predicates over dataset rows with a threshold."""
    risky = F.col("is_higher_fraud_risk_type")
    high = F.col("transaction_amount") >= F.col("threshold")
    return {
        "original_rule": F.col("baseline_rule_flag"),
        "risky_type": risky,
        "high_value": high,
        "risky_type_and_high_value": risky & high,
    }


def stacked_rule_predictions(dataset: DataFrame) -> DataFrame:
    """One row per transaction and rule: split, label, prediction. One scan."""
    rules = [
        F.struct(F.lit(name).alias("rule_name"), predicted.alias("predicted_fraud"))
        for name, predicted in rule_predictions().items()
    ]
    return (
        with_threshold(dataset)
        .select("dataset_split", "is_fraud", F.explode(F.array(*rules)).alias("rule"))
        .select("dataset_split", "is_fraud", "rule.*")
    )


def with_rates(confusion: DataFrame) -> DataFrame:
    """Alert count and the usual percentages next to the four confusion cells."""
    tp, fp, fn, tn = (
        F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative")
    )
    return confusion.withColumns(
        {
            "generated_alerts": tp + fp,
            "precision_percent": safe_divide(tp, tp + fp, 100.0),
            "recall_percent": safe_divide(tp, tp + fn, 100.0),
            "specificity_percent": safe_divide(tn, tn + fp, 100.0),
            "f1_percent": safe_divide(tp, 2 * tp + fp + fn, 200.0),
            "alert_rate_percent": safe_divide(tp + fp, tp + fp + fn + tn, 100.0),
        }
    )


def baseline_rules_metrics(dataset: DataFrame) -> DataFrame:
    """Confusion and rates of every rule in every split.

    All rules are counted side by side per split and only the counts are unfolded, so
    the dataset is read once and never multiplied.
    """
    rules = rule_predictions()
    cells = []
    for name, predicted in rules.items():
        flags = confusion_flags(predicted, F.col("is_fraud"))
        cells.append(
            F.struct(
                F.lit(name).alias("rule_name"), *[c.alias(n) for n, c in flags.items()]
            )
        )
    counted = (
        with_threshold(dataset).groupBy("dataset_split").agg(F.array(*cells).alias("rules"))
    )
    confusion = counted.select("dataset_split", F.explode("rules").alias("rule")).select(
        "dataset_split", "rule.*"
    )
    return with_rates(confusion)


def drain_rule_metrics(dataset: DataFrame, tolerance: float = DRAIN_TOLERANCE) -> DataFrame:
    """Audit rule per split: a risky type that moves (about) the whole origin balance."""
    amount, balance = F.col("transaction_amount"), F.col("origin_balance_before")
    drains = (
        F.col("transaction_type").isin(*RISKY_TYPES)
        & (F.abs(amount - balance) <= tolerance)
    )
    flags = confusion_flags(drains, F.col("is_fraud"))
    confusion = dataset.groupBy("dataset_split").agg(*[c.alias(n) for n, c in flags.items()])
    return with_rates(confusion)


def dataset_inspection(dataset: DataFrame) -> DataFrame:
    """Rows, frauds, fraud share and column count of every split."""
    return class_share(dataset, "dataset_split").withColumn(
        "column_count", F.lit(len(dataset.columns)).cast("bigint")
    )


def dataset_version(dataset: DataFrame) -> DataFrame:
    """A content version per split that changes exactly when its rows change.

    Row hashes are added up, so neither order nor file layout matters and repeated
    rows still count.
    """
    columns = [F.col(c) for c in sorted(dataset.columns)]
    # A hash skips NULLs, so which columns are NULL is hashed too.
    shape = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    first, second = (
        F.sum(F.xxhash64(F.lit(seed), shape, *columns).cast("decimal(28,0)"))
        for seed in ("first", "second")
    )
    content = F.concat_ws(
        ":",
        F.count(F.lit(1)).cast("string"),
        first.cast("string"),
        second.cast("string"),
    )
    return dataset.groupBy("dataset_split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.substring(F.sha2(content, 256), 1, 16).alias("version"),
    )
