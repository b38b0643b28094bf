"""Imputation, encoding and scaling with statistics fitted on the training rows.

Fitting returns small dictionaries (a few numbers per feature), applying is a
projection. Quantiles and modes are exact and computed distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import clip_log1p, finite_or_null, safe_divide
from ledgerwright.operators.ordered import exact_quantiles
from ledgerwright.session import freeze

# The inputs of the two model families.
CATEGORICAL = ["transaction_type", "destination_account_type"]
LINEAR_BOOLEAN = [
    "origin_has_sufficient_balance",
    "destination_has_recorded_balance",
    "is_merchant_destination",
    "has_previous_transaction",
]
LOGGED = [
    "origin_balance_before",
    "destination_balance_before",
    "amount_to_origin_balance_ratio",
    "amount_to_destination_balance_ratio",
]
LINEAR_NUMERIC = [
    "simulation_hour",
    "day_of_simulation_week",
    "log_transaction_amount",
    "log_origin_balance_before",
    "log_destination_balance_before",
    "log_amount_to_origin_balance_ratio",
    "log_amount_to_destination_balance_ratio",
    "customer_transaction_number",
    "transaction_count_last_10",
    "transaction_count_24h",
    "transaction_count_7d",
]
TREE_BOOLEAN = [
    "destination_has_recorded_balance",
    "is_merchant_destination",
    "has_previous_transaction",
]
TREE_NUMERIC = [
    "simulation_hour",
    "day_of_simulation_week",
    "log_transaction_amount",
    "origin_balance_before",
    "destination_balance_before",
    "amount_to_destination_balance_ratio",
    "customer_transaction_number",
    "transaction_count_last_10",
    "transaction_count_24h",
    "transaction_count_7d",
]
MISSING = "__MISSING__"
# Levels that a one-hot encoded column may have by default; more is an error.
MAXIMUM_LEVELS = 1_000


def linear_inputs(dataset: DataFrame) -> DataFrame:
    """Inputs of the linear model: logged balances and ratios, doubles, label.

    Keeps the id and the split; everything else is pruned at the scan.
    """
    return _typed(with_logs(dataset), LINEAR_BOOLEAN, LINEAR_NUMERIC)


def with_logs(dataset: DataFrame) -> DataFrame:
    """`dataset` plus the logarithms of balances and ratios."""
    return dataset.withColumns({f"log_{c}": clip_log1p(F.col(c)) for c in LOGGED})


def tree_inputs(
    dataset: DataFrame,
    boolean: Sequence[str] = tuple(TREE_BOOLEAN),
    numeric: Sequence[str] = tuple(TREE_NUMERIC),
) -> DataFrame:
    """Inputs of the tree models: raw scales, missing categories spelled out, label."""
    filled = dataset.withColumns({c: F.coalesce(c, F.lit(MISSING)) for c in CATEGORICAL})
    return _typed(filled, boolean, numeric)


def _typed(df: DataFrame, boolean: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    return df.select(
        "transaction_id",
        "dataset_split",
        *CATEGORICAL,
        *[F.col(c).cast("double").alias(c) for c in boolean],
        *[finite_or_null(F.col(c)).alias(c) for c in numeric],
        F.col("is_fraud").cast("double").alias("label"),
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value): the commonest non-NULL value, the smallest among ties."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    counted = (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.*")
        .filter("value is not null")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    commonest_first = F.struct((-F.col("n")).alias("rarity"), "value")
    return counted.groupBy("feature").agg(F.min_by("value", commonest_first).alias("value"))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) of every column, exact, NULLs ignored."""
    return exact_quantiles(df, columns, {"median": 0.5})


def category_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value): the distinct non-NULL values of every categorical column."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    )
    return (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.*")
        .filter("value is not null")
        .distinct()
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, deviation): mean and population standard deviation per column."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("deviation"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.explode(F.array(*columns)).alias("cell")).select("cell.*")


def one_hot(
    value: Column, feature: str, levels: Sequence[str], drop_first: bool
) -> dict[str, Column]:
    """One 0/1 column per level in alphabetical order; an unknown level is all zeros."""
    kept = sorted(levels)[1:] if drop_first else sorted(levels)
    return {f"{feature}_{level}": (value == level).cast("double") for level in kept}


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: class counts, positive-class scale, balanced weight of each class."""
    positive, rows = F.count_if(F.col(label) == 1), F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        positive.alias("positives"),
        safe_divide(rows - positive, positive).alias("scale_positive"),
        safe_divide(rows, 2 * positive).alias("weight_positive"),
        safe_divide(rows, 2 * (rows - positive)).alias("weight_negative"),
    )


@dataclass
class Preprocessor:
    """Fitted statistics; `transform` turns input rows into filled, encoded columns."""

    categorical: Sequence[str]
    boolean: Sequence[str]
    numeric: Sequence[str]
    drop_first: bool
    scale: bool
    modes: Mapping[str, str] = field(default_factory=dict)
    medians: Mapping[str, float] = field(default_factory=dict)
    maximum_levels: int = MAXIMUM_LEVELS
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    moments: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Preprocessor:
        """Collect a bounded handful of statistics: one or a few per feature."""
        self.modes = {
            r.feature: r.value
            for r in most_frequent(train, [*self.categorical, *self.boolean]).collect()
        }
        self.medians = {r.feature: r.median for r in medians(train, self.numeric).collect()}
        # Counted before they are collected: at most `maximum_levels` for each column.
        levels = freeze(category_levels(train, self.categorical), "levels")
        for r in levels.groupBy("feature").count().collect():
            if r["count"] > self.maximum_levels:
                raise ValueError(
                    f"{r.feature} has {r['count']} levels; maximum_levels is {self.maximum_levels}"
                )
        found = levels.collect()
        self.levels = {
            c: sorted(r.value for r in found if r.feature == c) for c in self.categorical
        }
        if self.scale:
            filled = train.select(*[self._filled(c).alias(c) for c in self.numeric])
            self.moments = {
                r.feature: (r.mean, r.deviation)
                for r in moments(filled, self.numeric).collect()
            }
        return self

    def _filled(self, column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(float(self.medians.get(column, 0.0))))

    def columns(self) -> dict[str, Column]:
        """Name and expression of every model input, in vector order."""
        result: dict[str, Column] = {}
        for c in self.categorical:
            value = F.coalesce(F.col(c), F.lit(self.modes.get(c)))
            result.update(one_hot(value, c, self.levels[c], self.drop_first))
        for c in self.boolean:
            result[c] = F.coalesce(F.col(c), F.lit(float(self.modes.get(c, 0.0))))
        for c in self.numeric:
            value = self._filled(c)
            if self.scale:
                mean, deviation = self.moments[c]
                # A constant feature is centred only.
                value = (value - F.lit(mean)) / F.lit(deviation or 1.0)
            result[c] = value
        return result

    def transform(self, df: DataFrame) -> DataFrame:
        """Id, split, label and the model inputs."""
        inputs = [c.alias(name) for name, c in self.columns().items()]
        return df.select("transaction_id", "dataset_split", "label", *inputs)


def linear_preprocessor() -> Preprocessor:
    """Preprocessing of the linear model: reference level dropped, numbers standardised."""
    return Preprocessor(CATEGORICAL, LINEAR_BOOLEAN, LINEAR_NUMERIC, drop_first=True, scale=True)


def tree_preprocessor(
    boolean: Sequence[str] = tuple(TREE_BOOLEAN),
    numeric: Sequence[str] = tuple(TREE_NUMERIC),
) -> Preprocessor:
    """Preprocessing of the tree models: all levels kept, numbers unscaled."""
    return Preprocessor(CATEGORICAL, boolean, numeric, drop_first=False, scale=False)
