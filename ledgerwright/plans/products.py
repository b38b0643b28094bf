"""All data products of one ledger, built lazily from each other."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.operators import checks
from ledgerwright.operators.history import account_history
from ledgerwright.operators.skew import HOT_ROWS
from ledgerwright.plans import dimensions, marts, quality, training
from ledgerwright.plans.staging import enrich, stage, with_transaction_id
from ledgerwright.session import freeze
from ledgerwright.sources.ledger import TRANSACTION_TYPES, transaction_types
from ledgerwright.sources.sinks import write_partitioned

# Which products a named group builds. The marts group is built from
# its own products only; the others include everything they depend on.
GROUPS = {
    "dashboard": [
        "mart_fraud_by_transaction_type",
        "mart_fraud_daily",
        "mart_customer_risk",
        "mart_transaction_behavior",
    ],
    "daily": [
        "transaction_types",
        "staged",
        "enriched",
        "fact",
        "dim_simulation_day",
        "mart_fraud_daily",
    ],
    "dimensions": ["dim_customer", "dim_simulation_day", "dim_transaction_type"],
    "ml": [
        "transaction_types",
        "staged",
        "enriched",
        "fact",
        "features",
        "dim_simulation_day",
        "dim_transaction_type",
        "training_features",
        "ml_dataset",
    ],
}
TYPE_NAMES = [row[0] for row in TRANSACTION_TYPES]
# Transaction-level tables, stored in one directory per simulated day.
BY_DAY = {"fact", "features", "training_features"}


class Products:
    """The products of a raw ledger as DataFrames; nothing runs before an action,
    except that ranked and skew-split products freeze intermediate results."""

    def __init__(self, raw: DataFrame, lenient: bool = False, hot_rows: int = HOT_ROWS):
        self.raw = raw
        self.lenient = lenient
        self.hot_rows = hot_rows

    def frozen(self, *names: str) -> Products:
        """Write the named products to the shared scratch folder, so that everything
        built on them reads the stored rows. Order matters: first the bases."""
        for name in names:
            self.__dict__[name] = freeze(getattr(self, name), name)
        return self

    @cached_property
    def staged(self) -> DataFrame:
        return stage(self.raw, self.lenient)

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich(self.staged)

    @cached_property
    def fact(self) -> DataFrame:
        return with_transaction_id(self.enriched)

    @cached_property
    def features(self) -> DataFrame:
        return account_history(self.fact, self.hot_rows)

    @cached_property
    def hourly(self) -> DataFrame:
        return marts.hourly_totals(self.fact)

    @cached_property
    def transaction_types(self) -> DataFrame:
        return transaction_types(self.raw.sparkSession)

    @cached_property
    def dim_transaction_type(self) -> DataFrame:
        return self.transaction_types

    @cached_property
    def dim_customer(self) -> DataFrame:
        return dimensions.dim_customer(self.fact)

    @cached_property
    def dim_simulation_day(self) -> DataFrame:
        return dimensions.dim_simulation_day(self.hourly)

    @cached_property
    def mart_fraud_by_transaction_type(self) -> DataFrame:
        return marts.mart_fraud_by_transaction_type(self.hourly)

    @cached_property
    def mart_fraud_daily(self) -> DataFrame:
        return marts.mart_fraud_daily(self.hourly, self.dim_simulation_day)

    @cached_property
    def mart_customer_risk(self) -> DataFrame:
        return marts.mart_customer_risk(self.features, self.dim_customer)

    @cached_property
    def mart_transaction_behavior(self) -> DataFrame:
        return marts.mart_transaction_behavior(
            self.fact, self.dim_customer, self.transaction_types, self.dim_simulation_day
        )

    @cached_property
    def training_features(self) -> DataFrame:
        return training.training_features(self.features, self.transaction_types)

    @cached_property
    def ml_dataset(self) -> DataFrame:
        return training.temporal_split(self.training_features)

    @cached_property
    def labelled_rows(self) -> DataFrame:
        """The dataset without history columns; building it looks at no account."""
        return training.temporal_split(
            training.row_features(self.fact, self.transaction_types)
        )

    @cached_property
    def modeling_rows(self) -> DataFrame:
        return training.modeling_rows(self.ml_dataset)


def build(products: Products, group: str, target: str) -> DataFrame:
    """Write every product of a group below `target`; (product, row_count) as stored.

    Each product is stored with all its columns, the transaction-level ones partitioned
    by day, and whatever is built on it afterwards reads the stored table. Bases outside
    the group that several of its products share are frozen once.
    """
    names = GROUPS[group]
    if group == "dashboard":
        products.frozen("fact", "features", "hourly")
    elif group == "dimensions":
        products.frozen("fact")
    spark = products.raw.sparkSession
    for name in names:
        path, product = f"{target}/{name}", getattr(products, name)
        if name in BY_DAY:
            write_partitioned(product, path)
        else:
            product.write.mode("overwrite").parquet(path)
        stored = spark.read.schema(product.schema).parquet(path)
        products.__dict__[name] = stored.select(*product.columns)
        if name == "fact":
            products.frozen("hourly")
    return reduce(
        DataFrame.unionByName,
        [
            spark.read.parquet(f"{target}/{name}")
            .agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(name).alias("product"), "row_count")
            for name in names
        ],
    )


def run_checks(p: Products) -> DataFrame:
    """(check_name, table_name, failures) of the whole check suite.

    Tables read by several checks are frozen first; the row rules of a table share one
    pass over it.
    """
    p.frozen(
        "fact",
        "features",
        "hourly",
        "dim_customer",
        "dim_simulation_day",
        "mart_customer_risk",
        "mart_transaction_behavior",
        "training_features",
    )
    row_rules = [
        ("staged", p.staged, {"negative_balances": quality.money_negative()}),
        ("enriched", p.enriched, {"invalid_time": quality.time_out_of_range()}),
        (
            "features",
            p.features,
            {
                "sequence_consistent": quality.sequence_broken(),
                "history_consistent": quality.history_broken(),
            },
        ),
        ("dim_customer", p.dim_customer, {"history_consistent": quality.customer_broken()}),
        (
            "dim_simulation_day",
            p.dim_simulation_day,
            {"calendar_consistent": quality.calendar_broken()},
        ),
        (
            "mart_fraud_by_transaction_type",
            p.mart_fraud_by_transaction_type,
            {"metrics_consistent": quality.type_metrics_broken()},
        ),
        (
            "training_features",
            p.training_features,
            {"features_consistent": quality.training_broken()},
        ),
        ("ml_dataset", p.ml_dataset, {"splits_temporal": quality.split_misplaced()}),
    ]
    customers = (p.dim_customer, "customer_id")
    to_customer = F.col("destination_account_type") == "CUSTOMER"
    row_checks = {
        ("fact", "source_row_count"): quality.row_count_mismatch(
            p.raw, p.fact, ("source", "fact")
        ),
        ("features", "feature_row_count"): quality.row_count_mismatch(
            p.fact, p.features, ("fact", "features")
        ),
        ("fact", "unique_id"): checks.unique(p.fact, ["transaction_id"]),
        ("fact", "accepted_types"): checks.accepted_values(
            p.fact, "transaction_type", TYPE_NAMES
        ),
        ("fact", "accepted_destinations"): checks.accepted_values(
            p.fact, "destination_account_type", ["CUSTOMER", "MERCHANT"]
        ),
        ("fact", "not_null"): checks.not_null(p.fact, p.fact.columns),
        ("fact", "customer_exists"): checks.orphan_keys(
            p.fact, "origin_account_id", *customers
        ),
        ("fact", "destination_exists"): checks.orphan_keys(
            p.fact, "destination_account_id", *customers, to_customer
        ),
        ("fact", "type_exists"): checks.orphan_keys(
            p.fact, "transaction_type", p.transaction_types, "transaction_type"
        ),
        ("features", "sequence_unique"): quality.duplicate_sequence(p.features),
        ("mart_fraud_daily", "windows_consistent"): quality.inconsistent_daily(
            p.mart_fraud_daily
        ),
        ("mart_customer_risk", "rank_consistent"): quality.inconsistent_customer_risk(
            p.mart_customer_risk
        ),
        ("mart_transaction_behavior", "grain_unique"): quality.duplicate_behavior(
            p.mart_transaction_behavior
        ),
        ("mart_transaction_behavior", "totals_preserved"): quality.behavior_totals_mismatch(
            p.hourly, p.mart_transaction_behavior
        ),
        ("training_features", "totals_preserved"): quality.training_totals_mismatch(
            p.fact, p.training_features
        ),
        ("ml_dataset", "splits_have_both_classes"): quality.one_class_splits(p.ml_dataset),
    }
    counted = [quality.count_violations(df, table, rules) for table, df, rules in row_rules]
    counted += [
        quality.count_rows(failures, table, check)
        for (table, check), failures in row_checks.items()
    ]
    return reduce(DataFrame.unionByName, counted)
