"""The column contracts of every product and the suite that checks them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import count_where
from ledgerwright.operators import checks

# Accepted categories.
TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
DESTINATIONS = ["CUSTOMER", "MERCHANT"]
FAMILIES = ["CASH", "PAYMENT", "TRANSFER"]
DIRECTIONS = ["CREDIT", "DEBIT"]
ROLES = ["ORIGIN_ONLY", "DESTINATION_ONLY", "ORIGIN_AND_DESTINATION"]
LEVELS = ["LOW", "MEDIUM", "HIGH"]
SPLITS = ["TRAIN", "VALIDATION", "TEST"]


@dataclass
class Contract:
    """What the columns of one product promise.

    `references` maps a column to (product, column[, condition]).
    """

    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: Mapping[str, Sequence[str]] = field(default_factory=dict)
    references: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


# The promises of every product.
CONTRACTS = {
    "staged": Contract(
        not_null=[
            "simulation_step", "transaction_type", "transaction_amount", "origin_account_id",
            "destination_account_id", "is_fraud", "is_flagged_fraud",
        ],
        accepted={"transaction_type": TYPES},
    ),
    "enriched": Contract(
        not_null=[
            "simulation_day", "simulation_hour", "destination_account_type",
            "origin_balance_delta", "destination_balance_delta",
        ],
        accepted={"destination_account_type": DESTINATIONS},
    ),
    "fact": Contract(
        not_null=[
            "transaction_id", "simulation_step", "simulation_day", "simulation_hour",
            "transaction_type", "transaction_amount", "origin_account_id",
            "destination_account_id", "destination_account_type", "is_fraud",
            "is_flagged_fraud",
        ],
        unique=["transaction_id"],
        accepted={"transaction_type": TYPES, "destination_account_type": DESTINATIONS},
        references={
            "simulation_day": ("dim_simulation_day", "simulation_day"),
            "transaction_type": ("transaction_types", "transaction_type"),
            "origin_account_id": ("dim_customer", "customer_id"),
            "destination_account_id": (
                "dim_customer", "customer_id", "destination_account_type = 'CUSTOMER'",
            ),
        },
    ),
    "features": Contract(
        not_null=[
            "transaction_id", "origin_account_id", "customer_transaction_number",
            "simulation_day", "transaction_count_last_10", "historical_transaction_count",
            "transaction_count_24h", "transaction_count_7d",
        ],
        unique=["transaction_id"],
        references={"transaction_id": ("fact", "transaction_id")},
    ),
    "dim_customer": Contract(
        not_null=[
            "customer_id", "first_seen_step", "last_seen_step", "first_seen_day",
            "last_seen_day", "originated_transaction_count", "received_transaction_count",
            "total_involved_transaction_count", "customer_role",
        ],
        unique=["customer_id"],
        accepted={"customer_role": ROLES},
    ),
    "dim_simulation_day": Contract(
        not_null=[
            "simulation_day", "simulation_week", "day_of_simulation_week",
            "first_simulation_step", "last_simulation_step", "observed_hour_count",
            "is_complete_day",
        ],
        unique=["simulation_day"],
    ),
    "dim_transaction_type": Contract(
        not_null=[
            "transaction_type", "transaction_family", "balance_direction", "description",
        ],
        unique=["transaction_type"],
        accepted={"transaction_family": FAMILIES, "balance_direction": DIRECTIONS},
    ),
    "mart_fraud_by_transaction_type": Contract(
        not_null=[
            "transaction_type", "transaction_count", "transaction_amount_total",
            "transaction_amount_average", "fraudulent_transaction_count",
            "flagged_transaction_count", "detected_fraud_count", "missed_fraud_count",
            "fraudulent_transaction_amount", "fraud_rate_percent",
        ],
        unique=["transaction_type"],
        accepted={"transaction_type": TYPES},
    ),
    "mart_fraud_daily": Contract(
        not_null=[
            "simulation_day", "simulation_week", "transaction_count",
            "transaction_amount_total", "fraudulent_transaction_count",
            "fraudulent_transaction_amount", "fraud_rate_percent",
            "rolling_7d_transaction_count", "rolling_7d_fraud_count",
            "rolling_7d_fraud_rate_percent", "cumulative_transaction_count",
            "cumulative_fraud_count", "cumulative_fraudulent_amount",
        ],
        unique=["simulation_day"],
        references={"simulation_day": ("dim_simulation_day", "simulation_day")},
    ),
    "mart_customer_risk": Contract(
        not_null=[
            "customer_id", "first_seen_day", "last_seen_day", "customer_role",
            "transaction_count", "transaction_amount_total", "transaction_amount_average",
            "maximum_transaction_amount", "average_hours_between_transactions",
            "maximum_transaction_count_24h", "fraudulent_transaction_count",
            "fraudulent_transaction_amount", "high_value_anomaly_count",
            "maximum_amount_zscore", "maximum_amount_to_average_ratio",
            "fraud_rate_percent", "customer_risk_level", "customer_risk_rank",
        ],
        unique=["customer_id"],
        accepted={"customer_role": ROLES, "customer_risk_level": LEVELS},
        references={"customer_id": ("dim_customer", "customer_id")},
    ),
    "mart_transaction_behavior": Contract(
        not_null=[
            "simulation_day", "simulation_week", "day_of_simulation_week",
            "is_complete_day", "transaction_type", "transaction_family",
            "balance_direction", "customer_role", "transaction_count",
            "distinct_customer_count", "transaction_amount_total",
            "transaction_amount_average", "fraudulent_transaction_count",
            "fraudulent_transaction_amount", "flagged_transaction_count",
            "fraud_rate_percent",
        ],
        accepted={
            "transaction_family": FAMILIES, "balance_direction": DIRECTIONS,
            "customer_role": ROLES,
        },
        references={
            "simulation_day": ("dim_simulation_day", "simulation_day"),
            "transaction_type": ("dim_transaction_type", "transaction_type"),
        },
    ),
    "training_features": Contract(
        not_null=[
            "transaction_id", "origin_account_id", "destination_account_id",
            "simulation_step", "simulation_hour", "simulation_week",
            "day_of_simulation_week", "transaction_type", "transaction_family",
            "balance_direction", "destination_account_type", "transaction_amount",
            "log_transaction_amount", "origin_balance_before",
            "destination_balance_before", "origin_has_sufficient_balance",
            "destination_has_recorded_balance", "is_merchant_destination", "is_transfer",
            "is_cash_transaction", "is_higher_fraud_risk_type",
            "customer_transaction_number", "has_previous_transaction",
            "transaction_count_last_10", "has_full_10_transaction_history",
            "historical_transaction_count", "transaction_count_24h",
            "transaction_count_7d", "baseline_rule_flag", "is_fraud", "simulation_day",
        ],
        unique=["transaction_id"],
        accepted={
            "transaction_family": FAMILIES, "balance_direction": DIRECTIONS,
            "destination_account_type": DESTINATIONS,
        },
        references={
            "transaction_id": ("fact", "transaction_id"),
            "origin_account_id": ("dim_customer", "customer_id"),
            "transaction_type": ("dim_transaction_type", "transaction_type"),
            "simulation_day": ("dim_simulation_day", "simulation_day"),
        },
    ),
    "ml_dataset": Contract(
        not_null=["transaction_id", "simulation_step", "dataset_split", "is_fraud"],
        unique=["transaction_id"],
        accepted={"dataset_split": SPLITS},
        references={"transaction_id": ("training_features", "transaction_id")},
    ),
}

# Products written before the suite runs, bases first: each is read several times.
FROZEN = [
    "fact", "features", "hourly", "dim_customer", "dim_simulation_day",
    "mart_customer_risk", "mart_transaction_behavior", "training_features",
]


def column_rules(df: DataFrame, contract: Contract) -> DataFrame:
    """(check_name, column_name, failures) of all single-column rules, from one pass."""
    rules = {("not_null", c): F.col(c).isNull() for c in contract.not_null}
    rules |= {
        ("accepted_values", c): ~F.col(c).isin(*values)
        for c, values in contract.accepted.items()
    }
    cells = [
        F.struct(
            F.lit(check).alias("check_name"),
            F.lit(column).alias("column_name"),
            count_where(rule).alias("failures"),
        )
        for (check, column), rule in rules.items()
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def contract_report(products, contracts: Mapping[str, Contract] | None = None) -> DataFrame:
    """(table_name, check_name, column_name, failures) of every promise.

    Failures are rows, for uniqueness repeated values.
    """
    products.frozen(*FROZEN)
    parts = []
    for table, contract in (contracts or CONTRACTS).items():
        df = getattr(products, table)
        found = [column_rules(df, contract)]
        for column in contract.unique:
            found.append(_single("unique", column, checks.unique(df, [column]), None))
        for column, (parent, parent_key, *condition) in contract.references.items():
            orphans = checks.orphan_keys(
                df,
                column,
                getattr(products, parent),
                parent_key,
                F.expr(condition[0]) if condition else None,
            )
            found.append(_single("relationships", column, orphans, "row_count"))
        parts += [part.withColumn("table_name", F.lit(table)) for part in found]
    return reduce(DataFrame.unionByName, parts)


def _single(check: str, column: str, violations: DataFrame, weight: str | None) -> DataFrame:
    count = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    return violations.agg(count.alias("failures")).select(
        F.lit(check).alias("check_name"), F.lit(column).alias("column_name"), "failures"
    )
