"""Published column types, shared by the Spark queries and the SQL.

One letter per column: `i` bigint, `s` text, `b` boolean, `m` exact decimal shown as
double, `d<n>` double rounded to n digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = (
    "transaction_id:s simulation_step:i simulation_hour:i transaction_type:s "
    "transaction_amount:m origin_account_id:s origin_balance_before:m "
    "origin_balance_after:m origin_balance_delta:m destination_account_id:s "
    "destination_account_type:s destination_balance_before:m destination_balance_after:m "
    "destination_balance_delta:m is_fraud:b is_flagged_fraud:b simulation_day:i"
)
HISTORY = (
    "customer_transaction_number:i previous_transaction_amount:m previous_transaction_step:i "
    "next_transaction_amount:m hours_since_previous_transaction:i "
    "days_since_previous_transaction:d6 transaction_count_last_10:i "
    "avg_last_10_transactions:d6 std_last_10_transactions:d4 historical_transaction_count:i "
    "customer_average_amount:d6 cumulative_transaction_value:m transaction_count_24h:i "
    "transaction_count_7d:i amount_vs_customer_average:d6 "
    "amount_to_customer_average_ratio:d6 amount_zscore_last_10:d6"
)
RAW = (
    "step:i type:s amount:m nameorig:s oldbalanceorg:m newbalanceorig:m namedest:s "
    "oldbalancedest:m newbalancedest:m isfraud:i isflaggedfraud:i"
)
STAGED = (
    "simulation_step:i transaction_type:s transaction_amount:m origin_account_id:s "
    "origin_balance_before:m origin_balance_after:m destination_account_id:s "
    "destination_balance_before:m destination_balance_after:m is_fraud:b is_flagged_fraud:b"
)
MODEL = (
    "transaction_id:s simulation_step:i simulation_hour:i simulation_week:i "
    "day_of_simulation_week:i transaction_type:s transaction_family:s balance_direction:s "
    "destination_account_type:s transaction_amount:m log_transaction_amount:d6 "
    "origin_balance_before:m destination_balance_before:m amount_to_origin_balance_ratio:d6 "
    "amount_to_destination_balance_ratio:d6 origin_has_sufficient_balance:b "
    "destination_has_recorded_balance:b is_merchant_destination:b "
    "customer_transaction_number:i has_previous_transaction:b previous_transaction_amount:m "
    "hours_since_previous_transaction:i days_since_previous_transaction:d6 "
    "transaction_count_last_10:i avg_last_10_transactions:d6 std_last_10_transactions:d4 "
    "historical_transaction_count:i customer_average_amount:d6 cumulative_transaction_value:m "
    "amount_vs_customer_average:d6 amount_to_customer_average_ratio:d6 "
    "amount_zscore_last_10:d6 transaction_count_24h:i transaction_count_7d:i "
    "baseline_rule_flag:b is_fraud:b dataset_split:s"
)
TRAINING = (
    MODEL.replace(" dataset_split:s", "")
    + " origin_account_id:s destination_account_id:s is_transfer:b is_cash_transaction:b "
    "is_higher_fraud_risk_type:b has_full_10_transaction_history:b simulation_day:i"
)
CONFUSION = (
    "true_positive:i false_positive:i false_negative:i true_negative:i generated_alerts:i "
)
DAILY = (
    "simulation_day:i simulation_week:i day_of_simulation_week:i is_complete_day:b "
    "transaction_count:i transaction_amount_total:m fraudulent_transaction_count:i "
    "fraudulent_transaction_amount:m average_fraudulent_transaction_amount:d6 "
    "flagged_transaction_count:i fraud_rate_percent:d6 previous_day_fraud_rate_percent:d6 "
    "rolling_7d_transaction_count:i rolling_7d_fraud_count:i cumulative_transaction_count:i "
    "cumulative_fraud_count:i cumulative_fraudulent_amount:m "
    "fraud_rate_change_percentage_points:d6 rolling_7d_fraud_rate_percent:d6"
)
BY_TYPE = (
    "transaction_type:s transaction_count:i transaction_amount_total:m "
    "transaction_amount_average:d6 fraudulent_transaction_count:i flagged_transaction_count:i "
    "detected_fraud_count:i missed_fraud_count:i fraudulent_transaction_amount:m "
    "fraud_rate_percent:m fraud_detection_rate_percent:m"
)
BEHAVIOR = (
    "simulation_day:i simulation_week:i day_of_simulation_week:i is_complete_day:b "
    "transaction_type:s transaction_family:s balance_direction:s customer_role:s "
    "transaction_count:i distinct_customer_count:i transaction_amount_total:m "
    "transaction_amount_average:d6 fraudulent_transaction_count:i "
    "fraudulent_transaction_amount:m flagged_transaction_count:i fraud_rate_percent:d6"
)
RISK = (
    "customer_id:s first_seen_day:i last_seen_day:i customer_role:s transaction_count:i "
    "transaction_amount_total:m transaction_amount_average:d6 maximum_transaction_amount:m "
    "average_hours_between_transactions:d6 maximum_transaction_count_24h:i "
    "fraudulent_transaction_count:i fraudulent_transaction_amount:m "
    "high_value_anomaly_count:i maximum_amount_zscore:d6 maximum_amount_to_average_ratio:d6 "
    "fraud_rate_percent:d6 customer_risk_level:s customer_risk_rank:i"
)
QUEUE = (
    "customer_risk_rank:i customer_id:s customer_risk_level:s customer_role:s "
    "transaction_count:i transaction_amount_total:m maximum_transaction_amount:m "
    "fraudulent_transaction_count:i fraudulent_transaction_amount:m high_value_anomaly_count:i"
)
CUSTOMER = (
    "customer_id:s first_seen_step:i last_seen_step:i first_seen_day:i last_seen_day:i "
    "originated_transaction_count:i received_transaction_count:i "
    "total_involved_transaction_count:i customer_role:s"
)
DAY = (
    "simulation_day:i simulation_week:i day_of_simulation_week:i first_simulation_step:i "
    "last_simulation_step:i observed_hour_count:i is_complete_day:b"
)
TOTALS = (
    "transaction_count:i transaction_amount_total:m fraudulent_transaction_count:i "
    "fraudulent_transaction_amount:m flagged_transaction_count:i "
)
SPLIT_SUMMARY = (
    "dataset_split:s minimum_step:i maximum_step:i transaction_count:i fraud_count:i "
    "fraud_rate_percent:d6"
)
METRICS = (
    "dataset_split:s threshold:d6 "
    + CONFUSION
    + "alert_rate_percent:d6 precision_percent:d6 recall_percent:d6 f1_percent:d6"
)
ID = "transaction_id:s "

SHAPES = {
    "raw_csv_scan": RAW,
    "parquet_scan_partitioned": FACT,
    "column_pruned_scan": (
        "simulation_hour:i day_of_simulation_week:i transaction_type:s "
        "destination_account_type:s log_transaction_amount:d6 origin_balance_before:m "
        "destination_balance_before:m amount_to_origin_balance_ratio:d6 "
        "amount_to_destination_balance_ratio:d6 origin_has_sufficient_balance:b "
        "destination_has_recorded_balance:b is_merchant_destination:b "
        "has_previous_transaction:b customer_transaction_number:i transaction_count_last_10:i "
        "transaction_count_24h:i transaction_count_7d:i is_fraud:b"
    ),
    "fact_partitioned_write": FACT,
    "fact_incremental_overwrite": FACT,
    "fact_full_refresh": FACT,
    "fact_schema_sync": FACT,
    "seed_transaction_types": (
        "transaction_type:s transaction_family:s balance_direction:s description:s "
        "transaction_count:i"
    ),
    "split_export_zstd": MODEL,
    "report_export": SPLIT_SUMMARY,
    "stg_transactions": STAGED,
    "stg_transactions_lenient": STAGED,
    "enrich_time": "origin_account_id:s simulation_step:i simulation_day:i simulation_hour:i",
    "enrich_account_type": "destination_account_id:s destination_account_type:s",
    "enrich_balance_delta": (
        "origin_account_id:s simulation_step:i origin_balance_delta:m "
        "destination_balance_delta:m"
    ),
    "transaction_id_md5": ID + "simulation_step:i origin_account_id:s",
    "safe_divide": ID + "quotient:d6 tripled:d6",
    "fraud_rate": "simulation_day:i fraud_rate_percent:d6",
    "rate_decimal_round": "simulation_step:i fraud_rate_percent:m",
    "simulation_calendar": "simulation_day:i simulation_week:i day_of_simulation_week:i",
    "log_amount": ID + "log_transaction_amount:d6",
    "balance_ratios": (
        ID + "amount_to_origin_balance_ratio:d6 amount_to_destination_balance_ratio:d6"
    ),
    "boolean_indicators": (
        ID + "origin_has_sufficient_balance:b destination_has_recorded_balance:b "
        "is_merchant_destination:b is_transfer:b is_cash_transaction:b "
        "is_higher_fraud_risk_type:b has_previous_transaction:b "
        "has_full_10_transaction_history:b"
    ),
    "category_order_key": "dataset_split:s split_order:i transaction_count:i",
    "clip_log1p": (
        ID + "log_origin_balance_before:d6 log_destination_balance_before:d6 "
        "log_amount_to_origin_balance_ratio:d6 log_amount_to_destination_balance_ratio:d6"
    ),
    "nonfinite_to_null": ID + "transaction_type:s is_fraud:m quotient:d6",
    "round_percent": "simulation_hour:i fraud_rate_percent:d6",
    "percent_axis_scale": "fraud_rate:d6",
    "filter_customer_destinations": ID + "destination_account_id:s",
    "having_min_transactions": "customer_id:s transaction_count:i",
    "filter_split": ID + "simulation_step:i dataset_split:s",
    "train_downsample": ID + "is_fraud:b",
    "filter_incremental_day": ID + "simulation_day:i",
    "range_validity": ID + "simulation_hour:i",
    "join_star_fact_dims": (
        ID + "customer_role:s transaction_family:s balance_direction:s simulation_week:i "
        "day_of_simulation_week:i is_complete_day:b"
    ),
    "join_features_dims": (
        ID + "transaction_family:s balance_direction:s simulation_week:i "
        "day_of_simulation_week:i"
    ),
    "join_features_customer": (
        "customer_id:s first_seen_day:i last_seen_day:i customer_role:s transaction_count:i "
        "transaction_amount_total:m"
    ),
    "join_daily_calendar": (
        "simulation_day:i simulation_week:i day_of_simulation_week:i is_complete_day:b "
        "transaction_count:i fraud_rate_percent:d6"
    ),
    "cross_join_scalar": ID + "transaction_amount:m threshold:d6 is_high:b",
    "cross_join_totals": "fact_count:i mart_count:i fact_amount:m mart_amount:m",
    "orphan_keys": "orphan_key:s row_count:i",
    "raw_profile": (
        "transaction_count:i first_step:i last_step:i distinct_types:i fraud_count:i "
        "total_amount:m average_amount:d2 fraud_percent:d4"
    ),
    "raw_fraud_summary": (
        "transaction_count:i first_step:i last_step:i fraud_count:i fraud_percent:d4"
    ),
    "agg_by_type_csv_vs_parquet": (
        "transaction_type:s transaction_count:i transaction_amount_total:m "
        "fraudulent_transaction_count:i differences:i"
    ),
    "conditional_count": (
        "transaction_type:s fraudulent_transaction_count:i flagged_transaction_count:i "
        "detected_fraud_count:i missed_fraud_count:i"
    ),
    "conditional_sum": "transaction_type:s fraudulent_transaction_amount:m",
    "conditional_avg": "simulation_day:i average_fraudulent_transaction_amount:d6",
    "dim_customer": CUSTOMER,
    "dim_simulation_day": DAY,
    "dim_transaction_type": (
        "transaction_type:s transaction_family:s balance_direction:s description:s "
        "transaction_count:i"
    ),
    "mart_fraud_by_transaction_type": BY_TYPE,
    "mart_fraud_daily": DAILY,
    "mart_customer_risk": RISK,
    "mart_transaction_behavior": BEHAVIOR,
    "count_distinct_in_group": (
        "simulation_day:i transaction_type:s customer_role:s distinct_customer_count:i"
    ),
    "bi_executive_summary": (
        TOTALS + "fraud_rate_percent:d6 average_daily_fraud_amount:d4 "
        "maximum_daily_fraud_amount:m"
    ),
    "bi_customer_risk_distribution": (
        "customer_risk_level:s risk_level_order:i customer_count:i transaction_count:i "
        "transaction_amount_total:m fraudulent_transaction_count:i "
        "fraudulent_transaction_amount:m high_value_anomaly_count:i fraud_rate_percent:d6 "
        "average_maximum_amount_zscore:d6"
    ),
    "bi_daily_transaction_type": (
        "simulation_day:i simulation_week:i day_of_simulation_week:i is_complete_day:b "
        "transaction_type:s transaction_family:s balance_direction:s "
        "distinct_customer_count:i fraud_rate_percent:d6 " + TOTALS
    ),
    "bi_risk_scatter": (
        "transaction_count:i customer_risk_level:s average_customer_amount:d4"
    ),
    "bi_fraud_heatmap": "simulation_day:i CASH_IN:i CASH_OUT:i DEBIT:i PAYMENT:i TRANSFER:i",
    "bi_daily_trend": (
        "simulation_day:i fraud_rate_percent:d6 rolling_7d_fraud_rate_percent:d6 "
        "fraud_rate_change_percentage_points:d6 cumulative_fraud_count:i"
    ),
    "bi_type_rates": "transaction_type:s fraud_rate_percent:m fraud_detection_rate_percent:m",
    "split_summary": SPLIT_SUMMARY,
    "type_summary": "transaction_type:s transaction_count:i fraud_count:i fraud_rate_percent:d6",
    "amount_by_class": (
        "is_fraud:b transaction_count:i average_amount:d4 median_amount:d4 percentile_90:d4 "
        "percentile_99:d4"
    ),
    "history_by_class": (
        "is_fraud:b average_previous_transactions:d6 median_previous_transactions:d6 "
        "average_transactions_24h:d6 median_transactions_24h:d6 average_transactions_7d:d6 "
        "median_transactions_7d:d6 average_hours_since_previous:d6"
    ),
    "high_value_rule": (
        "dataset_split:s high_value_threshold:d4 detected_frauds:i total_frauds:i "
        "fraud_recall_percent:d4 legitimate_alerts:i"
    ),
    "graph_overview": (
        "transaction_count:i directed_pair_count:i fraud_count:i self_loop_count:i "
        "total_transaction_amount:m average_transaction_amount:d6 minimum_step:i "
        "maximum_step:i node_count:i repeated_edge_count:i fraud_rate_percent:d6 "
        "graph_density:d12"
    ),
    "graph_degree_distribution": (
        "node_count:i average_degree:d6 median_degree:d6 maximum_degree:i degree_one_count:i"
    ),
    "dataset_inspection": (
        "dataset_split:s transaction_count:i fraud_count:i fraud_rate_percent:d6 "
        "column_count:i"
    ),
    "bi_dataset_metadata": "table_name:s row_count:i snapshot_id:i source:s is_synchronized:b",
    "tracked_build": "product:s row_count:i rebuilt:b",
    "distinct_customers_by_level": "level:s simulation_day:i transaction_type:s customers:i",
    "win_sequence": ID + "customer_transaction_number:i",
    "win_lag_amount_step": ID + "previous_transaction_amount:m previous_transaction_step:i",
    "win_lead_amount": ID + "next_transaction_amount:m",
    "win_rows_last_10": (
        ID + "transaction_count_last_10:i avg_last_10_transactions:d6 "
        "std_last_10_transactions:d4"
    ),
    "win_rows_expanding_prior": (
        ID + "historical_transaction_count:i customer_average_amount:d6 "
        "cumulative_transaction_value:m"
    ),
    "win_range_24h_7d": ID + "transaction_count_24h:i transaction_count_7d:i",
    "feat_recency": (
        ID + "hours_since_previous_transaction:i days_since_previous_transaction:d6"
    ),
    "feat_amount_vs_average": (
        ID + "amount_vs_customer_average:d6 amount_to_customer_average_ratio:d6"
    ),
    "feat_zscore_last_10": ID + "amount_zscore_last_10:d6",
    "int_customer_transaction_features": FACT + " " + HISTORY,
    "int_customer_transaction_features_incremental": FACT + " " + HISTORY,
    "win_partition_minmax_sum": (
        "customer_id:s simulation_step:i account_event_role:s first_seen_step:i "
        "last_seen_step:i originated_transaction_count:i"
    ),
    "win_dedup_first_row": "customer_id:s simulation_step:i account_event_role:s",
    "win_lag_unpartitioned": "simulation_day:i previous_day_fraud_rate_percent:d6",
    "win_rolling_7": (
        "simulation_day:i rolling_7d_transaction_count:i rolling_7d_fraud_count:i"
    ),
    "win_cumulative": (
        "simulation_day:i cumulative_transaction_count:i cumulative_fraud_count:i "
        "cumulative_fraudulent_amount:m"
    ),
    "win_rank_multi_key": "customer_id:s customer_risk_rank:i",
    "bi_top_risk_customers": RISK,
    "investigation_queue": QUEUE,
    "order_by_case": SPLIT_SUMMARY,
    "order_by_rate_desc": (
        "transaction_type:s transaction_count:i fraud_count:i fraud_rate_percent:d6"
    ),
    "union_all_account_events": (
        "customer_id:s simulation_step:i simulation_day:i account_event_role:s"
    ),
    "union_distinct_nodes": "account_id:s",
    "union_all_rules": "dataset_split:s is_fraud:b rule_name:s predicted_fraud:b",
    "mart_fraud_training_features": TRAINING,
    "mart_fraud_ml_dataset": TRAINING + " dataset_split:s",
    "modeling_columns": MODEL,
    "baseline_rules_metrics": (
        "dataset_split:s rule_name:s " + CONFUSION + "precision_percent:d4 recall_percent:d4 "
        "specificity_percent:d4 f1_percent:d4 alert_rate_percent:d4"
    ),
    "drain_rule_metrics": (
        "dataset_split:s " + CONFUSION + "precision_percent:d4 recall_percent:d4 f1_percent:d4"
    ),
    "class_weights": (
        "rows:i positives:i scale_positive:d6 weight_positive:d6 weight_negative:d6"
    ),
    "impute_median": "feature:s median:d6",
    "impute_most_frequent": "feature:s value:s",
    "one_hot": (
        ID + "transaction_type_CASH_OUT:m transaction_type_DEBIT:m transaction_type_PAYMENT:m "
        "transaction_type_TRANSFER:m destination_account_type_MERCHANT:m"
    ),
    "standardize": (
        ID + "simulation_hour:d6 log_transaction_amount:d6 "
        "log_amount_to_origin_balance_ratio:d6 customer_transaction_number:d6"
    ),
    "threshold_best_f1": "dataset_split:s threshold:d6 f1:d6",
    "pr_curve": (
        "dataset_split:s threshold:d6 true_positive:i generated_alerts:i precision:d6 recall:d6"
    ),
    "average_precision": "dataset_split:s average_precision:d6",
    "roc_auc": "dataset_split:s roc_auc:d6",
    "confusion_at_threshold": METRICS,
    "metrics_flatten": "name:s value:d6",
    "feature_ablation": (
        ID + "simulation_hour:i day_of_simulation_week:i log_transaction_amount:d6 "
        "origin_balance_before:m destination_balance_before:m "
        "amount_to_destination_balance_ratio:d6 destination_has_recorded_balance:b "
        "is_merchant_destination:b has_previous_transaction:b"
    ),
    "check_not_null": "column_name:s null_count:i",
    "check_unique": ID + "duplicate_count:i",
    "check_accepted_values": "unexpected_value:s row_count:i",
    "check_relationships": "orphan_key:s row_count:i",
    "check_non_negative_balances": STAGED,
    "check_valid_time": "origin_account_id:s simulation_step:i simulation_hour:i",
    "check_source_row_count": "source_row_count:i fact_row_count:i",
    "check_feature_row_count": "fact_row_count:i features_row_count:i",
    "check_sequence_unique": (
        "origin_account_id:s customer_transaction_number:i duplicate_count:i"
    ),
    "check_sequence_consistent": (
        ID + "customer_transaction_number:i previous_transaction_step:i"
    ),
    "check_history_consistent": ID + "customer_average_amount:d6",
    "check_dim_customer": CUSTOMER,
    "check_dim_day": DAY,
    "check_type_metrics": BY_TYPE,
    "check_daily_consistent": DAILY,
    "check_customer_risk": RISK,
    "check_behavior_grain": (
        "simulation_day:i transaction_type:s customer_role:s duplicate_count:i"
    ),
    "check_behavior_totals": (
        "fact_transaction_count:i mart_transaction_count:i fact_transaction_amount_total:m "
        "mart_transaction_amount_total:m fact_fraudulent_transaction_count:i "
        "mart_fraudulent_transaction_count:i"
    ),
    "check_training_features": ID + "transaction_type:s is_transfer:b",
    "check_training_totals": (
        "fact_row_count:i training_row_count:i fact_fraud_count:i training_fraud_count:i"
    ),
    "check_split_temporal": ID + "simulation_step:i dataset_split:s",
    "check_split_classes": (
        "dataset_split:s transaction_count:i fraud_count:i legitimate_count:i"
    ),
    "check_mart_totals_agree": "measure:s agrees:b",
    "check_non_empty": "table_name:s row_count:i",
    "quality_report": "check_name:s table_name:s failures:i",
    "contract_report": "table_name:s check_name:s column_name:s failures:i",
    "tag_dashboard": "product:s row_count:i",
    "tag_ml": "product:s row_count:i",
    "tag_daily": "product:s row_count:i",
    "tag_dimensions": "product:s row_count:i",
}


def columns_of(shape: str) -> list[tuple[str, str]]:
    """(name, kind) pairs of a shape."""
    return [tuple(part.split(":")) for part in shape.split()]


def published(df: DataFrame, key: str) -> DataFrame:
    """`df` reduced to its published columns and types."""
    out = []
    for name, kind in columns_of(SHAPES[key]):
        column = F.col(name)
        if kind == "i":
            column = column.cast("bigint")
        elif kind == "m":
            column = column.cast("double")
        elif kind == "b":
            column = column.cast("boolean")
        elif kind.startswith("d"):
            # Adding zero turns a negative zero into a plain one.
            column = F.round(column.cast("double"), int(kind[1:])) + F.lit(0.0)
        out.append(column.alias(name))
    return df.select(*out)


def published_sql(key: str, source: str) -> str:
    """The same projection as SQL over the relation `source`."""
    out = []
    for name, kind in columns_of(SHAPES[key]):
        if kind == "i":
            expression = f"cast({name} as bigint)"
        elif kind == "m":
            expression = f"cast({name} as double)"
        elif kind == "b":
            expression = f"cast({name} as boolean)"
        elif kind.startswith("d"):
            expression = f"round(cast({name} as double), {kind[1:]}) + 0.0::double"
        else:
            expression = f"cast({name} as varchar)"
        out.append(f"{expression} as {name}")
    return f"select {', '.join(out)} from {source}"
