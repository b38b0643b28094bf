"""Every registered query: `(spark, sf_dir) -> DataFrame` over the whole ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwright import Products
from ledgerwright.functions import (
    finite_or_null,
    fraud_rate,
    order_key,
    published_rate,
    safe_divide,
    with_calendar,
)
from ledgerwright.operators import checks
from ledgerwright.operators.carried import FeatureStore
from ledgerwright.plans import (
    dashboards,
    dimensions,
    distinct,
    graph,
    marts,
    metrics,
    models,
    preprocessing,
    profiles,
    quality,
    training,
    versions,
)
from ledgerwright.plans.contracts import contract_report
from ledgerwright.plans.products import GROUPS, TYPE_NAMES, build, run_checks
from ledgerwright.plans.staging import FACT_COLUMNS, stage, to_fact
from ledgerwright.plans.tracked import TrackedBuild
from ledgerwright.session import freeze, scratch_path
from ledgerwright.sources import sinks
from ledgerwright.sources.ledger import read_ledger_csv, read_snapshot
from ledgerwright.sources.orders_ledger import read_orders_ledger
from ledgerwright.sources.snapshots import SnapshotTable
from registry.shapes import SHAPES, published

Query = Callable[[Products, SparkSession], DataFrame]
QUERIES: dict[str, Query] = {}

# Days loaded first in the incremental scenarios; the rest arrives later.
FIRST_LOAD_DAYS = 15
FIRST_LOAD_STEP = 24 * FIRST_LOAD_DAYS


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def project(name: str, source: Callable[[Products], DataFrame]) -> None:
    """Register a query that is a projection of a product."""
    QUERIES[name] = lambda p, spark: source(p)


# --- sources, sinks, loads ---------------------------------------------------


def _csv_ledger(p: Products, spark: SparkSession) -> DataFrame:
    path = scratch_path(spark, "csv")
    p.raw.write.option("header", True).csv(path)
    return read_ledger_csv(spark, path)


@query("raw_csv_scan")
def raw_csv_scan(p, spark):
    return _csv_ledger(p, spark)


def _written_fact(p: Products, spark: SparkSession) -> str:
    path = scratch_path(spark, "fact")
    sinks.write_partitioned(p.fact, path)
    return path


@query("parquet_scan_partitioned")
def parquet_scan_partitioned(p, spark):
    return read_snapshot(spark, _written_fact(p, spark))


@query("column_pruned_scan")
def column_pruned_scan(p, spark):
    path = scratch_path(spark, "training")
    sinks.write_partitioned(p.training_features, path)
    return read_snapshot(spark, path)


@query("fact_partitioned_write")
def fact_partitioned_write(p, spark):
    return spark.read.parquet(_written_fact(p, spark))


@query("fact_incremental_overwrite")
def fact_incremental_overwrite(p, spark):
    table = SnapshotTable(spark, scratch_path(spark, "fact"))
    # The first load misses the last hours of its last day; they arrive late.
    early = p.raw.filter(F.col("step") <= FIRST_LOAD_STEP - 6)
    sinks.load_snapshot(early, table)
    sinks.load_snapshot(p.raw, table)
    sinks.load_snapshot(p.raw, table)
    return table.read()


@query("fact_full_refresh")
def fact_full_refresh(p, spark):
    table = SnapshotTable(spark, scratch_path(spark, "fact"))
    sinks.load_snapshot(p.raw.filter(F.col("step") <= FIRST_LOAD_STEP), table)
    sinks.load_snapshot(p.raw, table, full_refresh=True)
    return table.read()


@query("fact_schema_sync")
def fact_schema_sync(p, spark):
    target = scratch_path(spark, "fact")

    def old_model(raw):
        return (
            to_fact(raw).drop("destination_account_type").withColumn("retired_column", F.lit(1))
        )

    first = p.raw.filter(F.col("step") <= FIRST_LOAD_STEP)
    sinks.load_incremental(first, target, transform=old_model)
    # The model has changed since; the last day is loaded again, under the new one.
    sinks.load_incremental(p.raw, target, schema=p.fact.schema)
    return sinks.read_synced(spark, target, p.fact.schema)


@query("seed_transaction_types")
def seed_transaction_types(p, spark):
    return dimensions.type_usage(p.transaction_types, p.hourly)


@query("split_export_zstd")
def split_export_zstd(p, spark):
    paths = sinks.export_splits(p.modeling_rows, scratch_path(spark, "splits"))
    splits = [
        spark.read.parquet(path).withColumn("dataset_split", F.lit(name))
        for name, path in paths.items()
    ]
    return splits[0].unionByName(splits[1]).unionByName(splits[2])


@query("report_export")
def report_export(p, spark):
    path = scratch_path(spark, "report")
    summary = profiles.split_summary(p.labelled_rows)
    sinks.export_report(summary, path)
    return spark.read.schema(summary.schema).option("header", True).csv(path)


# --- projections and scalar functions ----------------------------------------

project("stg_transactions", lambda p: p.staged)
project("enrich_time", lambda p: p.enriched)
project("enrich_account_type", lambda p: p.enriched)
project("enrich_balance_delta", lambda p: p.enriched)
project("transaction_id_md5", lambda p: p.fact)
project("simulation_calendar", lambda p: with_calendar(p.hourly.select("simulation_day").distinct()))
project("log_amount", lambda p: p.labelled_rows)
project("balance_ratios", lambda p: p.labelled_rows)
project("boolean_indicators", lambda p: p.training_features)
project("clip_log1p", lambda p: preprocessing.with_logs(p.labelled_rows))
project("percent_axis_scale", lambda p: dashboards.headline_rate(p.mart_fraud_daily))


@query("stg_transactions_lenient")
def stg_transactions_lenient(p, spark):
    amount = F.when(F.col("type") == "DEBIT", "n/a").otherwise(F.col("amount").cast("string"))
    return stage(p.raw.withColumn("amount", amount), lenient=True)


@query("safe_divide")
def safe_divide_query(p, spark):
    amount, balance = F.col("transaction_amount"), F.col("destination_balance_before")
    return p.fact.select(
        "transaction_id",
        safe_divide(amount, balance).alias("quotient"),
        safe_divide(amount, balance, 3.0).alias("tripled"),
    )


def _rates(p: Products, by: str) -> DataFrame:
    return p.hourly.groupBy(by).agg(
        fraud_rate(
            F.sum("fraudulent_transaction_count"), F.sum("transaction_count")
        ).alias("fraud_rate_percent")
    )


project("fraud_rate", lambda p: _rates(p, "simulation_day"))
project("round_percent", lambda p: _rates(p, "simulation_hour"))
project(
    "rate_decimal_round",
    lambda p: _rates(p, "simulation_step").withColumn(
        "fraud_rate_percent", published_rate(F.col("fraud_rate_percent"))
    ),
)


@query("category_order_key")
def category_order_key(p, spark):
    return (
        p.labelled_rows.groupBy("dataset_split")
        .agg(F.count(F.lit(1)).alias("transaction_count"))
        .withColumn("split_order", order_key(F.col("dataset_split"), training.SPLITS))
    )


@query("nonfinite_to_null")
def nonfinite_to_null(p, spark):
    balance = F.col("origin_balance_before").cast("double")
    raw_quotient = (
        F.when(balance == 0, float("inf"))
        .when(F.col("is_flagged_fraud"), float("nan"))
        .otherwise(F.try_divide(F.col("transaction_amount").cast("double"), balance))
    )
    kind = F.when(F.col("transaction_type") != "DEBIT", F.col("transaction_type"))
    return p.fact.select(
        "transaction_id",
        F.coalesce(kind, F.lit(preprocessing.MISSING)).alias("transaction_type"),
        F.col("is_fraud").cast("double").alias("is_fraud"),
        finite_or_null(raw_quotient).alias("quotient"),
    )


# --- filters -----------------------------------------------------------------

project(
    "filter_customer_destinations",
    lambda p: p.fact.filter(F.col("destination_account_type") == "CUSTOMER"),
)
project(
    "having_min_transactions",
    lambda p: p.fact.groupBy(F.col("origin_account_id").alias("customer_id"))
    .agg(F.count(F.lit(1)).alias("transaction_count"))
    .filter(F.col("transaction_count") >= marts.MINIMUM_TRANSACTIONS),
)
project("filter_split", lambda p: p.labelled_rows.filter(F.col("dataset_split") == "VALIDATION"))
project(
    "train_downsample",
    lambda p: training.downsample(
        p.labelled_rows.filter(F.col("dataset_split") == "TRAIN"), F.col("is_fraud")
    ),
)
project("range_validity", lambda p: checks.outside_range(p.fact, "simulation_hour", 6, 20))


@query("filter_incremental_day")
def filter_incremental_day(p, spark):
    loaded = p.fact.filter(F.col("simulation_step") <= FIRST_LOAD_STEP)
    last = loaded.agg(F.coalesce(F.max("simulation_day"), F.lit(1)).alias("day")).scalar()
    return p.fact.filter(F.col("simulation_day") >= last)


# --- joins -------------------------------------------------------------------

project(
    "join_star_fact_dims",
    lambda p: marts.star_join(
        p.fact, p.dim_customer, p.transaction_types, p.dim_simulation_day
    ),
)
project("join_features_dims", lambda p: p.labelled_rows)
project(
    "join_features_customer", lambda p: marts.score_customers(p.features, p.dim_customer)
)
project(
    "join_daily_calendar",
    lambda p: marts.daily_totals(p.hourly).join(p.dim_simulation_day, "simulation_day"),
)
project(
    "cross_join_scalar",
    lambda p: profiles.with_threshold(p.labelled_rows).withColumn(
        "is_high", F.col("transaction_amount") >= F.col("threshold")
    ),
)


@query("cross_join_totals")
def cross_join_totals(p, spark):
    daily = quality.mart_totals(p.mart_fraud_daily)
    return p.fact.agg(
        F.count(F.lit(1)).alias("fact_count"), F.sum("transaction_amount").alias("fact_amount")
    ).withColumns(
        {
            "mart_count": daily.select("transaction_count").scalar(),
            "mart_amount": daily.select("transaction_amount_total").scalar(),
        }
    )


@query("orphan_keys")
def orphan_keys(p, spark):
    origins = p.fact.select("origin_account_id").distinct()
    return checks.orphan_keys(
        p.fact,
        "destination_account_id",
        origins,
        "origin_account_id",
        F.col("destination_account_type") == "CUSTOMER",
    )


# --- aggregations ------------------------------------------------------------

project("raw_profile", lambda p: profiles.raw_profile(p.raw))
project("raw_fraud_summary", lambda p: profiles.raw_fraud_summary(p.raw))


@query("agg_by_type_csv_vs_parquet")
def agg_by_type_csv_vs_parquet(p, spark):
    from_csv = profiles.type_totals(stage(_csv_ledger(p, spark)))
    from_fact = profiles.type_totals(spark.read.parquet(_written_fact(p, spark)))
    differences = profiles.differing_rows(from_csv, from_fact).agg(
        F.count(F.lit(1)).alias("differences")
    )
    return from_csv.withColumn("differences", differences.scalar())


project("conditional_count", lambda p: p.mart_fraud_by_transaction_type)
project("conditional_sum", lambda p: p.mart_fraud_by_transaction_type)
project("conditional_avg", lambda p: marts.daily_totals(p.hourly))
project("dim_customer", lambda p: p.dim_customer)
project("dim_simulation_day", lambda p: p.dim_simulation_day)


@query("dim_transaction_type")
def dim_transaction_type(p, spark):
    return dimensions.type_usage(p.dim_transaction_type, p.hourly)


project("mart_fraud_by_transaction_type", lambda p: p.mart_fraud_by_transaction_type)
project("mart_fraud_daily", lambda p: p.mart_fraud_daily)
project("mart_customer_risk", lambda p: p.mart_customer_risk)
project("mart_transaction_behavior", lambda p: p.mart_transaction_behavior)
project("count_distinct_in_group", lambda p: p.mart_transaction_behavior)
project("bi_executive_summary", lambda p: dashboards.executive_summary(p.mart_fraud_daily))
project(
    "bi_customer_risk_distribution", lambda p: dashboards.risk_distribution(p.mart_customer_risk)
)
project(
    "bi_daily_transaction_type",
    lambda p: dashboards.daily_transaction_type(p.mart_transaction_behavior),
)
project("bi_risk_scatter", lambda p: dashboards.risk_scatter(p.mart_customer_risk))
project(
    "bi_fraud_heatmap",
    lambda p: dashboards.fraud_heatmap(p.mart_transaction_behavior, TYPE_NAMES),
)
project("bi_daily_trend", lambda p: dashboards.daily_trend(p.mart_fraud_daily))
project("bi_type_rates", lambda p: dashboards.type_rates(p.mart_fraud_by_transaction_type))
project("split_summary", lambda p: profiles.split_summary(p.labelled_rows))
project("type_summary", lambda p: profiles.type_summary(p.labelled_rows))
project("amount_by_class", lambda p: profiles.amount_by_class(p.labelled_rows))
project("history_by_class", lambda p: profiles.history_by_class(p.ml_dataset))
project("high_value_rule", lambda p: profiles.high_value_rule(p.labelled_rows))
project("graph_overview", lambda p: graph.graph_overview(p.fact))
project("graph_degree_distribution", lambda p: graph.degree_distribution(p.fact))
project("dataset_inspection", lambda p: profiles.dataset_inspection(p.modeling_rows))
project("dataset_version", lambda p: versions.version_rows(training.sampled_rows(p.ml_dataset)))
project("distinct_customers_by_level", lambda p: distinct.customers_by_level(p.fact))


def _marts(p: Products) -> dict[str, DataFrame]:
    p.frozen("fact", "features", "hourly")
    names = [
        "mart_fraud_daily",
        "mart_fraud_by_transaction_type",
        "mart_customer_risk",
        "mart_transaction_behavior",
    ]
    return {name: getattr(p, name) for name in names}


@query("bi_dataset_metadata")
def bi_dataset_metadata(p, spark):
    folder = scratch_path(spark, "marts")
    listed = dashboards.dataset_metadata(_marts(p), "orders", folder, spark)
    # When it was made is different in every run.
    return listed.withColumn("is_synchronized", F.col("synchronized_at") <= F.current_timestamp())


# --- window functions --------------------------------------------------------

for _name in (
    "win_sequence",
    "win_lag_amount_step",
    "win_lead_amount",
    "win_rows_last_10",
    "win_rows_expanding_prior",
    "win_range_24h_7d",
    "feat_recency",
    "feat_amount_vs_average",
    "feat_zscore_last_10",
    "int_customer_transaction_features",
):
    project(_name, lambda p: p.features)


@query("int_customer_transaction_features_incremental")
def int_customer_transaction_features_incremental(p, spark):
    p.frozen("fact")
    store = FeatureStore(spark, scratch_path(spark, "features"), p.hot_rows)
    day = F.col("simulation_day")
    # The first load misses the last hours of its last day, and later loads read no
    # facts of before the day that was loaded last.
    store.load(p.fact.filter(F.col("simulation_step") <= FIRST_LOAD_STEP - 6))
    store.load(p.fact.filter(day.between(FIRST_LOAD_DAYS, FIRST_LOAD_DAYS + 1)))
    store.load(p.fact.filter(day > FIRST_LOAD_DAYS))
    return store.read()


project("win_partition_minmax_sum", lambda p: dimensions.events_with_span(p.fact))
project("win_dedup_first_row", lambda p: dimensions.first_event(p.fact))
for _name in ("win_lag_unpartitioned", "win_rolling_7", "win_cumulative"):
    project(_name, lambda p: p.mart_fraud_daily)
project("win_rank_multi_key", lambda p: p.mart_customer_risk)

# --- sorts, limits, set operations -------------------------------------------

project("bi_top_risk_customers", lambda p: dashboards.top_risk_customers(p.mart_customer_risk))
project("investigation_queue", lambda p: dashboards.investigation_queue(p.mart_customer_risk))
project(
    "order_by_case",
    lambda p: profiles.split_summary(p.labelled_rows).orderBy(
        order_key(F.col("dataset_split"), training.SPLITS)
    ),
)
project(
    "order_by_rate_desc",
    lambda p: profiles.type_summary(p.labelled_rows).orderBy(
        F.desc("fraud_rate_percent"), "transaction_type"
    ),
)
project("union_all_account_events", lambda p: dimensions.account_events(p.fact))
project("union_distinct_nodes", lambda p: graph.distinct_nodes(p.fact))
project("union_all_rules", lambda p: profiles.stacked_rule_predictions(p.labelled_rows))

# --- dataset, baselines, evaluation ------------------------------------------

project("mart_fraud_training_features", lambda p: p.training_features)
project("mart_fraud_ml_dataset", lambda p: p.ml_dataset)
project("modeling_columns", lambda p: p.ml_dataset.select(*training.MODEL_COLUMNS))
project("baseline_rules_metrics", lambda p: profiles.baseline_rules_metrics(p.labelled_rows))
project("drain_rule_metrics", lambda p: profiles.drain_rule_metrics(p.labelled_rows))


def _linear_train(p: Products) -> DataFrame:
    return preprocessing.linear_inputs(p.modeling_rows).filter(
        F.col("dataset_split") == "TRAIN"
    )


project(
    "class_weights",
    lambda p: preprocessing.class_weights(
        training.sampled_rows(p.labelled_rows)
        .filter(F.col("dataset_split") == "TRAIN")
        .select(F.col("is_fraud").cast("double").alias("label"))
    ),
)
project(
    "impute_median",
    lambda p: preprocessing.medians(_linear_train(p), preprocessing.LINEAR_NUMERIC),
)
project(
    "impute_most_frequent",
    lambda p: preprocessing.most_frequent(
        _linear_train(p), [*preprocessing.CATEGORICAL, *preprocessing.LINEAR_BOOLEAN]
    ),
)


@query("one_hot")
def one_hot(p, spark):
    p.frozen("modeling_rows")
    fitted = preprocessing.linear_preprocessor().fit(_linear_train(p))
    return fitted.transform(preprocessing.linear_inputs(p.modeling_rows))


QUERIES["standardize"] = one_hot


def scored_rows(dataset: DataFrame) -> DataFrame:
    """A deterministic arithmetic score with many ties, for the evaluation queries."""
    risky = F.col("is_higher_fraud_risk_type").cast("double")
    used = F.least(
        F.coalesce(F.col("amount_to_origin_balance_ratio"), F.lit(0.0)), F.lit(1.0)
    )
    hour = F.col("simulation_hour").cast("double")
    score = 0.5 * risky + 0.3 * used + 0.2 * hour / 23.0
    return dataset.select(
        "transaction_id",
        "dataset_split",
        F.col("is_fraud").cast("int").alias("label"),
        F.round(score, 3).alias("score"),
    )


SPLIT = ["dataset_split"]
project("threshold_best_f1", lambda p: metrics.best_f1_threshold(scored_rows(p.labelled_rows), SPLIT))
project("pr_curve", lambda p: metrics.pr_curve(scored_rows(p.labelled_rows), SPLIT))
project("average_precision", lambda p: metrics.average_precision(scored_rows(p.labelled_rows), SPLIT))
project("roc_auc", lambda p: metrics.roc_auc(scored_rows(p.labelled_rows), SPLIT))


def _at_validation_threshold(p: Products) -> DataFrame:
    scored = scored_rows(p.labelled_rows)
    validation = scored.filter(F.col("dataset_split") == "VALIDATION")
    threshold = metrics.best_f1_threshold(validation).select("threshold").scalar()
    return metrics.confusion_at_threshold(scored, threshold, SPLIT)


project("confusion_at_threshold", _at_validation_threshold)
project("metrics_flatten", lambda p: metrics.flatten_metrics(_at_validation_threshold(p)))


def _scored_by(train: Callable[[DataFrame], models.Trained]) -> Query:
    def run(p: Products, spark: SparkSession) -> DataFrame:
        p.frozen("modeling_rows")
        return train(p.modeling_rows).score(p.modeling_rows)

    return run


def _evaluated_by(train: Callable[[DataFrame], models.Trained]) -> Query:
    def run(p: Products, spark: SparkSession) -> DataFrame:
        p.frozen("modeling_rows")
        scored = freeze(train(p.modeling_rows).score(p.modeling_rows), "scored")
        validation = scored.filter(F.col("dataset_split") == "VALIDATION")
        threshold = metrics.best_f1_threshold(validation).select("threshold").scalar()
        return metrics.evaluate(scored, threshold, SPLIT)

    return run


QUERIES["train_logistic_regression"] = _evaluated_by(models.train_logistic_regression)
QUERIES["train_random_forest"] = _evaluated_by(models.train_random_forest)
QUERIES["train_gradient_boosting"] = _evaluated_by(models.train_gradient_boosting)
QUERIES["score_dataset"] = _scored_by(models.train_logistic_regression)


@query("feature_importance")
def feature_importance(p, spark):
    p.frozen("modeling_rows")
    return models.feature_importance(models.train_random_forest(p.modeling_rows), p.raw)


@query("rank_by_importance")
def rank_by_importance(p, spark):
    p.frozen("modeling_rows")
    trained = models.train_logistic_regression(p.modeling_rows)
    strongest = Window.orderBy(F.desc("magnitude"), "feature")
    return models.feature_importance(trained, p.raw).withColumn(
        "position", F.row_number().over(strongest)
    )


@query("feature_ablation")
def feature_ablation(p, spark):
    inputs = [
        "simulation_hour",
        "day_of_simulation_week",
        "log_transaction_amount",
        *preprocessing.LOGGED,
        *preprocessing.LINEAR_BOOLEAN,
    ]
    return p.ml_dataset.select("transaction_id", *training.ablated(inputs))


# --- data quality: every check runs over a damaged copy of its table ---------


def _damaged(df: DataFrame, where, **columns) -> DataFrame:
    """`df` with columns replaced in the rows where the condition holds."""
    return df.withColumns(
        {
            name: F.when(where, value).otherwise(F.col(name)).cast(df.schema[name].dataType)
            for name, value in columns.items()
        }
    )


@query("check_not_null")
def check_not_null(p, spark):
    damaged = _damaged(
        p.fact, F.col("simulation_hour") == 0, destination_account_id=F.lit(None)
    )
    damaged = _damaged(damaged, F.col("transaction_type") == "DEBIT", is_fraud=F.lit(None))
    return checks.not_null(damaged, FACT_COLUMNS)


@query("check_unique")
def check_unique(p, spark):
    repeated = p.fact.filter(F.col("simulation_hour") == 3)
    return checks.unique(p.fact.unionByName(repeated), ["transaction_id"])


@query("check_accepted_values")
def check_accepted_values(p, spark):
    damaged = _damaged(
        p.fact,
        F.col("simulation_hour") < 2,
        transaction_type=F.concat(F.lit("OLD_"), F.col("transaction_type")),
    )
    return checks.accepted_values(damaged, "transaction_type", TYPE_NAMES)


@query("check_relationships")
def check_relationships(p, spark):
    return checks.orphan_keys(
        p.fact,
        "destination_account_id",
        p.dim_customer.filter(F.col("customer_role") != "DESTINATION_ONLY"),
        "customer_id",
        F.col("destination_account_type") == "CUSTOMER",
    )


@query("check_non_negative_balances")
def check_non_negative_balances(p, spark):
    damaged = _damaged(
        p.staged,
        F.col("transaction_type") == "DEBIT",
        destination_balance_after=-F.col("destination_balance_after"),
    )
    return quality.negative_balances(damaged)


@query("check_valid_time")
def check_valid_time(p, spark):
    damaged = _damaged(
        p.enriched,
        F.col("transaction_type") == "TRANSFER",
        simulation_hour=F.col("simulation_hour") + 4,
    )
    return quality.invalid_time(damaged)


@query("check_source_row_count")
def check_source_row_count(p, spark):
    partial = p.fact.filter(F.col("simulation_day") <= FIRST_LOAD_DAYS)
    return quality.row_count_mismatch(p.raw, partial, ("source", "fact"))


@query("check_feature_row_count")
def check_feature_row_count(p, spark):
    partial = p.features.filter(F.col("customer_transaction_number") > 1)
    return quality.row_count_mismatch(p.fact, partial, ("fact", "features"))


@query("check_sequence_unique")
def check_sequence_unique(p, spark):
    number = F.col("customer_transaction_number")
    return quality.duplicate_sequence(
        _damaged(p.features, number > 5, customer_transaction_number=F.lit(5))
    )


@query("check_sequence_consistent")
def check_sequence_consistent(p, spark):
    number = F.col("customer_transaction_number")
    return quality.inconsistent_sequence(
        _damaged(p.features, number == 2, previous_transaction_step=F.lit(None))
    )


@query("check_history_consistent")
def check_history_consistent(p, spark):
    return quality.inconsistent_history(
        _damaged(
            p.features,
            F.col("simulation_hour") == 5,
            customer_average_amount=F.col("customer_average_amount") + 1.0,
        )
    )


@query("check_dim_customer")
def check_dim_customer(p, spark):
    return quality.inconsistent_customers(
        _damaged(
            p.dim_customer,
            F.col("customer_role") == "ORIGIN_ONLY",
            received_transaction_count=F.lit(1),
        )
    )


@query("check_dim_day")
def check_dim_day(p, spark):
    return quality.inconsistent_days(
        _damaged(
            p.dim_simulation_day,
            F.col("simulation_week") == 2,
            is_complete_day=~F.col("is_complete_day"),
        )
    )


@query("check_type_metrics")
def check_type_metrics(p, spark):
    return quality.inconsistent_type_metrics(
        _damaged(
            p.mart_fraud_by_transaction_type,
            F.col("transaction_type") == "TRANSFER",
            missed_fraud_count=F.col("missed_fraud_count") + 1,
        )
    )


@query("check_daily_consistent")
def check_daily_consistent(p, spark):
    return quality.inconsistent_daily(
        _damaged(
            p.mart_fraud_daily,
            F.col("simulation_week") == 3,
            rolling_7d_fraud_count=F.col("rolling_7d_fraud_count") + 1,
        )
    )


@query("check_customer_risk")
def check_customer_risk(p, spark):
    return quality.inconsistent_customer_risk(
        _damaged(
            p.mart_customer_risk,
            F.col("customer_risk_level") == "MEDIUM",
            customer_risk_rank=F.col("customer_risk_rank") + 1,
        )
    )


@query("check_behavior_grain")
def check_behavior_grain(p, spark):
    behavior = p.mart_transaction_behavior
    first_day = behavior.filter(F.col("simulation_day") == 1)
    return quality.duplicate_behavior(behavior.unionByName(first_day))


@query("check_behavior_totals")
def check_behavior_totals(p, spark):
    partial = p.mart_transaction_behavior.filter(F.col("simulation_day") <= FIRST_LOAD_DAYS)
    return quality.behavior_totals_mismatch(p.hourly, partial)


@query("check_training_features")
def check_training_features(p, spark):
    return quality.inconsistent_training(
        _damaged(
            p.training_features,
            F.col("transaction_type") == "CASH_OUT",
            is_transfer=F.lit(True),
        )
    )


@query("check_training_totals")
def check_training_totals(p, spark):
    partial = p.labelled_rows.filter(F.col("transaction_type") != "CASH_OUT")
    return quality.training_totals_mismatch(p.fact, partial)


@query("check_split_temporal")
def check_split_temporal(p, spark):
    return quality.misplaced_splits(
        _damaged(p.labelled_rows, F.col("simulation_step") > 700, dataset_split=F.lit("TRAIN"))
    )


@query("check_split_classes")
def check_split_classes(p, spark):
    return quality.one_class_splits(
        _damaged(p.labelled_rows, F.col("dataset_split") == "VALIDATION", is_fraud=F.lit(False))
    )


@query("check_mart_totals_agree")
def check_mart_totals_agree(p, spark):
    short = p.mart_fraud_by_transaction_type.filter(F.col("fraudulent_transaction_count") > 0)
    return quality.mart_agreement(p.mart_fraud_daily, short, p.mart_transaction_behavior)


@query("check_non_empty")
def check_non_empty(p, spark):
    tables = _marts(p)
    tables["mart_after_the_end"] = p.mart_fraud_daily.filter(F.col("simulation_day") > 31)
    found = [
        checks.is_empty(df).withColumn("table_name", F.lit(name)) for name, df in tables.items()
    ]
    merged = found[0]
    for df in found[1:]:
        merged = merged.unionByName(df)
    return merged


@query("quality_report")
def quality_report(p, spark):
    return run_checks(p)


@query("contract_report")
def contract_report_query(p, spark):
    """The column contracts over a ledger with unknown types and destinations, missing
    amounts and repeated rows in it."""
    step = F.col("step")
    damaged = p.raw.withColumns(
        {
            "type": F.when(step > 700, "REFUND").otherwise(F.col("type")),
            "namedest": F.when(
                (step < 100) & (F.col("type") == "DEBIT"), "X1"
            ).otherwise(F.col("namedest")),
            "amount": F.when(step.between(60, 64), None).otherwise(F.col("amount")),
        }
    )
    repeated = damaged.filter(step.between(50, 64))
    return contract_report(Products(damaged.unionByName(repeated)))


for _group in ("dashboard", "ml", "daily", "dimensions"):
    QUERIES[f"tag_{_group}"] = lambda p, spark, group=_group: build(
        p, group, scratch_path(spark, f"build-{group}")
    )


@query("tracked_build")
def tracked_build(p, spark):
    """The dashboard marts, built and built again: the second build writes nothing."""
    folder = scratch_path(spark, "tracked")
    TrackedBuild(p, folder).build(GROUPS["dashboard"])
    again = TrackedBuild(p, folder)
    listed = again.build(GROUPS["dashboard"])
    return listed.withColumn("rebuilt", F.col("product").isin(again.written))


def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query as `(spark, sf_dir) -> DataFrame` with published columns and types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = QUERIES[name](Products(read_orders_ledger(spark, sf_dir)), spark)
        return published(result, name) if name in SHAPES else result

    run.__name__ = name
    return run
