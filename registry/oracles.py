"""Expected results as SQL over the given tables, written from the definitions.

Relations are named common table expressions; a query pulls in the ones it mentions.
"""

from __future__ import annotations

import re

from ledgerwright.plans.contracts import CONTRACTS
from registry.shapes import SHAPES, published_sql

RELATIONS: dict[str, str] = {}

RELATIONS["raw"] = """
select cast((date_diff('day', date '1995-01-01', cast(o_orderdate as date)) * 743) // 2405 + 1 as bigint) as step,
 case o_orderpriority when '1-URGENT' then 'TRANSFER' when '2-HIGH' then 'CASH_OUT' when '3-MEDIUM' then 'PAYMENT'
      when '4-NOT SPECIFIED' then 'CASH_IN' else 'DEBIT' end as type,
 cast(o_totalprice as decimal(18,2)) as amount,
 concat('C', cast(o_custkey as string)) as nameorig,
 cast(case when o_orderpriority in ('1-URGENT','2-HIGH') and o_orderkey % 23 = 0 then o_totalprice
           when c_acctbal < 0 then 0.0 else c_acctbal * 50 end as decimal(18,2)) as oldbalanceorg,
 cast(case when o_orderpriority in ('1-URGENT','2-HIGH') and o_orderkey % 23 = 0 then 0.0
           when o_orderpriority = '4-NOT SPECIFIED' then greatest(c_acctbal,0.0) * 50 + o_totalprice
           else greatest(greatest(c_acctbal,0.0) * 50 - o_totalprice, 0.0) end as decimal(18,2)) as newbalanceorig,
 case when o_orderpriority = '3-MEDIUM' then concat('M', cast(o_orderkey % 200 as string))
      when o_orderkey % 3 = 0 then concat('C', cast((o_custkey // 10) * 10 as string))
      else concat('C', cast(1000000 + o_orderkey % 5000 as string)) end as namedest,
 cast(case when o_orderpriority = '3-MEDIUM' or o_orderkey % 4 = 0 then 0.0
           else (o_orderkey % 1000) * 100.0 end as decimal(18,2)) as oldbalancedest,
 cast(case when o_orderpriority = '3-MEDIUM' then 0.0 when o_orderkey % 4 = 0 then o_totalprice
           else (o_orderkey % 1000) * 100.0 + o_totalprice end as decimal(18,2)) as newbalancedest,
 cast(case when o_orderpriority in ('1-URGENT','2-HIGH') and o_orderkey % 23 = 0 then 1 else 0 end as int) as isfraud,
 cast(case when o_orderpriority = '1-URGENT' and o_orderkey % 23 = 0 and o_totalprice > 400000
           then 1 else 0 end as int) as isflaggedfraud
from orders join customer on o_custkey = c_custkey
"""


def staged_from(relation: str, amount: str = "amount") -> str:
    return f"""
select cast(step as bigint) simulation_step, upper(trim(type)) transaction_type,
 {amount} transaction_amount, trim(nameorig) origin_account_id,
 oldbalanceorg origin_balance_before, newbalanceorig origin_balance_after,
 trim(namedest) destination_account_id, oldbalancedest destination_balance_before,
 newbalancedest destination_balance_after, isfraud = 1 is_fraud, isflaggedfraud = 1 is_flagged_fraud
from {relation}
"""


RELATIONS["staged"] = staged_from("raw")

RELATIONS["fact"] = """
select upper(md5(concat_ws('|', simulation_step::varchar, transaction_type, transaction_amount::varchar,
  origin_account_id, origin_balance_before::varchar, origin_balance_after::varchar, destination_account_id,
  destination_balance_before::varchar, destination_balance_after::varchar, is_fraud::varchar,
  is_flagged_fraud::varchar))) transaction_id,
 *, (simulation_step - 1) // 24 + 1 simulation_day, (simulation_step - 1) % 24 simulation_hour,
 case left(destination_account_id, 1) when 'M' then 'MERCHANT' when 'C' then 'CUSTOMER' else 'UNKNOWN' end
  destination_account_type,
 origin_balance_after - origin_balance_before origin_balance_delta,
 destination_balance_after - destination_balance_before destination_balance_delta
from staged
"""

RELATIONS["types"] = """
select * from (values
 ('CASH_IN', 'CASH', 'CREDIT', 'Cash deposited into an account'),
 ('CASH_OUT', 'CASH', 'DEBIT', 'Cash withdrawn from an account'),
 ('DEBIT', 'PAYMENT', 'DEBIT', 'Direct debit transaction'),
 ('PAYMENT', 'PAYMENT', 'DEBIT', 'Payment made to a merchant'),
 ('TRANSFER', 'TRANSFER', 'DEBIT', 'Transfer between customer accounts'))
 v(transaction_type, transaction_family, balance_direction, description)
"""

_ACCOUNT = "partition by origin_account_id order by simulation_step, transaction_id"
RELATIONS["windowed"] = f"""
select *,
 row_number() over acc customer_transaction_number,
 lag(transaction_amount) over acc previous_transaction_amount,
 lag(simulation_step) over acc previous_transaction_step,
 lead(transaction_amount) over acc next_transaction_amount,
 count(*) over ten transaction_count_last_10,
 sum(transaction_amount) over ten total_last_10, count(transaction_amount) over ten amounts_last_10,
 count(transaction_amount) over prior amounts_before,
 stddev_samp(transaction_amount::double) over ten std_last_10_transactions,
 count(*) over prior historical_transaction_count,
 sum(transaction_amount) over prior cumulative_transaction_value,
 count(*) over (partition by origin_account_id order by simulation_step
   range between 24 preceding and 1 preceding) transaction_count_24h,
 count(*) over (partition by origin_account_id order by simulation_step
   range between 168 preceding and 1 preceding) transaction_count_7d
from fact
window acc as ({_ACCOUNT}),
 ten as ({_ACCOUNT} rows between 10 preceding and 1 preceding),
 prior as ({_ACCOUNT} rows between unbounded preceding and 1 preceding)
"""
RELATIONS["averaged"] = """
select *, simulation_step - previous_transaction_step hours_since_previous_transaction,
 (simulation_step - previous_transaction_step)::double / 24 days_since_previous_transaction,
 total_last_10::double / nullif(amounts_last_10, 0) avg_last_10_transactions,
 cumulative_transaction_value::double / nullif(amounts_before, 0) customer_average_amount
from windowed
"""
RELATIONS["features"] = """
select *, transaction_amount::double - customer_average_amount amount_vs_customer_average,
 transaction_amount::double / nullif(customer_average_amount, 0) amount_to_customer_average_ratio,
 case when std_last_10_transactions > 0
  then (transaction_amount::double - avg_last_10_transactions) / std_last_10_transactions end
  amount_zscore_last_10
from averaged
"""

RELATIONS["events"] = """
select origin_account_id customer_id, simulation_step, simulation_day, 'ORIGIN' account_event_role from fact
union all
select destination_account_id, simulation_step, simulation_day, 'DESTINATION' from fact
where destination_account_type = 'CUSTOMER'
"""
RELATIONS["customers"] = """
select *, originated_transaction_count + received_transaction_count total_involved_transaction_count,
 case when originated_transaction_count = 0 then 'DESTINATION_ONLY'
      when received_transaction_count = 0 then 'ORIGIN_ONLY' else 'ORIGIN_AND_DESTINATION' end customer_role
from (select customer_id, min(simulation_step) first_seen_step, max(simulation_step) last_seen_step,
  min(simulation_day) first_seen_day, max(simulation_day) last_seen_day,
  count(*) filter (where account_event_role = 'ORIGIN') originated_transaction_count,
  count(*) filter (where account_event_role = 'DESTINATION') received_transaction_count
 from events group by customer_id)
"""
RELATIONS["days"] = """
select simulation_day, (simulation_day - 1) // 7 + 1 simulation_week,
 (simulation_day - 1) % 7 + 1 day_of_simulation_week, min(simulation_step) first_simulation_step,
 max(simulation_step) last_simulation_step, count(distinct simulation_hour) observed_hour_count,
 count(distinct simulation_hour) = 24 is_complete_day
from fact group by simulation_day
"""
_MEASURES = """count(*) transaction_count, count(transaction_amount) amount_count,
 count(transaction_amount) filter (where is_fraud) fraud_amount_count, sum(transaction_amount) transaction_amount_total,
 count(*) filter (where is_fraud) fraudulent_transaction_count,
 coalesce(sum(transaction_amount) filter (where is_fraud), 0) fraudulent_transaction_amount,
 count(*) filter (where is_flagged_fraud) flagged_transaction_count"""
_RATE = """100.0::double * sum(fraudulent_transaction_count)::double
 / nullif(sum(transaction_count), 0)::double fraud_rate_percent"""

RELATIONS["by_type"] = f"""
select *, transaction_amount_total::double / nullif(amount_count, 0) transaction_amount_average,
 cast(100.0::double * fraudulent_transaction_count / transaction_count as decimal(10,4)) fraud_rate_percent,
 cast(100.0::double * detected_fraud_count / nullif(fraudulent_transaction_count, 0)
  as decimal(10,4)) fraud_detection_rate_percent
from (select transaction_type, {_MEASURES},
  count(*) filter (where is_fraud and is_flagged_fraud) detected_fraud_count,
  count(*) filter (where is_fraud and not is_flagged_fraud) missed_fraud_count
 from fact group by transaction_type)
"""
RELATIONS["per_day"] = f"""
select *, fraudulent_transaction_amount::double / nullif(fraud_amount_count, 0)
  average_fraudulent_transaction_amount,
 100.0::double * fraudulent_transaction_count / transaction_count fraud_rate_percent
from (select simulation_day, {_MEASURES} from fact group by simulation_day)
"""
RELATIONS["daily"] = """
select *, fraud_rate_percent - previous_day_fraud_rate_percent fraud_rate_change_percentage_points,
 100.0::double * rolling_7d_fraud_count / rolling_7d_transaction_count rolling_7d_fraud_rate_percent
from (select d.*, c.simulation_week, c.day_of_simulation_week, c.is_complete_day,
  lag(fraud_rate_percent) over o previous_day_fraud_rate_percent,
  sum(transaction_count) over week rolling_7d_transaction_count,
  sum(fraudulent_transaction_count) over week rolling_7d_fraud_count,
  sum(transaction_count) over so_far cumulative_transaction_count,
  sum(fraudulent_transaction_count) over so_far cumulative_fraud_count,
  sum(fraudulent_transaction_amount) over so_far cumulative_fraudulent_amount
 from per_day d join days c using (simulation_day)
 window o as (order by simulation_day),
  week as (order by simulation_day rows between 6 preceding and current row),
  so_far as (order by simulation_day rows unbounded preceding))
"""
RELATIONS["scored_customers"] = """
select *, 100.0::double * fraudulent_transaction_count / transaction_count fraud_rate_percent,
 case when fraudulent_transaction_count > 0 then 'HIGH'
      when high_value_anomaly_count > 0 or maximum_amount_to_average_ratio >= 5 then 'MEDIUM'
      else 'LOW' end customer_risk_level
from (select origin_account_id customer_id, c.first_seen_day, c.last_seen_day, c.customer_role,
  count(*) transaction_count, sum(transaction_amount) transaction_amount_total,
  sum(transaction_amount)::double / nullif(count(transaction_amount), 0) transaction_amount_average,
  max(transaction_amount) maximum_transaction_amount,
  avg(hours_since_previous_transaction) average_hours_between_transactions,
  max(transaction_count_24h) maximum_transaction_count_24h,
  count(*) filter (where is_fraud) fraudulent_transaction_count,
  coalesce(sum(transaction_amount) filter (where is_fraud), 0) fraudulent_transaction_amount,
  count(*) filter (where amount_zscore_last_10 >= 3 or amount_to_customer_average_ratio >= 5)
   high_value_anomaly_count,
  coalesce(max(amount_zscore_last_10), 0) maximum_amount_zscore,
  coalesce(max(amount_to_customer_average_ratio), 0) maximum_amount_to_average_ratio
 from features f join customers c on c.customer_id = f.origin_account_id
 group by all having count(*) >= 2)
"""
_RANK = """rank() over (order by fraudulent_transaction_count desc, fraudulent_transaction_amount desc,
 high_value_anomaly_count desc, maximum_amount_zscore desc, transaction_amount_total desc)"""
RELATIONS["risk"] = f"select *, {_RANK} customer_risk_rank from scored_customers"
RELATIONS["star"] = """
select f.*, c.customer_role, t.transaction_family, t.balance_direction, d.simulation_week,
 d.day_of_simulation_week, d.is_complete_day
from fact f join customers c on c.customer_id = f.origin_account_id
 join types t using (transaction_type) join days d using (simulation_day)
"""
RELATIONS["behavior"] = f"""
select *, transaction_amount_total::double / nullif(amount_count, 0) transaction_amount_average,
 100.0::double * fraudulent_transaction_count / transaction_count fraud_rate_percent
from (select simulation_day, simulation_week, day_of_simulation_week, is_complete_day, transaction_type,
  transaction_family, balance_direction, customer_role, {_MEASURES},
  count(distinct origin_account_id) distinct_customer_count
 from star group by all)
"""
RELATIONS["training"] = """
select f.* replace (f.transaction_amount::double as transaction_amount,
  origin_balance_before::double as origin_balance_before,
  destination_balance_before::double as destination_balance_before,
  previous_transaction_amount::double as previous_transaction_amount,
  cumulative_transaction_value::double as cumulative_transaction_value),
 t.transaction_family, t.balance_direction, d.simulation_week, d.day_of_simulation_week,
 ln(1 + f.transaction_amount::double) log_transaction_amount,
 f.transaction_amount::double / nullif(origin_balance_before::double, 0) amount_to_origin_balance_ratio,
 f.transaction_amount::double / nullif(destination_balance_before::double, 0)
  amount_to_destination_balance_ratio,
 origin_balance_before >= f.transaction_amount origin_has_sufficient_balance,
 destination_balance_before > 0 destination_has_recorded_balance,
 destination_account_type = 'MERCHANT' is_merchant_destination,
 transaction_type = 'TRANSFER' is_transfer,
 transaction_type in ('CASH_IN', 'CASH_OUT') is_cash_transaction,
 transaction_type in ('TRANSFER', 'CASH_OUT') is_higher_fraud_risk_type,
 previous_transaction_amount is not null has_previous_transaction,
 transaction_count_last_10 = 10 has_full_10_transaction_history,
 is_flagged_fraud baseline_rule_flag
from features f join types t using (transaction_type) join days d using (simulation_day)
"""
RELATIONS["ml"] = """
select *, case when simulation_step <= 322 then 'TRAIN' when simulation_step <= 375 then 'VALIDATION'
 else 'TEST' end dataset_split from training
"""
RELATIONS["modeling"] = """
select * from ml where dataset_split <> 'TRAIN' or is_fraud
 or cast('0x' || substr(transaction_id, 1, 8) as bigint) % 100 < 5
"""
RELATIONS["limit99"] = """
select quantile_cont(transaction_amount, 0.99) threshold from ml
where dataset_split = 'TRAIN' and not is_fraud
"""
RELATIONS["predictions"] = """
select dataset_split, is_fraud, unnest([
 {'rule_name': 'original_rule', 'predicted_fraud': baseline_rule_flag},
 {'rule_name': 'risky_type', 'predicted_fraud': is_higher_fraud_risk_type},
 {'rule_name': 'high_value', 'predicted_fraud': transaction_amount >= threshold},
 {'rule_name': 'risky_type_and_high_value',
  'predicted_fraud': is_higher_fraud_risk_type and transaction_amount >= threshold}], recursive := true)
from ml, limit99
"""
_CELLS = """count(*) filter (where hit and actual) true_positive,
 count(*) filter (where hit and not actual) false_positive,
 count(*) filter (where not hit and actual) false_negative,
 count(*) filter (where not hit and not actual) true_negative"""
_RATES = """true_positive + false_positive generated_alerts,
 100.0::double * true_positive / nullif(true_positive + false_positive, 0) precision_percent,
 100.0::double * true_positive / nullif(true_positive + false_negative, 0) recall_percent,
 100.0::double * true_negative / nullif(true_negative + false_positive, 0) specificity_percent,
 200.0::double * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0) f1_percent,
 100.0::double * (true_positive + false_positive)
  / (true_positive + false_positive + false_negative + true_negative) alert_rate_percent"""

RELATIONS["linear"] = """
select transaction_id, dataset_split, transaction_type, destination_account_type,
 origin_has_sufficient_balance::double origin_has_sufficient_balance,
 destination_has_recorded_balance::double destination_has_recorded_balance,
 is_merchant_destination::double is_merchant_destination,
 has_previous_transaction::double has_previous_transaction,
 simulation_hour::double simulation_hour, day_of_simulation_week::double day_of_simulation_week,
 log_transaction_amount,
 ln(1 + greatest(origin_balance_before, 0)) log_origin_balance_before,
 ln(1 + greatest(destination_balance_before, 0)) log_destination_balance_before,
 case when amount_to_origin_balance_ratio is not null
  then ln(1 + greatest(amount_to_origin_balance_ratio, 0)) end log_amount_to_origin_balance_ratio,
 case when amount_to_destination_balance_ratio is not null
  then ln(1 + greatest(amount_to_destination_balance_ratio, 0)) end log_amount_to_destination_balance_ratio,
 customer_transaction_number::double customer_transaction_number,
 transaction_count_last_10::double transaction_count_last_10,
 transaction_count_24h::double transaction_count_24h, transaction_count_7d::double transaction_count_7d,
 is_fraud::int label
from modeling
"""
_NUMERIC = [
    "simulation_hour", "day_of_simulation_week", "log_transaction_amount",
    "log_origin_balance_before", "log_destination_balance_before",
    "log_amount_to_origin_balance_ratio", "log_amount_to_destination_balance_ratio",
    "customer_transaction_number", "transaction_count_last_10", "transaction_count_24h",
    "transaction_count_7d",
]
_SCALED = [
    "simulation_hour", "log_transaction_amount", "log_amount_to_origin_balance_ratio",
    "customer_transaction_number",
]
_MODED = [
    "transaction_type", "destination_account_type", "origin_has_sufficient_balance",
    "destination_has_recorded_balance", "is_merchant_destination", "has_previous_transaction",
]
RELATIONS["filled"] = (
    "select transaction_id, dataset_split, "
    + ", ".join(
        f"coalesce({c}, (select median({c}) from linear where dataset_split = 'TRAIN')) {c}"
        for c in _SCALED
    )
    + " from linear"
)
RELATIONS["scored"] = """
select transaction_id, dataset_split, is_fraud::int label,
 round(0.5::double * is_higher_fraud_risk_type::double
  + 0.3::double * least(coalesce(amount_to_origin_balance_ratio, 0), 1)
  + 0.2::double * simulation_hour::double / 23.0::double, 3) score
from ml
"""
RELATIONS["curve"] = """
select *, true_positive::double / generated_alerts as precision,
 true_positive::double / nullif(all_positives, 0) recall,
 2.0::double * true_positive / (generated_alerts + all_positives) f1
from (select dataset_split, score threshold, sum(label) positives, count(*) n,
  sum(sum(label)) over w true_positive, sum(count(*)) over w generated_alerts,
  sum(sum(label)) over (partition by dataset_split) all_positives
 from scored group by dataset_split, score
 window w as (partition by dataset_split order by score desc))
"""
RELATIONS["best"] = """
select dataset_split, min(threshold) threshold, min(f1) f1
from (select *, max(f1) over (partition by dataset_split) top from curve) where f1 = top
group by dataset_split
"""
RELATIONS["evaluated"] = f"""
select *, {_RATES.replace("specificity_percent", "specificity_unused")}
from (select dataset_split, max(threshold) threshold, {_CELLS}
 from (select s.dataset_split, threshold, score >= threshold hit, label = 1 actual
  from scored s, (select threshold from best where dataset_split = 'VALIDATION') b)
 group by dataset_split)
"""

ORACLES: dict[str, str] = {}


def same_as(relation: str, *names: str) -> None:
    for name in names:
        ORACLES[name] = f"from {relation}"


same_as("raw", "raw_csv_scan")
same_as(
    "fact",
    "parquet_scan_partitioned",
    "fact_partitioned_write",
    "fact_incremental_overwrite",
    "fact_full_refresh",
    "enrich_time",
    "enrich_account_type",
    "enrich_balance_delta",
    "transaction_id_md5",
)
same_as("training", "column_pruned_scan", "log_amount", "balance_ratios", "boolean_indicators",
        "join_features_dims", "mart_fraud_training_features")
same_as("staged", "stg_transactions")
same_as("modeling", "split_export_zstd")
same_as("ml", "mart_fraud_ml_dataset", "modeling_columns", "feature_ablation")
same_as("features", "win_sequence", "win_lag_amount_step", "win_lead_amount", "win_rows_last_10",
        "win_rows_expanding_prior", "win_range_24h_7d", "feat_recency", "feat_amount_vs_average",
        "feat_zscore_last_10", "int_customer_transaction_features",
        "int_customer_transaction_features_incremental")
same_as("by_type", "conditional_count", "conditional_sum", "mart_fraud_by_transaction_type",
        "bi_type_rates")
same_as("per_day", "conditional_avg", "fraud_rate")
same_as("daily", "mart_fraud_daily", "bi_daily_trend", "win_lag_unpartitioned", "win_rolling_7",
        "win_cumulative", "join_daily_calendar")
same_as("customers", "dim_customer")
same_as("days", "dim_simulation_day", "simulation_calendar")
same_as("risk", "mart_customer_risk", "win_rank_multi_key")
same_as("scored_customers", "join_features_customer")
same_as("behavior", "mart_transaction_behavior", "count_distinct_in_group")
same_as("star", "join_star_fact_dims")
same_as("events", "union_all_account_events")
same_as("predictions", "union_all_rules")
same_as("curve", "pr_curve")
same_as("best", "threshold_best_f1")
same_as("evaluated", "confusion_at_threshold")

ORACLES["fact_schema_sync"] = """select * replace (case when simulation_day >= 15
 then destination_account_type end as destination_account_type) from fact"""
_USAGE = """select t.*, count(f.transaction_type) transaction_count
from types t left join fact f using (transaction_type) group by all"""
ORACLES["seed_transaction_types"] = _USAGE
ORACLES["dim_transaction_type"] = _USAGE
_SPLITS = """select dataset_split, min(simulation_step) minimum_step, max(simulation_step) maximum_step,
 count(*) transaction_count, sum(is_fraud::int) fraud_count,
 100.0::double * sum(is_fraud::int) / count(*) fraud_rate_percent from ml group by dataset_split"""
for _name in ("report_export", "split_summary", "order_by_case"):
    ORACLES[_name] = _SPLITS
ORACLES["stg_transactions_lenient"] = staged_from(
    "raw", "try_cast(case type when 'DEBIT' then 'n/a' else amount::varchar end as decimal(18,2))"
)
ORACLES["safe_divide"] = """select transaction_id,
 transaction_amount::double / nullif(destination_balance_before::double, 0) quotient,
 3.0::double * transaction_amount::double / nullif(destination_balance_before::double, 0) tripled from fact"""
ORACLES["round_percent"] = """select simulation_hour,
 100.0::double * sum(is_fraud::int) / count(*) fraud_rate_percent from fact group by simulation_hour"""
ORACLES["rate_decimal_round"] = """select simulation_step,
 cast(100.0::double * sum(is_fraud::int) / count(*) as decimal(10,4)) fraud_rate_percent
from fact group by simulation_step"""
ORACLES["category_order_key"] = """select dataset_split, count(*) transaction_count,
 list_position(['TRAIN', 'VALIDATION', 'TEST'], dataset_split) split_order from ml group by dataset_split"""
ORACLES["clip_log1p"] = """select transaction_id, ln(1 + greatest(origin_balance_before, 0)) log_origin_balance_before,
 ln(1 + greatest(destination_balance_before, 0)) log_destination_balance_before,
 ln(1 + amount_to_origin_balance_ratio) log_amount_to_origin_balance_ratio,
 ln(1 + amount_to_destination_balance_ratio) log_amount_to_destination_balance_ratio from ml"""
ORACLES["nonfinite_to_null"] = """select transaction_id,
 case transaction_type when 'DEBIT' then '__MISSING__' else transaction_type end transaction_type,
 is_fraud::int is_fraud, case when not is_flagged_fraud
  then transaction_amount::double / nullif(origin_balance_before::double, 0) end quotient from fact"""
ORACLES["percent_axis_scale"] = f"select fraud_rate_percent / 100 fraud_rate from (select {_RATE} from daily)"

ORACLES["filter_customer_destinations"] = "from fact where destination_account_type = 'CUSTOMER'"
ORACLES["having_min_transactions"] = """select origin_account_id customer_id, count(*) transaction_count
from fact group by origin_account_id having count(*) >= 2"""
ORACLES["filter_split"] = "from ml where dataset_split = 'VALIDATION'"
ORACLES["train_downsample"] = "from modeling where dataset_split = 'TRAIN'"
ORACLES["filter_incremental_day"] = """from fact where simulation_day >=
 (select coalesce(max(simulation_day), 1) from fact where simulation_step <= 360)"""
ORACLES["range_validity"] = "from fact where simulation_hour not between 6 and 20"
ORACLES["cross_join_scalar"] = "select *, transaction_amount >= threshold is_high from ml cross join limit99"
ORACLES["cross_join_totals"] = """select * from
 (select count(*) fact_count, sum(transaction_amount) fact_amount from fact) cross join
 (select sum(transaction_count) mart_count, sum(transaction_amount_total) mart_amount from daily)"""
ORACLES["orphan_keys"] = """select destination_account_id orphan_key, count(*) row_count from fact
where destination_account_type = 'CUSTOMER'
 and destination_account_id not in (select origin_account_id from fact) group by 1"""
ORACLES["raw_profile"] = """select count(*) transaction_count, min(step) first_step, max(step) last_step,
 count(distinct type) distinct_types, sum(isfraud) fraud_count, sum(amount) total_amount,
 sum(amount)::double / count(*) average_amount, 100.0::double * sum(isfraud) / count(*) fraud_percent from raw"""
ORACLES["raw_fraud_summary"] = """select count(*) transaction_count, min(step) first_step, max(step) last_step,
 sum(isfraud) fraud_count, 100.0::double * sum(isfraud) / count(*) fraud_percent from raw"""
ORACLES["agg_by_type_csv_vs_parquet"] = """select type transaction_type, count(*) transaction_count,
 sum(amount) transaction_amount_total, sum(isfraud) fraudulent_transaction_count, 0 differences
from raw group by type"""

ORACLES["bi_executive_summary"] = f"""select sum(transaction_count) transaction_count,
 sum(transaction_amount_total) transaction_amount_total,
 sum(fraudulent_transaction_count) fraudulent_transaction_count,
 sum(fraudulent_transaction_amount) fraudulent_transaction_amount,
 sum(flagged_transaction_count) flagged_transaction_count, {_RATE},
 avg(average_fraudulent_transaction_amount) average_daily_fraud_amount,
 max(fraudulent_transaction_amount) maximum_daily_fraud_amount from daily"""
ORACLES["bi_customer_risk_distribution"] = f"""select customer_risk_level,
 coalesce(list_position(['HIGH', 'MEDIUM', 'LOW'], customer_risk_level), 4) risk_level_order,
 count(*) customer_count, {_RATE}, sum(transaction_count) transaction_count,
 sum(transaction_amount_total) transaction_amount_total,
 sum(fraudulent_transaction_count) fraudulent_transaction_count,
 sum(fraudulent_transaction_amount) fraudulent_transaction_amount,
 sum(high_value_anomaly_count) high_value_anomaly_count,
 avg(maximum_amount_zscore) average_maximum_amount_zscore from risk group by customer_risk_level"""
ORACLES["bi_daily_transaction_type"] = f"""select simulation_day, simulation_week, day_of_simulation_week,
 is_complete_day, transaction_type, transaction_family, balance_direction,
 sum(distinct_customer_count) distinct_customer_count, {_RATE},
 sum(transaction_count) transaction_count, sum(transaction_amount_total) transaction_amount_total,
 sum(fraudulent_transaction_count) fraudulent_transaction_count,
 sum(fraudulent_transaction_amount) fraudulent_transaction_amount,
 sum(flagged_transaction_count) flagged_transaction_count from behavior group by all"""
ORACLES["bi_risk_scatter"] = """select transaction_count, customer_risk_level,
 sum(transaction_amount_total)::double / count(*) average_customer_amount from risk
group by transaction_count, customer_risk_level order by 1, 2 limit 10000"""
ORACLES["bi_fraud_heatmap"] = "select simulation_day, " + ", ".join(
    f"count(*) filter (where is_fraud and transaction_type = '{t}') {t}"
    for t in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
) + " from fact group by simulation_day"
_TYPES = """select transaction_type, count(*) transaction_count, sum(is_fraud::int) fraud_count,
 100.0::double * sum(is_fraud::int) / count(*) fraud_rate_percent from ml group by transaction_type"""
ORACLES["type_summary"] = _TYPES
ORACLES["order_by_rate_desc"] = _TYPES + " order by fraud_rate_percent desc"
ORACLES["amount_by_class"] = """select is_fraud, count(*) transaction_count,
 sum(transaction_amount::decimal(18,2))::double / count(*) average_amount,
 median(transaction_amount) median_amount, quantile_cont(transaction_amount, 0.9) percentile_90,
 quantile_cont(transaction_amount, 0.99) percentile_99 from ml group by is_fraud"""
ORACLES["history_by_class"] = """select is_fraud,
 avg(historical_transaction_count) average_previous_transactions,
 median(historical_transaction_count) median_previous_transactions,
 avg(transaction_count_24h) average_transactions_24h, median(transaction_count_24h) median_transactions_24h,
 avg(transaction_count_7d) average_transactions_7d, median(transaction_count_7d) median_transactions_7d,
 avg(hours_since_previous_transaction) average_hours_since_previous from ml group by is_fraud"""
ORACLES["high_value_rule"] = """select dataset_split, max(threshold) high_value_threshold,
 count(*) filter (where is_fraud and transaction_amount >= threshold) detected_frauds,
 count(*) filter (where is_fraud) total_frauds,
 100.0::double * count(*) filter (where is_fraud and transaction_amount >= threshold)
  / nullif(count(*) filter (where is_fraud), 0) fraud_recall_percent,
 count(*) filter (where not is_fraud and transaction_amount >= threshold) legitimate_alerts
from ml, limit99 group by dataset_split"""
ORACLES["graph_overview"] = """select *, transaction_count - directed_pair_count repeated_edge_count,
 100.0::double * fraud_count / transaction_count fraud_rate_percent,
 directed_pair_count::double / (node_count::double * (node_count - 1)) graph_density
from (select count(*) transaction_count,
  count(distinct (origin_account_id, destination_account_id)) directed_pair_count,
  sum(is_fraud::bigint) fraud_count,
  count(*) filter (where origin_account_id = destination_account_id) self_loop_count,
  sum(transaction_amount) total_transaction_amount,
  sum(transaction_amount)::double / count(*) average_transaction_amount,
  min(simulation_step) minimum_step, max(simulation_step) maximum_step,
  (select count(*) from (select origin_account_id from fact union select destination_account_id from fact))
   node_count from fact)"""
ORACLES["graph_degree_distribution"] = """select count(*) node_count, sum(degree)::double / count(*) average_degree,
 median(degree) median_degree, max(degree) maximum_degree,
 count(*) filter (where degree = 1) degree_one_count
from (select account, count(*) degree from (select origin_account_id account from fact
 union all select destination_account_id from fact) group by account)"""
ORACLES["dataset_inspection"] = """select dataset_split, count(*) transaction_count, sum(is_fraud::int) fraud_count,
 100.0::double * sum(is_fraud::int) / count(*) fraud_rate_percent, 37 column_count
from modeling group by dataset_split"""
_MART_COUNTS = """select 'mart_fraud_daily' table_name, count(*) row_count from daily
union all select 'mart_fraud_by_transaction_type', count(*) from by_type
union all select 'mart_customer_risk', count(*) from risk
union all select 'mart_transaction_behavior', count(*) from behavior"""
ORACLES["bi_dataset_metadata"] = (
    f"select *, 1 snapshot_id, 'orders' source, true is_synchronized from ({_MART_COUNTS})"
)
ORACLES["tracked_build"] = f"select table_name product, row_count, false rebuilt from ({_MART_COUNTS})"
ORACLES["distinct_customers_by_level"] = """select 'day_type' as level, simulation_day, transaction_type,
 count(distinct origin_account_id) customers from fact group by simulation_day, transaction_type
union all select 'day', simulation_day, null, count(distinct origin_account_id) from fact group by simulation_day
union all select 'type', null, transaction_type, count(distinct origin_account_id) from fact group by transaction_type
union all select 'all', null, null, count(distinct origin_account_id) from fact"""

ORACLES["win_partition_minmax_sum"] = """select *, min(simulation_step) over c first_seen_step,
 max(simulation_step) over c last_seen_step,
 sum((account_event_role = 'ORIGIN')::int) over c originated_transaction_count
from events window c as (partition by customer_id)"""
ORACLES["win_dedup_first_row"] = """from events qualify row_number() over
 (partition by customer_id order by simulation_step, account_event_role) = 1"""
for _name in ("bi_top_risk_customers", "investigation_queue"):
    ORACLES[_name] = "from risk order by customer_risk_rank, customer_id limit 100"
ORACLES["union_distinct_nodes"] = """select origin_account_id account_id from fact
union select destination_account_id from fact"""

ORACLES["baseline_rules_metrics"] = f"""select *, {_RATES} from (select dataset_split, rule_name, {_CELLS}
 from (select *, predicted_fraud hit, is_fraud actual from predictions) group by dataset_split, rule_name)"""
ORACLES["drain_rule_metrics"] = f"""select *, {_RATES} from (select dataset_split, {_CELLS}
 from (select *, is_fraud actual, transaction_type in ('TRANSFER', 'CASH_OUT')
   and abs(transaction_amount - origin_balance_before) <= 0.01 hit from ml) group by dataset_split)"""
ORACLES["class_weights"] = """select count(*) as rows, sum(label) positives,
 (count(*) - sum(label))::double / sum(label) scale_positive,
 count(*)::double / (2 * sum(label)) weight_positive,
 count(*)::double / (2 * (count(*) - sum(label))) weight_negative from linear where dataset_split = 'TRAIN'"""
ORACLES["impute_median"] = " union all ".join(
    f"select '{c}' feature, median({c}) median from linear where dataset_split = 'TRAIN'"
    for c in _NUMERIC
)
ORACLES["impute_most_frequent"] = " union all ".join(
    f"""select * from (select '{c}' feature, {c}::varchar as value from linear
 where dataset_split = 'TRAIN' and {c} is not null group by {c} order by count(*) desc, value limit 1)"""
    for c in _MODED
)
ORACLES["one_hot"] = "select transaction_id, " + ", ".join(
    [
        f"(transaction_type = '{t}')::int transaction_type_{t}"
        for t in ("CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
    ]
    + ["(destination_account_type = 'MERCHANT')::int destination_account_type_MERCHANT"]
) + " from linear"
ORACLES["standardize"] = "select transaction_id, " + ", ".join(
    f"({c} - (select avg({c}) from filled where dataset_split = 'TRAIN'))"
    f" / (select stddev_pop({c}) from filled where dataset_split = 'TRAIN') {c}"
    for c in _SCALED
) + " from filled"
ORACLES["average_precision"] = """select dataset_split,
 sum(positives::double / all_positives * precision) average_precision from curve group by dataset_split"""
ORACLES["roc_auc"] = """select p.dataset_split, sum(p.n::double * case when p.score > q.score then 1.0
  when p.score = q.score then 0.5 else 0.0 end * q.n) / (max(p.total) * max(q.total)) roc_auc
from (select dataset_split, score, count(*) n, sum(count(*)) over (partition by dataset_split) total
  from scored where label = 1 group by dataset_split, score) p
join (select dataset_split, score, count(*) n, sum(count(*)) over (partition by dataset_split) total
  from scored where label = 0 group by dataset_split, score) q using (dataset_split)
group by p.dataset_split"""
ORACLES["metrics_flatten"] = "select lower(dataset_split) || '_' || metric as name, value from (unpivot (select dataset_split, " + ", ".join(
    f"coalesce({c}::double, 0) {c}"
    for c in (
        "threshold", "true_positive", "false_positive", "false_negative", "true_negative",
        "generated_alerts", "alert_rate_percent", "precision_percent", "recall_percent",
        "f1_percent",
    )
) + " from evaluated) on columns(* exclude (dataset_split)) into name metric value value)"

# --- checks: the violation conditions, over any relation ---------------------


def _money_negative(t: str) -> str:
    return f"""from {t} where least(transaction_amount, origin_balance_before, origin_balance_after,
 destination_balance_before, destination_balance_after) < 0"""


def _bad_time(t: str) -> str:
    return f"from {t} where simulation_day < 1 or simulation_hour not between 0 and 23"


def _repeated(t: str, *keys: str) -> str:
    k = ", ".join(keys)
    known = " and ".join(f"{c} is not null" for c in keys)
    return f"""select {k}, count(*) duplicate_count from {t} where {known}
 group by {k} having count(*) > 1"""


def _unexpected(t: str, column: str, values: str) -> str:
    return f"""select {column} unexpected_value, count(*) row_count from {t}
 where {column} not in ({values}) group by {column}"""


def _bad_sequence(t: str) -> str:
    return f"""from {t} where customer_transaction_number < 1
 or (customer_transaction_number = 1) <> (previous_transaction_amount is null)
 or (customer_transaction_number = 1) <> (previous_transaction_step is null)
 or (customer_transaction_number = 1) <> (hours_since_previous_transaction is null)
 or (customer_transaction_number = 1) <> (days_since_previous_transaction is null)
 or previous_transaction_step > simulation_step
 or hours_since_previous_transaction <> simulation_step - previous_transaction_step
 or abs(days_since_previous_transaction - hours_since_previous_transaction / 24.0) > 1e-6"""


def _bad_history(t: str) -> str:
    amount = "transaction_amount::double"
    return f"""from {t} where historical_transaction_count <> customer_transaction_number - 1
 or transaction_count_last_10 <> least(historical_transaction_count, 10)
 or transaction_count_24h not between 0 and transaction_count_7d
 or transaction_count_7d > historical_transaction_count
 or (historical_transaction_count = 0) <> (customer_average_amount is null)
 or (historical_transaction_count = 0) <> (cumulative_transaction_value is null)
 or (historical_transaction_count = 0) <> (amount_vs_customer_average is null)
 or (coalesce(customer_average_amount, 0) = 0) <> (amount_to_customer_average_ratio is null)
 or (transaction_count_last_10 < 2) <> (std_last_10_transactions is null)
 or abs(amount_vs_customer_average - ({amount} - customer_average_amount)) > 1e-6
 or abs(amount_to_customer_average_ratio - {amount} / customer_average_amount) > 1e-6
 or (coalesce(std_last_10_transactions, 0) <= 0) <> (amount_zscore_last_10 is null)
 or abs(amount_zscore_last_10 - ({amount} - avg_last_10_transactions) / std_last_10_transactions) > 1e-6"""


def _bad_customers(t: str) -> str:
    return f"""from {t} where first_seen_step > last_seen_step or first_seen_day > last_seen_day
 or originated_transaction_count < 0 or received_transaction_count < 0
 or originated_transaction_count + received_transaction_count <> total_involved_transaction_count
 or total_involved_transaction_count <= 0"""


def _bad_days(t: str) -> str:
    return f"""from {t} where simulation_week < 1 or day_of_simulation_week not between 1 and 7
 or first_simulation_step > last_simulation_step or observed_hour_count not between 1 and 24
 or is_complete_day <> (observed_hour_count = 24)"""


def _bad_types(t: str) -> str:
    return f"""from {t} where transaction_count <= 0 or fraudulent_transaction_count > transaction_count
 or greatest(detected_fraud_count, missed_fraud_count) > fraudulent_transaction_count
 or detected_fraud_count + missed_fraud_count <> fraudulent_transaction_count
 or detected_fraud_count > flagged_transaction_count or fraud_rate_percent not between 0 and 100
 or (fraudulent_transaction_count = 0) <> (fraud_detection_rate_percent is null)
 or fraud_detection_rate_percent not between 0 and 100"""


def _bad_daily(t: str) -> str:
    return f"""from (select *, lag(fraud_rate_percent) over (order by simulation_day) previous,
  sum(transaction_count) over week rolling_count, sum(fraudulent_transaction_count) over week rolling_frauds,
  sum(transaction_count) over run running_count, sum(fraudulent_transaction_count) over run running_frauds
 from {t} window week as (order by simulation_day rows between 6 preceding and current row),
  run as (order by simulation_day rows unbounded preceding))
where transaction_count <= 0 or fraudulent_transaction_count not between 0 and transaction_count
 or fraud_rate_percent not between 0 and 100 or rolling_7d_fraud_rate_percent not between 0 and 100
 or rolling_7d_transaction_count <> rolling_count or rolling_7d_fraud_count <> rolling_frauds
 or cumulative_transaction_count <> running_count or cumulative_fraud_count <> running_frauds
 or (previous is null) <> (previous_day_fraud_rate_percent is null)
 or (previous is null) <> (fraud_rate_change_percentage_points is null)
 or abs(previous_day_fraud_rate_percent - previous) > 1e-6
 or abs(fraud_rate_change_percentage_points - (fraud_rate_percent - previous)) > 1e-6"""


def _bad_risk(t: str) -> str:
    return f"""from (select *, {_RANK} expected_rank from {t}) where transaction_count < 2
 or first_seen_day > last_seen_day or fraudulent_transaction_count not between 0 and transaction_count
 or fraudulent_transaction_amount < 0 or high_value_anomaly_count < 0
 or fraud_rate_percent not between 0 and 100 or average_hours_between_transactions < 0
 or customer_risk_rank <> expected_rank
 or customer_risk_level <> case when fraudulent_transaction_count > 0 then 'HIGH'
  when high_value_anomaly_count > 0 or maximum_amount_to_average_ratio >= 5 then 'MEDIUM' else 'LOW' end"""


def _behavior_totals(t: str) -> str:
    return f"""from (select {_MEASURES.replace(") transaction_count", ") fact_transaction_count")
  .replace(") transaction_amount_total", ") fact_transaction_amount_total")
  .replace(") fraudulent_transaction_count", ") fact_fraudulent_transaction_count")
  .replace("0) fraudulent_transaction_amount", "0) fact_fraudulent_transaction_amount")
  .replace(") flagged_transaction_count", ") fact_flagged_transaction_count")} from fact)
cross join (select sum(transaction_count) mart_transaction_count,
 sum(transaction_amount_total) mart_transaction_amount_total,
 sum(fraudulent_transaction_count) mart_fraudulent_transaction_count,
 sum(fraudulent_transaction_amount) mart_fraudulent_transaction_amount,
 sum(flagged_transaction_count) mart_flagged_transaction_count from {t})
where fact_transaction_count <> mart_transaction_count
 or fact_transaction_amount_total <> mart_transaction_amount_total
 or fact_fraudulent_transaction_count <> mart_fraudulent_transaction_count
 or fact_fraudulent_transaction_amount <> mart_fraudulent_transaction_amount
 or fact_flagged_transaction_count <> mart_flagged_transaction_count"""


def _bad_training(t: str) -> str:
    return f"""from {t} where transaction_amount < 0 or log_transaction_amount < 0
 or abs(log_transaction_amount - ln(1 + transaction_amount)) > 1e-6
 or (origin_balance_before = 0) <> (amount_to_origin_balance_ratio is null)
 or abs(amount_to_origin_balance_ratio - transaction_amount / nullif(origin_balance_before, 0)) > 1e-6
 or (destination_balance_before = 0) <> (amount_to_destination_balance_ratio is null)
 or abs(amount_to_destination_balance_ratio
  - transaction_amount / nullif(destination_balance_before, 0)) > 1e-6
 or origin_has_sufficient_balance <> (origin_balance_before >= transaction_amount)
 or destination_has_recorded_balance <> (destination_balance_before > 0)
 or is_merchant_destination <> (destination_account_type = 'MERCHANT')
 or is_transfer <> (transaction_type = 'TRANSFER')
 or is_cash_transaction <> (transaction_type in ('CASH_IN', 'CASH_OUT'))
 or is_higher_fraud_risk_type <> (transaction_type in ('TRANSFER', 'CASH_OUT'))
 or has_previous_transaction <> (previous_transaction_amount is not null)
 or has_full_10_transaction_history <> (transaction_count_last_10 = 10)
 or historical_transaction_count <> customer_transaction_number - 1
 or transaction_count_last_10 <> least(historical_transaction_count, 10)
 or transaction_count_24h > transaction_count_7d or transaction_count_7d > historical_transaction_count"""


def _training_totals(t: str) -> str:
    return f"""from (select count(*) fact_row_count, sum(transaction_amount) fact_total,
 sum(is_fraud::int) fact_fraud_count, sum(is_flagged_fraud::int) fact_flagged from fact)
cross join (select count(*) training_row_count, sum(transaction_amount::decimal(18,2)) training_total,
 sum(is_fraud::int) training_fraud_count, sum(baseline_rule_flag::int) training_flagged from {t})
where (fact_row_count, fact_total, fact_fraud_count, fact_flagged)
 <> (training_row_count, training_total, training_fraud_count, training_flagged)"""


def _misplaced(t: str) -> str:
    return f"""from {t} where case dataset_split when 'TRAIN' then simulation_step > 322
 when 'VALIDATION' then simulation_step not between 323 and 375 else simulation_step <= 375 end"""


def _one_class(t: str) -> str:
    return f"""select dataset_split, count(*) transaction_count, count(*) filter (where is_fraud) fraud_count,
 count(*) filter (where not is_fraud) legitimate_count from {t} group by dataset_split
having count(*) filter (where is_fraud) in (0, count(*))"""


def _orphans(child: str, key: str, parent: str, parent_key: str, where: str = "true") -> str:
    return f"""select {key} orphan_key, count(*) row_count from {child}
 where {where} and {key} not in (select {parent_key} from {parent}) group by {key}"""


def _counts_differ(left: str, right: str, names: tuple[str, str]) -> str:
    return f"""from (select count(*) {names[0]}_row_count from {left}),
 (select count(*) {names[1]}_row_count from {right}) where {names[0]}_row_count <> {names[1]}_row_count"""


_FACT_COLUMNS = [p.split(":")[0] for p in SHAPES["fact_partitioned_write"].split()]


def _nulls(t: str) -> str:
    return "select * from (" + " union all ".join(
        f"select '{c}' column_name, count(*) - count({c}) null_count from {t}"
        for c in _FACT_COLUMNS
    ) + ") where null_count > 0"


_TYPE_LIST = "'CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER'"

# Damaged copies of the relations, the same damage the Spark queries apply.
RELATIONS["holed"] = """select * replace (case when simulation_hour <> 0 then destination_account_id end
 as destination_account_id, case when transaction_type <> 'DEBIT' then is_fraud end as is_fraud) from fact"""
RELATIONS["doubled"] = "from fact union all from fact where simulation_hour = 3"
RELATIONS["retyped"] = """select * replace (case when simulation_hour < 2 then 'OLD_' else '' end
 || transaction_type as transaction_type) from fact"""
RELATIONS["active_customers"] = "from customers where customer_role <> 'DESTINATION_ONLY'"
RELATIONS["negated"] = """select * replace (case when transaction_type = 'DEBIT'
 then -destination_balance_after else destination_balance_after end as destination_balance_after) from staged"""
RELATIONS["late_hours"] = """select * replace (simulation_hour
 + case when transaction_type = 'TRANSFER' then 4 else 0 end as simulation_hour) from fact"""
RELATIONS["first_days"] = "from fact where simulation_day <= 15"
RELATIONS["later_rows"] = "from features where customer_transaction_number > 1"
RELATIONS["stuck"] = """select * replace (least(customer_transaction_number, 5)
 as customer_transaction_number) from features"""
RELATIONS["unlinked"] = """select * replace (case when customer_transaction_number <> 2
 then previous_transaction_step end as previous_transaction_step) from features"""
RELATIONS["shifted"] = """select * replace (customer_average_amount
 + case when simulation_hour = 5 then 1 else 0 end as customer_average_amount) from features"""
RELATIONS["overcounted"] = """select * replace (case when customer_role = 'ORIGIN_ONLY' then 1
 else received_transaction_count end as received_transaction_count) from customers"""
RELATIONS["flipped_days"] = """select * replace (is_complete_day <> (simulation_week = 2)
 as is_complete_day) from days"""
RELATIONS["miscounted"] = """select * replace (missed_fraud_count
 + case when transaction_type = 'TRANSFER' then 1 else 0 end as missed_fraud_count) from by_type"""
RELATIONS["drifted"] = """select * replace (rolling_7d_fraud_count
 + case when simulation_week = 3 then 1 else 0 end as rolling_7d_fraud_count) from daily"""
RELATIONS["misranked"] = """select * replace (customer_risk_rank
 + case when customer_risk_level = 'MEDIUM' then 1 else 0 end as customer_risk_rank) from risk"""
RELATIONS["overlapping"] = "from behavior union all from behavior where simulation_day = 1"
RELATIONS["short_behavior"] = "from behavior where simulation_day <= 15"
RELATIONS["mislabelled"] = """select * replace (is_transfer or transaction_type = 'CASH_OUT'
 as is_transfer) from training"""
RELATIONS["short_training"] = "from training where transaction_type <> 'CASH_OUT'"
RELATIONS["leaked"] = """select * replace (case when simulation_step > 700 then 'TRAIN'
 else dataset_split end as dataset_split) from ml"""
RELATIONS["one_class"] = """select * replace (is_fraud and dataset_split <> 'VALIDATION' as is_fraud) from ml"""

_DESTINATIONS = ("destination_account_id", "customer_id", "destination_account_type = 'CUSTOMER'")
ORACLES["check_not_null"] = _nulls("holed")
ORACLES["check_unique"] = _repeated("doubled", "transaction_id")
ORACLES["check_accepted_values"] = _unexpected("retyped", "transaction_type", _TYPE_LIST)
ORACLES["check_relationships"] = _orphans(
    "fact", "destination_account_id", "active_customers", "customer_id",
    "destination_account_type = 'CUSTOMER'",
)
ORACLES["check_non_negative_balances"] = _money_negative("negated")
ORACLES["check_valid_time"] = _bad_time("late_hours")
ORACLES["check_source_row_count"] = _counts_differ("raw", "first_days", ("source", "fact"))
ORACLES["check_feature_row_count"] = _counts_differ("fact", "later_rows", ("fact", "features"))
ORACLES["check_sequence_unique"] = _repeated(
    "stuck", "origin_account_id", "customer_transaction_number"
)
ORACLES["check_sequence_consistent"] = _bad_sequence("unlinked")
ORACLES["check_history_consistent"] = _bad_history("shifted")
ORACLES["check_dim_customer"] = _bad_customers("overcounted")
ORACLES["check_dim_day"] = _bad_days("flipped_days")
ORACLES["check_type_metrics"] = _bad_types("miscounted")
ORACLES["check_daily_consistent"] = _bad_daily("drifted")
ORACLES["check_customer_risk"] = _bad_risk("misranked")
ORACLES["check_behavior_grain"] = _repeated(
    "overlapping", "simulation_day", "transaction_type", "customer_role"
)
ORACLES["check_behavior_totals"] = _behavior_totals("short_behavior")
ORACLES["check_training_features"] = _bad_training("mislabelled")
ORACLES["check_training_totals"] = _training_totals("short_training")
ORACLES["check_split_temporal"] = _misplaced("leaked")
ORACLES["check_split_classes"] = _one_class("one_class")
ORACLES["check_mart_totals_agree"] = " union all ".join(
    f"""select '{m}' measure, (select sum({m}) from daily) = (select sum({m}) from by_type
 where fraudulent_transaction_count > 0)
 and (select sum({m}) from daily) = (select sum({m}) from behavior) agrees"""
    for m in (
        "transaction_count", "transaction_amount_total", "fraudulent_transaction_count",
        "fraudulent_transaction_amount", "flagged_transaction_count",
    )
)
ORACLES["check_non_empty"] = f"""select * from ({_MART_COUNTS} union all
 select 'mart_after_the_end', count(*) from daily where simulation_day > 31) where row_count = 0"""
_SUITE = [
    ("negative_balances", "staged", _money_negative("staged")),
    ("invalid_time", "enriched", _bad_time("fact")),
    ("source_row_count", "fact", _counts_differ("raw", "fact", ("source", "fact"))),
    ("feature_row_count", "features", _counts_differ("fact", "features", ("fact", "features"))),
    ("unique_id", "fact", _repeated("fact", "transaction_id")),
    ("accepted_types", "fact", _unexpected("fact", "transaction_type", _TYPE_LIST)),
    ("accepted_destinations", "fact",
     _unexpected("fact", "destination_account_type", "'CUSTOMER', 'MERCHANT'")),
    ("not_null", "fact", _nulls("fact")),
    ("customer_exists", "fact",
     _orphans("fact", "origin_account_id", "customers", "customer_id")),
    ("destination_exists", "fact",
     _orphans("fact", _DESTINATIONS[0], "customers", _DESTINATIONS[1], _DESTINATIONS[2])),
    ("type_exists", "fact", _orphans("fact", "transaction_type", "types", "transaction_type")),
    ("sequence_unique", "features",
     _repeated("features", "origin_account_id", "customer_transaction_number")),
    ("sequence_consistent", "features", _bad_sequence("features")),
    ("history_consistent", "features", _bad_history("features")),
    ("history_consistent", "dim_customer", _bad_customers("customers")),
    ("calendar_consistent", "dim_simulation_day", _bad_days("days")),
    ("metrics_consistent", "mart_fraud_by_transaction_type", _bad_types("by_type")),
    ("windows_consistent", "mart_fraud_daily", _bad_daily("daily")),
    ("rank_consistent", "mart_customer_risk", _bad_risk("risk")),
    ("grain_unique", "mart_transaction_behavior",
     _repeated("behavior", "simulation_day", "transaction_type", "customer_role")),
    ("totals_preserved", "mart_transaction_behavior", _behavior_totals("behavior")),
    ("features_consistent", "training_features", _bad_training("training")),
    ("totals_preserved", "training_features", _training_totals("training")),
    ("splits_temporal", "ml_dataset", _misplaced("ml")),
    ("splits_have_both_classes", "ml_dataset", _one_class("ml")),
]
ORACLES["quality_report"] = " union all ".join(
    f"select '{check}' check_name, '{table}' table_name, (select count(*) from ({sql})) failures"
    for check, table, sql in _SUITE
)


# Where each product of the column contracts is found.
_PRODUCTS = {
    "staged": "staged", "enriched": "fact", "fact": "fact", "features": "features",
    "dim_customer": "customers", "dim_simulation_day": "days",
    "dim_transaction_type": "types", "transaction_types": "types",
    "mart_fraud_by_transaction_type": "by_type", "mart_fraud_daily": "daily",
    "mart_customer_risk": "risk", "mart_transaction_behavior": "behavior",
    "training_features": "training", "ml_dataset": "ml",
}


def _contract_rows() -> str:
    parts = []
    for table, contract in CONTRACTS.items():
        t = _PRODUCTS[table]
        counts = {("not_null", c): f"count(*) - count({c})" for c in contract.not_null}
        for c, values in contract.accepted.items():
            listed = ", ".join(f"'{v}'" for v in values)
            counts["accepted_values", c] = f"count(*) filter (where {c} not in ({listed}))"
        rules = {key: f"(select {count} from {t})" for key, count in counts.items()}
        for c in contract.unique:
            rules["unique", c] = f"(select count(*) from ({_repeated(t, c)}))"
        for c, (parent, key, *where) in contract.references.items():
            orphans = _orphans(t, c, _PRODUCTS[parent], key, *where)
            rules["relationships", c] = (
                f"(select coalesce(sum(row_count), 0) from ({orphans}))"
            )
        parts += [
            f"select '{table}' table_name, '{check}' check_name, '{c}' column_name, {n} failures"
            for (check, c), n in rules.items()
        ]
    return " union all ".join(parts)


ORACLES["contract_report"] = _contract_rows()
# Queries over a damaged ledger: what stands in for the raw relation.
DAMAGED_LEDGER = {
    "contract_report": """
select * replace (case when step > 700 then 'REFUND' else type end as type,
 case when step < 100 and type = 'DEBIT' then 'X1' else namedest end as namedest,
 case when step not between 60 and 64 then amount end as amount)
from undamaged, (select unnest([1, 2]) copy) where copy = 1 or step between 50 and 64
""",
}


def _row_counts(**relations: str) -> str:
    return " union all ".join(
        f"select '{product}' product, count(*) row_count from {relation}"
        for product, relation in relations.items()
    )


ORACLES["tag_dashboard"] = _row_counts(
    mart_fraud_by_transaction_type="by_type",
    mart_fraud_daily="daily",
    mart_customer_risk="risk",
    mart_transaction_behavior="behavior",
)
ORACLES["tag_daily"] = _row_counts(
    transaction_types="types", staged="staged", enriched="fact", fact="fact",
    dim_simulation_day="days", mart_fraud_daily="daily",
)
ORACLES["tag_dimensions"] = _row_counts(
    dim_customer="customers", dim_simulation_day="days", dim_transaction_type="types"
)
ORACLES["tag_ml"] = _row_counts(
    transaction_types="types", staged="staged", enriched="fact", fact="fact",
    features="features", dim_simulation_day="days", dim_transaction_type="types",
    training_features="training", ml_dataset="ml",
)


def _needed(sql: str) -> list[str]:
    """Relations mentioned by `sql`, with those they mention, in definition order."""
    words = set(re.findall(r"\w+", sql))
    found: set[str] = set()
    for name in reversed(list(RELATIONS)):
        if name in words:
            found.add(name)
            words |= set(re.findall(r"\w+", RELATIONS[name]))
    return [name for name in RELATIONS if name in found]


def oracle(name: str) -> str:
    """The complete statement for a registered query."""
    body = ORACLES[name]
    relations = [f"{r} as ({RELATIONS[r].strip()})" for r in _needed(body)]
    if name in DAMAGED_LEDGER:
        relations[0] = f"undamaged as ({RELATIONS['raw'].strip()})"
        relations.insert(1, f"raw as ({DAMAGED_LEDGER[name].strip()})")
    relations.append(f"result as ({body.strip()})")
    return f"with {', '.join(relations)} {published_sql(name, 'result')}"
