"""The transaction graph: accounts are nodes, transactions directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import count_where, ratio
from ledgerwright.operators.ordered import exact_quantiles
from ledgerwright.session import freeze


def edge_pairs(fact: DataFrame) -> DataFrame:
    """One row per directed account pair with the totals of its transactions."""
    return fact.groupBy("origin_account_id", "destination_account_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        count_where(F.col("is_fraud")).alias("fraud_count"),
        F.sum("transaction_amount").alias("total_transaction_amount"),
        F.count("transaction_amount").alias("amount_count"),
        F.min("simulation_step").alias("minimum_step"),
        F.max("simulation_step").alias("maximum_step"),
    )


def node_degrees(fact: DataFrame) -> DataFrame:
    """Total degree (in + out) of every account. One scan; counts combine map-side."""
    ends = F.array("origin_account_id", "destination_account_id")
    return (
        fact.select(F.explode(ends).alias("account_id"))
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def distinct_nodes(fact: DataFrame) -> DataFrame:
    """Every account on either side, once."""
    return node_degrees(fact).select("account_id")


def graph_overview(fact: DataFrame) -> DataFrame:
    """Size, repetition, density and amounts of the graph, in one row."""
    self_loop = F.col("origin_account_id") == F.col("destination_account_id")
    edges = edge_pairs(fact).agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.count(F.lit(1)).alias("directed_pair_count"),
        F.sum("fraud_count").alias("fraud_count"),
        F.coalesce(F.sum(F.when(self_loop, F.col("transaction_count"))), F.lit(0)).alias(
            "self_loop_count"
        ),
        F.sum("total_transaction_amount").alias("total_transaction_amount"),
        ratio(F.sum("total_transaction_amount"), F.sum("amount_count")).alias(
            "average_transaction_amount"
        ),
        F.min("minimum_step").alias("minimum_step"),
        F.max("maximum_step").alias("maximum_step"),
    )
    nodes = distinct_nodes(fact).agg(F.count(F.lit(1)).alias("node_count"))
    node_count = F.col("node_count").cast("double")
    return (
        edges.withColumn("node_count", nodes.scalar())
        .withColumn(
            "repeated_edge_count", F.col("transaction_count") - F.col("directed_pair_count")
        )
        .withColumn(
            "fraud_rate_percent",
            ratio(F.col("fraud_count") * 100, F.col("transaction_count")),
        )
        .withColumn(
            "graph_density",
            F.when(
                F.col("node_count") > 1,
                F.col("directed_pair_count") / (node_count * (node_count - 1)),
            ).otherwise(0.0),
        )
    )


def degree_distribution(fact: DataFrame) -> DataFrame:
    """Mean, exact median and maximum degree, and the share of degree-one accounts.

    Accounts are first folded to one row per degree value.
    """
    by_degree = freeze(
        node_degrees(fact).groupBy("degree").agg(F.count(F.lit(1)).alias("accounts")), "degrees"
    )
    weighted = F.sum(F.col("degree") * F.col("accounts"))
    totals = by_degree.agg(
        F.sum("accounts").alias("node_count"),
        (weighted.cast("double") / F.sum("accounts")).alias("average_degree"),
        F.max("degree").alias("maximum_degree"),
        F.coalesce(F.sum(F.when(F.col("degree") == 1, F.col("accounts"))), F.lit(0)).alias(
            "degree_one_count"
        ),
    )
    median = exact_quantiles(
        by_degree, ["degree"], {"median_degree": 0.5}, weight="accounts"
    )
    return totals.withColumn("median_degree", median.select("median_degree").scalar())
