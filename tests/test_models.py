"""Preprocessing statistics and model training."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerwright.plans import metrics, models, preprocessing
from ledgerwright.plans.training import MODEL_COLUMNS
from registry.queries import QUERIES


@pytest.fixture(scope="module")
def dataset(spark):
    """Fraud follows a small destination ratio and the transfer type."""
    seed = random.Random(5)
    kinds = ["TRANSFER", "CASH_OUT", "PAYMENT", "CASH_IN", "DEBIT"]
    rows = []
    for i in range(1500):
        kind = seed.choice(kinds)
        hour = seed.randint(0, 23)
        fraud = kind == "TRANSFER" and hour < 8 and seed.random() < 0.9
        rows.append(
            {
                "transaction_id": f"{i:032X}",
                "simulation_hour": hour,
                "day_of_simulation_week": seed.randint(1, 7),
                "transaction_type": kind,
                "destination_account_type": "MERCHANT" if kind == "PAYMENT" else "CUSTOMER",
                "log_transaction_amount": seed.uniform(1, 12),
                "origin_balance_before": seed.uniform(0, 1e5),
                "destination_balance_before": seed.uniform(0, 1e5),
                "amount_to_origin_balance_ratio": None if i % 9 == 0 else seed.uniform(0, 3),
                "amount_to_destination_balance_ratio": seed.uniform(0, 3),
                "origin_has_sufficient_balance": seed.random() < 0.5,
                "destination_has_recorded_balance": seed.random() < 0.5,
                "is_merchant_destination": kind == "PAYMENT",
                "has_previous_transaction": seed.random() < 0.5,
                "customer_transaction_number": seed.randint(1, 20),
                "transaction_count_last_10": seed.randint(0, 10),
                "transaction_count_24h": seed.randint(0, 3),
                "transaction_count_7d": seed.randint(0, 9),
                "is_fraud": fraud,
                "dataset_split": "TRAIN" if i < 900 else "VALIDATION" if i < 1200 else "TEST",
            }
        )
    schema = ", ".join(
        f"{c} {'string' if isinstance(rows[1][c], str) else 'boolean' if isinstance(rows[1][c], bool) else 'int' if isinstance(rows[1][c], int) else 'double'}"
        for c in rows[1]
    )
    assert set(rows[0]) <= set(MODEL_COLUMNS)
    return spark.createDataFrame(rows, schema).cache()


def test_modes_prefer_the_smallest_among_ties(spark):
    df = spark.createDataFrame(
        [("b", 1.0), ("a", 0.0), ("b", None), ("a", None), (None, None)], "c string, f double"
    )
    modes = {r.feature: r.value for r in preprocessing.most_frequent(df, ["c", "f"]).collect()}
    assert modes == {"c": "a", "f": "0.0"}


def test_unknown_levels_are_all_zero_and_first_is_dropped(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "c string")
    columns = preprocessing.one_hot(F.col("c"), "c", ["b", "a", "d"], drop_first=True)
    assert list(columns) == ["c_b", "c_d"]
    rows = df.select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]


def test_fitted_columns_are_filled_and_standardised(dataset):
    train = preprocessing.linear_inputs(dataset).filter("dataset_split = 'TRAIN'")
    fitted = preprocessing.linear_preprocessor().fit(train)
    rows = fitted.transform(train)
    ratio = "log_amount_to_origin_balance_ratio"
    row = rows.agg(
        F.count_if(F.col(ratio).isNull()).alias("nulls"),
        F.avg(ratio).alias("mean"),
        F.stddev_pop(ratio).alias("deviation"),
    ).first()
    assert row.nulls == 0
    assert row["mean"] == pytest.approx(0, abs=1e-9)
    assert row.deviation == pytest.approx(1)


def test_infinite_and_missing_inputs(spark, dataset):
    damaged = dataset.withColumns(
        {
            "log_transaction_amount": F.lit(float("inf")),
            "transaction_type": F.lit(None).cast("string"),
        }
    )
    row = preprocessing.tree_inputs(damaged).first()
    assert row.log_transaction_amount is None and row.transaction_type == "__MISSING__"


def test_class_weights(spark):
    df = spark.createDataFrame([(1.0,)] * 2 + [(0.0,)] * 8, "label double")
    row = preprocessing.class_weights(df).first()
    assert (row.scale_positive, row.weight_positive, row.weight_negative) == (4.0, 2.5, 0.625)


@pytest.mark.parametrize(
    "train",
    [
        models.train_logistic_regression,
        lambda d: models.train_random_forest(d, trees=10, depth=6),
        lambda d: models.train_gradient_boosting(d, rounds=8),
    ],
    ids=["linear", "forest", "boosted"],
)
def test_models_rank_frauds_first(dataset, train):
    trained = train(dataset)
    scored = trained.score(dataset)
    assert scored.count() == dataset.count()
    auc = metrics.roc_auc(scored.filter("dataset_split = 'TEST'")).first().roc_auc
    assert auc > 0.9
    importance = models.feature_importance(trained, dataset).collect()
    assert importance[0].magnitude >= importance[-1].magnitude
    assert "transaction_type_TRANSFER" in {r.feature for r in importance[:4]}


@pytest.mark.parametrize(
    "train",
    [models.train_logistic_regression, lambda d: models.train_random_forest(d, trees=2, depth=2)],
    ids=["linear", "forest"],
)
def test_models_score_in_a_session_that_has_observed(spark, dataset, train):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    assert train(dataset).score(dataset).agg(F.count("score")).first()[0] == dataset.count()


def test_forest_scores_are_those_of_the_library(dataset):
    trained = models.train_random_forest(dataset, trees=7, depth=9)
    mine = {r.transaction_id: (r.dataset_split, r.label, r.score) for r in trained.score(dataset).collect()}
    other = models.Trained.score(trained, dataset)
    assert mine == {r.transaction_id: (r.dataset_split, r.label, r.score) for r in other.collect()}
    # The model does not travel with the tasks.
    assert "UDF" not in trained.score(dataset)._jdf.queryExecution().executedPlan().toString()
    assert len(trained.nodes) == 7 and trained.score(dataset.limit(0)).count() == 0


def test_importances_need_no_stored_forest(dataset, monkeypatch):
    trained = models.train_random_forest(dataset, trees=3, depth=4)
    with monkeypatch.context() as patched:
        patched.setattr(models, "_written", None)
        importance = trained.importance()
    read_back = [float(w) for w in trained.model.featureImportances.toArray()]
    assert [w for _, w in importance] == read_back and sum(read_back) > 0.99


def test_many_training_rows_get_a_partition_per_slot(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_A_TASK", 10)
    rows = spark.range(0, 100, numPartitions=5)
    slots = spark.sparkContext.defaultParallelism
    dealt = models._dealt(rows, 10 * slots)
    assert dealt.rdd.getNumPartitions() == slots and dealt.count() == 100
    assert models._dealt(rows, 10 * slots - 1).rdd.getNumPartitions() == 5


def test_training_needs_frauds(dataset):
    with pytest.raises(ValueError):
        models.train_random_forest(dataset.withColumn("is_fraud", F.lit(False)), trees=1)


def test_boosting_keeps_the_best_round_of_those_tried(dataset):
    model = models.train_gradient_boosting(dataset, rounds=9, patience=3).model
    tried = model.precisions
    assert model.best_round == tried.index(max(tried)) + 1 == len(model.trees)
    assert model.best_score == max(tried)
    # Ends at the limit, or when three rounds have not improved on the best.
    assert len(tried) == 9 or len(tried) - model.best_round == 3


def test_too_many_levels_name_the_column(dataset):
    train = preprocessing.linear_inputs(dataset).filter("dataset_split = 'TRAIN'")
    fitted = preprocessing.linear_preprocessor()
    fitted.maximum_levels = 1
    with pytest.raises(ValueError, match="transaction_type has"):
        fitted.fit(train)


@pytest.mark.parametrize("name", ["train_random_forest", "feature_importance"])
def test_registered_forests_have_the_full_size(spark, dataset, monkeypatch, name):
    class Built(Exception):
        pass

    def build(**given):
        raise Built({k: given[k] for k in ("numTrees", "maxDepth")})

    monkeypatch.setattr(models, "RandomForestClassifier", build)
    products = SimpleNamespace(frozen=lambda *names: None, modeling_rows=dataset, raw=dataset)
    with pytest.raises(Built) as built:
        QUERIES[name](products, spark)
    assert built.value.args[0] == {"numTrees": 500, "maxDepth": 16}


def test_registered_boosting_has_the_full_size(spark, dataset, monkeypatch):
    class Built(Exception):
        pass

    def fit(train, validation, names, settings, patience, labelled_rows):
        raise Built(settings, patience, labelled_rows, validation is not None)

    monkeypatch.setattr(models.boosting, "fit", fit)
    products = SimpleNamespace(frozen=lambda *names: None, modeling_rows=dataset, raw=dataset)
    with pytest.raises(Built) as built:
        QUERIES["train_gradient_boosting"](products, spark)
    settings, patience, rows, validated = built.value.args
    assert (settings.rounds, settings.rate, settings.depth, settings.least_weight) == (1200, 0.03, 6, 5.0)
    assert (settings.l1, settings.l2, settings.row_share, settings.column_share) == (0.1, 2.0, 0.8, 0.8)
    assert patience == 75 and rows == 8_000_000 and validated
