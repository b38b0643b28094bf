"""Model training on distributed data: MLlib's linear model and forest, own boosting."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.plans import boosting
from ledgerwright.plans.preprocessing import (
    Preprocessor,
    class_weights,
    linear_inputs,
    linear_preprocessor,
    tree_inputs,
    tree_preprocessor,
)
from ledgerwright.session import freeze, scratch_path

# Training parameters.
SEED = 42
INVERSE_REGULARISATION = 1.0
LINEAR_ITERATIONS = 1000
FOREST_TREES = 500
FOREST_DEPTH = 16
FOREST_LEAF = 4
BAGGING = 0.8
# Training rows that are worth a task of their own.
ROWS_A_TASK = 2000
BOOSTING_ROUNDS = 1200
BOOSTING_RATE = 0.03
BOOSTING_DEPTH = 6
BOOSTING_LEAF = 5.0
BOOSTING_L1 = 0.1
BOOSTING_L2 = 2.0
BOOSTING_COLUMNS = 0.8
# Rounds without a better average precision on the validation split before boosting ends.
BOOSTING_PATIENCE = 75


@dataclass
class Trained:
    """A fitted model with the preprocessing it expects."""

    model: object
    preprocessor: Preprocessor
    inputs: object

    def _vectors(self, dataset: DataFrame) -> DataFrame:
        return _assemble(self.preprocessor, self.inputs(dataset))

    def score(self, dataset: DataFrame) -> DataFrame:
        """Id, split, label and fraud probability of every row."""
        return self.model.transform(self._vectors(dataset)).select(
            "transaction_id",
            "dataset_split",
            F.col("label").cast("int").alias("label"),
            vector_to_array("probability")[1].alias("score"),
        )

    def importance(self) -> list[tuple[str, float]]:
        """Coefficient or importance of every model input, by name."""
        weights = (
            self.model.coefficients
            if hasattr(self.model, "coefficients")
            else self.model.featureImportances
        )
        return list(zip(self.preprocessor.columns(), [float(w) for w in weights.toArray()]))


@dataclass
class Boosted(Trained):
    """Boosted trees; `model` knows its best round and every round's validation score."""

    def score(self, dataset: DataFrame) -> DataFrame:
        rows = self.preprocessor.transform(self.inputs(dataset))
        scored = self.model.scored(rows, ["transaction_id", "dataset_split", "label"])
        return scored.withColumn("label", F.col("label").cast("int"))

    def importance(self) -> list[tuple[str, float]]:
        return list(zip(self.model.names, [float(w) for w in self.model.importances()]))


class Forest(Trained):
    """A random forest that scores by tables of its nodes, which are sent once to each
    Python worker.

    MLlib sends the whole model with every task and walks every tree for one row before
    the next; here every tree is walked for a batch of rows. The sums are MLlib's: each
    tree adds its leaf's share of either class, in the order of the trees.

    The forest is stored when it first scores, and read back as a `model` only when that is
    asked for: the driver alone reads it, and its importances do not need either.
    """

    def __init__(self, fitted: RandomForestClassificationModel, preprocessor: Preprocessor, inputs: object):
        self.fitted = fitted
        self.preprocessor = preprocessor
        self.inputs = inputs

    @cached_property
    def _path(self) -> str:
        return _written(SparkSession.active(), self.fitted)

    @cached_property
    def model(self) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(self._path)

    @cached_property
    def nodes(self) -> list[tuple[np.ndarray, ...]]:
        return _nodes(SparkSession.active(), self._path)

    def importance(self) -> list[tuple[str, float]]:
        weights = self.fitted.featureImportances.toArray()
        return list(zip(self.preprocessor.columns(), [float(w) for w in weights]))

    def score(self, dataset: DataFrame) -> DataFrame:
        keep = ["transaction_id", "dataset_split", "label"]
        names = list(self.preprocessor.columns())
        rows = self.preprocessor.transform(self.inputs(dataset))
        given = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
        sent = rows.sparkSession.sparkContext.broadcast(self.nodes)

        def run(batches):
            for batch in batches:
                values = [batch.column(len(keep) + i).to_numpy() for i in range(len(names))]
                flat = np.ascontiguousarray(np.array(values, np.float64).reshape(len(names), -1).T).ravel()
                row = np.arange(batch.num_rows) * len(names)
                votes = np.zeros((2, batch.num_rows))
                for feature, threshold, left, right, legitimate, fraud in sent.value:
                    node = np.zeros(batch.num_rows, np.int64)
                    active = np.arange(batch.num_rows)
                    while len(active := active[left.take(node[active]) >= 0]):
                        at = node[active]
                        goes = flat.take(row[active] + feature.take(at)) <= threshold.take(at)
                        node[active] = np.where(goes, left.take(at), right.take(at))
                    votes[0] += legitimate.take(node)
                    votes[1] += fraud.take(node)
                score = votes[1] / votes.sum(axis=0)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

        scored = given.mapInArrow(run, given.select(*keep).schema.add("score", "double"))
        return scored.withColumn("label", F.col("label").cast("int"))


def _nodes(spark: SparkSession, path: str) -> list[tuple[np.ndarray, ...]]:
    """Per tree of a stored forest: feature, threshold, children (-1: a leaf) and both
    classes' shares of every node, as arrays; the root is node 0."""
    stats = F.col("nodeData.impurityStats")
    split = F.col("nodeData.split")
    table = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            F.col("nodeData.id").alias("id"),
            split["featureIndex"].alias("feature"),
            F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
            F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"),
            stats[0].alias("legitimate"),
            stats[1].alias("fraud"),
        )
        .toArrow()
        .sort_by([("treeID", "ascending"), ("id", "ascending")])
    )
    tree = table["treeID"].to_numpy()
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    trees = []
    for first, stop in zip(starts, [*starts[1:], len(tree)], strict=True):
        part = table.slice(first, stop - first)
        column = {c: part[c].fill_null(0).to_numpy() for c in part.column_names}
        # Nodes are numbered in pre-order from 0.
        if not np.array_equal(column["id"], np.arange(len(part))):
            raise ValueError("a stored tree lacks nodes")
        total = column["legitimate"] + column["fraud"]
        some = np.where(total == 0, 1.0, total)
        trees.append(
            (
                np.maximum(column["feature"], 0).astype(np.int32),
                column["threshold"].astype(np.float64),
                column["left"].astype(np.int32),
                column["right"].astype(np.int32),
                column["legitimate"] / some,
                column["fraud"] / some,
            )
        )
    return trees


def _assemble(preprocessor: Preprocessor, inputs: DataFrame) -> DataFrame:
    names = list(preprocessor.columns())
    return (
        VectorAssembler(inputCols=names, outputCol="features")
        .transform(preprocessor.transform(inputs))
        .select("transaction_id", "dataset_split", "label", "features")
    )


def _prepare(inputs: DataFrame, preprocessor: Preprocessor) -> tuple[DataFrame, dict]:
    """Frozen, assembled training rows with the weights of their classes."""
    rows = freeze(inputs.filter(F.col("dataset_split") == "TRAIN"), "train")
    weights = class_weights(rows).first().asDict()
    if not weights["positives"]:
        raise ValueError("the training split holds no fraud")
    return _assemble(preprocessor.fit(rows), rows), weights


def _written(spark: SparkSession, model) -> str:
    """The folder that a fitted model was written to, below the shared scratch folder.

    A fitted model holds its training summary, whose rows hold the session, and all of it
    would go to the tasks that score. A session that has observed metrics of a write cannot
    be sent at all. A model that was read back holds its parameters alone.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    return path


def train_logistic_regression(
    dataset: DataFrame, iterations: int = LINEAR_ITERATIONS
) -> Trained:
    """L2 logistic regression with balanced classes.

    The penalty `1 / (C * sum of weights)` restates an inverse strength C on a summed
    loss for MLlib's mean loss; inputs are already standardised.
    """
    preprocessor = linear_preprocessor()
    train, weights = _prepare(linear_inputs(dataset), preprocessor)
    weighted = train.withColumn(
        "weight",
        F.when(F.col("label") == 1, weights["weight_positive"]).otherwise(
            weights["weight_negative"]
        ),
    )
    estimator = LogisticRegression(
        weightCol="weight",
        regParam=1.0 / (INVERSE_REGULARISATION * weights["rows"]),
        elasticNetParam=0.0,
        maxIter=iterations,
        standardization=False,
    )
    path = _written(dataset.sparkSession, estimator.fit(weighted))
    return Trained(LogisticRegressionModel.load(path), preprocessor, linear_inputs)


def _dealt(train: DataFrame, rows: int) -> DataFrame:
    """Training rows in one even partition per slot, as every level of the trees reads them
    again; few rows stay as they are."""
    slots = train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(slots) if rows >= slots * ROWS_A_TASK else train


def train_random_forest(
    dataset: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH
) -> Trained:
    """Bagged trees on balanced class weights.

    Rows are drawn partition by partition, so the trees follow the layout of the rows.
    """
    preprocessor = tree_preprocessor()
    train, weights = _prepare(tree_inputs(dataset), preprocessor)
    weighted = train.withColumn(
        "weight",
        F.when(F.col("label") == 1, weights["weight_positive"]).otherwise(
            weights["weight_negative"]
        ),
    )
    estimator = RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=FOREST_LEAF,
        featureSubsetStrategy="sqrt",
        subsamplingRate=BAGGING,
        bootstrap=True,
        weightCol="weight",
        seed=SEED,
        cacheNodeIds=True,
        maxMemoryInMB=1024,
    )
    return Forest(estimator.fit(_dealt(weighted, weights["rows"])), preprocessor, tree_inputs)


def train_gradient_boosting(
    dataset: DataFrame,
    rounds: int = BOOSTING_ROUNDS,
    depth: int = BOOSTING_DEPTH,
    validate: bool = True,
    patience: int = BOOSTING_PATIENCE,
    labelled_rows: int = boosting.LABELLED_ROWS,
) -> Boosted:
    """Boosted trees with the positive class scaled up.

    With `validate`, the model ends at the round with the best average precision on the
    validation split, and boosting ends when `patience` rounds have not improved on it.
    """
    preprocessor = tree_preprocessor()
    inputs = tree_inputs(dataset)
    rows = freeze(inputs.filter(F.col("dataset_split") == "TRAIN"), "train")
    weights = class_weights(rows).first().asDict()
    if not weights["positives"]:
        raise ValueError("the training split holds no fraud")
    preprocessor.fit(rows)
    settings = boosting.Settings(
        rounds=rounds,
        rate=BOOSTING_RATE,
        depth=depth,
        least_weight=BOOSTING_LEAF,
        row_share=BAGGING,
        column_share=BOOSTING_COLUMNS,
        l1=BOOSTING_L1,
        l2=BOOSTING_L2,
        scale=weights["scale_positive"],
        seed=SEED,
    )
    held_out = None
    if validate:
        held_out = preprocessor.transform(inputs.filter(F.col("dataset_split") == "VALIDATION"))
    model = boosting.fit(
        preprocessor.transform(rows), held_out, list(preprocessor.columns()), settings, patience, labelled_rows
    )
    return Boosted(model, preprocessor, tree_inputs)


def feature_importance(trained: Trained, like: DataFrame) -> DataFrame:
    """(feature, importance, magnitude) rows, the strongest first."""
    rows = like.sparkSession.createDataFrame(
        trained.importance(), "feature string, importance double"
    )
    return rows.withColumn("magnitude", F.abs("importance")).orderBy(
        F.desc("magnitude"), "feature"
    )
