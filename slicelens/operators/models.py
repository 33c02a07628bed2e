"""Slice classifiers fitted with Spark ML on balanced feature windows.

The training set is the balanced sample, whose size the caller caps; scoring
runs over any number of windows without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelens.operators.joins import stage
from slicelens.settings import CLASSES, CLASS_WEIGHTS, FEATURES, LABEL

SEED = 42
ROWS_PER_TASK = 50_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """A sample of known size in as few partitions as it needs, evaluated once.

    Iterative fits launch a task per partition and round, so a small sample must
    not stay spread over the partitions of the table it was taken from.
    """
    return stage(df.repartition(max(1, math.ceil(rows / ROWS_PER_TASK))), "sample")


def _fit(df: DataFrame, estimator, columns, features: str = "features") -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(columns), outputCol=features)
    return Pipeline(stages=[assembler, estimator]).fit(df)


def fit_random_forest(
    df: DataFrame, columns=FEATURES, label: str = LABEL, trees: int = 200, depth: int = 30
) -> PipelineModel:
    forest = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=1024,
        cacheNodeIds=True,
    )
    return _fit(df, forest, columns)


def fit_gradient_boost(
    df: DataFrame, columns=FEATURES, label: str = LABEL, rounds: int = 150,
    rate: float = 0.1, depth: int = 4,
) -> PipelineModel:
    """Boosted trees per class against the rest; Spark's boosting is binary."""
    boost = GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=SEED)
    return _fit(df, OneVsRest(classifier=boost, labelCol=label, parallelism=3), columns)


def kernel_weights(inputs: int, size: int, gamma: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions (one column a feature) and phases of the random features."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, math.sqrt(2.0 * gamma), (inputs, size))
    return directions, rng.uniform(0.0, 2.0 * math.pi, size)


def kernel_features(df: DataFrame, columns, size: int, gamma: float, seed: int = SEED) -> DataFrame:
    """Random Fourier features whose inner products approximate an RBF kernel.

    Rahimi and Recht, "Random features for large-scale kernel machines", 2007.
    """
    directions, phases = kernel_weights(len(columns), size, gamma, seed)
    scale = math.sqrt(2.0 / size)

    @F.pandas_udf("array<double>")
    def project(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in parts:
            x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            yield pd.Series(list(scale * np.cos(x @ directions + phases)))

    return df.withColumn("kernel", array_to_vector(project(*[F.col(c) for c in columns])))


class KernelModel:
    """A linear margin on random features; same ``transform`` as a pipeline."""

    def __init__(self, columns, size: int, gamma: float, model):
        self.columns, self.size, self.gamma, self.model = list(columns), size, gamma, model

    def transform(self, df: DataFrame) -> DataFrame:
        mapped = kernel_features(df, self.columns, self.size, self.gamma)
        return self.model.transform(mapped).drop("kernel")


def fit_rbf_svm(
    df: DataFrame, columns=FEATURES, label: str = LABEL, c: float = 10.0, size: int = 256,
    rounds: int = 50,
) -> KernelModel:
    """Margin classifier per class on random Fourier features of an RBF kernel.

    The kernel width follows the data: 1 / (columns x variance of all cells).
    """
    columns = list(columns)
    cells = F.explode(F.array(*columns)).alias("cell")
    seen = df.agg(F.count("*").alias("n")).first()["n"]
    variance = df.select(cells).agg(F.var_pop("cell")).first()[0]
    gamma = 1.0 / (len(columns) * (variance or 1.0))
    mapped = stage(kernel_features(df, columns, size, gamma).select("kernel", label), "kernel")
    margin = LinearSVC(regParam=1.0 / (c * seen), maxIter=rounds, standardization=False)
    rest = OneVsRest(classifier=margin, labelCol=label, featuresCol="kernel", parallelism=3)
    return KernelModel(columns, size, gamma, rest.fit(mapped))


def with_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    weight = F.lit(1.0)
    for c, w in CLASS_WEIGHTS.items():
        weight = F.when(F.col(label) == c, F.lit(w)).otherwise(weight)
    return df.withColumn("weight", weight)


def fit_weighted_logistic(df: DataFrame, columns=FEATURES, label: str = LABEL) -> PipelineModel:
    """Multinomial logistic regression with the class weights in its loss."""
    linear = LogisticRegression(labelCol=label, family="multinomial", weightCol="weight", maxIter=100)
    return _fit(with_weights(df, label), linear, columns)


def fit_weighted_network(
    df: DataFrame, columns=FEATURES, label: str = LABEL, hidden=(64, 32), rounds: int = 100
) -> PipelineModel:
    """Feed-forward network trained with the class weights.

    Spark's network takes no weight column. Repeating every row in proportion to
    its class weight, in the smallest whole numbers, gives the same loss.
    """
    exact = {c: Fraction(str(w)) for c, w in CLASS_WEIGHTS.items()}
    whole = lcm(*[w.denominator for w in exact.values()], 1)
    times = {c: int(w * whole) for c, w in exact.items()}
    shared = gcd(*times.values(), whole)
    n = F.lit(whole // shared)
    for c, w in times.items():
        n = F.when(F.col(label) == c, F.lit(w // shared)).otherwise(n)
    copies = F.sequence(F.lit(1), n)
    repeated = stage(with_weights(df, label).withColumn("_copy", F.explode(copies)).drop("_copy"), "repeated")
    network = MultilayerPerceptronClassifier(
        labelCol=label, layers=[len(columns), *hidden, len(CLASSES)], maxIter=rounds, seed=SEED
    )
    return _fit(repeated, network, columns)


def fit_binary_linear(df: DataFrame, columns, label: str, rounds: int = 50) -> PipelineModel:
    """Two-class margin classifier for labels -1 and +1."""
    mapped = df.withColumn("_y", (F.col(label) > 0).cast("double"))
    return _fit(mapped, LinearSVC(labelCol="_y", maxIter=rounds), columns)


def predict_sign(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions of a binary model as -1.0 and +1.0 in ``y_pred``."""
    return model.transform(df).withColumn("y_pred", F.col("prediction") * 2.0 - 1.0)


def score_table(models: dict, df: DataFrame, identity: str, label: str = LABEL) -> DataFrame:
    """Long table ``sample_id, model, y_true, y_pred, scores`` of several fitted or stored models.

    ``scores`` are class probabilities, or raw margins of models without them.
    """
    tables = []
    for name, model in models.items():
        scored = model.transform(df)
        made = [c for c in ("scores", "probability", "rawPrediction") if c in scored.columns]
        tables.append(
            scored.select(
                F.col(identity).alias("sample_id"),
                F.lit(name).alias("model"),
                F.col(label).cast("bigint").alias("y_true"),
                F.col("prediction").cast("bigint").alias("y_pred"),
                (F.col("scores") if made[0] == "scores" else vector_to_array(made[0])).alias("scores"),
            )
        )
    whole = tables[0]
    for part in tables[1:]:
        whole = whole.unionByName(part)
    return whole


def feature_importance(model: PipelineModel, df: DataFrame, columns=FEATURES) -> DataFrame:
    """One row per feature with its share of the forest's impurity decrease."""
    shares = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(share)) for name, share in zip(columns, shares)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def rank_importance(importance: DataFrame) -> DataFrame:
    return importance.orderBy("importance")
