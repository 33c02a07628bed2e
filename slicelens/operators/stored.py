"""Fitted models as tables, and scoring from those tables.

A model is a few small tables committed together: ``kind`` names its sort, its
input columns and its classes; ``linear``, ``kernel``, ``layers`` or ``trees``
hold what was fitted. Linear models score as column expressions; networks,
kernels and trees in batches. No fitted object is needed to score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    OneVsRestModel,
    RandomForestClassificationModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelens.operators.joins import scratch_path
from slicelens.operators.models import KernelModel, kernel_weights
from slicelens.sources import sinks

LINEAR = "cls int, intercept double, weights array<double>"
KERNEL = "feature int, phase double, direction array<double>"
LAYERS = "layer int, unit int, bias double, weights array<double>"


def _linear_rows(model) -> list[tuple]:
    """One row a class: the margin of a class is its intercept plus its weights times the inputs."""
    if isinstance(model, LogisticRegressionModel):
        weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        return [(c, float(b), w.tolist()) for c, (w, b) in enumerate(zip(weights, intercepts, strict=True))]
    each = model.models if isinstance(model, OneVsRestModel) else [model]
    return [(c, float(m.intercept), m.coefficients.toArray().tolist()) for c, m in enumerate(each)]


def _layer_rows(model: MultilayerPerceptronClassificationModel) -> list[tuple]:
    """One row a unit; a layer's weights are stored by column, its biases behind them."""
    flat, sizes = model.weights.toArray(), model.getLayers()
    rows, at = [], 0
    for layer, (width, units) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        weights = flat[at : at + width * units].reshape(width, units).T
        biases = flat[at + width * units : at + (width + 1) * units]
        at += (width + 1) * units
        rows += [(layer, u, float(biases[u]), weights[u].tolist()) for u in range(units)]
    return rows


def _tree_table(spark: SparkSession, model, cls: int) -> DataFrame:
    """One row a tree: arrays of its nodes, and its weight in the sum of its class."""
    place = scratch_path(spark, "trees")
    model.write().save(place)
    node = F.col("node")
    leaf = node["impurityStats"] if isinstance(model, RandomForestClassificationModel) else F.array(node["prediction"])
    threshold = F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))
    nodes = spark.read.parquet(f"{place}/data").select("treeID", F.col("nodeData").alias("node")).select(
        "treeID",
        F.struct(
            node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"), threshold.alias("threshold"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"), leaf.alias("leaf"),
        ).alias("node"),
    )
    weights = F.create_map(*[F.lit(x) for pair in enumerate(map(float, model.treeWeights)) for x in pair])
    return nodes.groupBy("treeID").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select(
        F.lit(cls).alias("cls"), F.col("treeID").alias("tree"),
        F.element_at(weights, F.col("treeID")).alias("weight"), "nodes",
    )


def model_tables(spark: SparkSession, model) -> dict[str, DataFrame]:
    """The tables of a fitted model of :mod:`slicelens.operators.models`."""
    tables = {}
    if isinstance(model, KernelModel):
        columns, fitted, kind = model.columns, model.model, "kernel"
        directions, phases = kernel_weights(len(columns), model.size, model.gamma)
        rows = [(i, float(phases[i]), directions[:, i].tolist()) for i in range(model.size)]
        tables["kernel"] = spark.createDataFrame(rows, KERNEL)
    elif isinstance(model, PipelineModel):
        columns, fitted, kind = model.stages[0].getInputCols(), model.stages[-1], None
    else:
        raise TypeError(f"no tables for {type(model).__name__}")
    if isinstance(fitted, MultilayerPerceptronClassificationModel):
        kind = "network"
        tables["layers"] = spark.createDataFrame(_layer_rows(fitted), LAYERS)
    elif isinstance(fitted, RandomForestClassificationModel):
        kind = "forest"
        tables["trees"] = _tree_table(spark, fitted, 0)
    elif isinstance(fitted, OneVsRestModel) and isinstance(fitted.models[0], GBTClassificationModel):
        kind = "boost"
        each = [_tree_table(spark, m, c) for c, m in enumerate(fitted.models)]
        tables["trees"] = reduce(DataFrame.unionByName, each)
    else:
        kind = kind or ("binary" if isinstance(fitted, LinearSVCModel) else
                        "logistic" if isinstance(fitted, LogisticRegressionModel) else "margins")
        tables["linear"] = spark.createDataFrame(_linear_rows(fitted), LINEAR)
    tables["kind"] = spark.createDataFrame([(kind, list(columns))], "kind string, columns array<string>")
    return tables


def save_model(spark: SparkSession, model, folder: str) -> None:
    """Write a model's tables; they become the stored model together or not at all."""
    sinks.write_report(model_tables(spark, model), folder)


def load_model(spark: SparkSession, folder: str) -> StoredModel:
    """The model stored in ``folder``."""
    return StoredModel(sinks.read_report(spark, folder))


def _dot(weights: list[float], inputs: list[Column]) -> Column:
    return reduce(Column.__add__, [F.lit(w) * x for w, x in zip(weights, inputs, strict=True)])


def _softmax(margins: list[Column]) -> list[Column]:
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    powers = [F.exp(m - top) for m in margins]
    total = reduce(Column.__add__, powers)
    return [p / total for p in powers]


def _walked(trees: list, classes: int, boosted: bool):
    """Scores of batches by walking the nodes of every tree."""
    arrays = [
        (t.cls, t.weight, np.array([n.feature for n in t.nodes]), np.array([n.threshold or 0.0 for n in t.nodes]),
         np.array([n.left for n in t.nodes]), np.array([n.right for n in t.nodes]), np.array([n.leaf for n in t.nodes]))
        for t in trees
    ]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in parts:
            x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            scores = np.zeros((len(x), classes))
            rows = np.arange(len(x))
            for cls, weight, feature, threshold, left, right, leaf in arrays:
                at = np.zeros(len(x), np.int64)
                moving = rows[left[at] >= 0]
                while len(moving):
                    node = at[moving]
                    goes_left = x[moving, feature[node]] <= threshold[node]
                    at[moving] = np.where(goes_left, left[node], right[node])
                    moving = moving[left[at[moving]] >= 0]
                found = leaf[at]
                if boosted:
                    scores[:, cls] += weight * found[:, 0]
                else:
                    scores += weight * found / found.sum(axis=1, keepdims=True)
            yield pd.Series(list(scores if boosted else scores / scores.sum(axis=1, keepdims=True)))

    return run


class StoredModel:
    """Scores rows from a model's tables; they are as small as the model, not the data."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.kind, self.columns = tables["kind"].first()
        self.linear = tables["linear"].orderBy("cls").collect() if "linear" in tables else []
        self.kernel = tables["kernel"].orderBy("feature").collect() if "kernel" in tables else []
        self.layers = tables["layers"].orderBy("layer", "unit").collect() if "layers" in tables else []
        self.trees = tables["trees"].orderBy("cls", "tree").collect() if "trees" in tables else []

    def _network(self) -> Column:
        """Layers in batches: as expressions, every unit would evaluate the layer before it anew."""
        layers = []
        for layer in range(1 + max(u.layer for u in self.layers)):
            units = [u for u in self.layers if u.layer == layer]
            layers.append((np.array([u.weights for u in units]).T, np.array([u.bias for u in units])))

        @F.pandas_udf("array<double>")
        def probabilities(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in parts:
                x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
                for weights, biases in layers[:-1]:
                    x = 1.0 / (1.0 + np.exp(-(x @ weights + biases)))
                x = x @ layers[-1][0] + layers[-1][1]
                x = np.exp(x - x.max(axis=1, keepdims=True))
                yield pd.Series(list(x / x.sum(axis=1, keepdims=True)))

        return probabilities(*[F.col(c) for c in self.columns])

    def _kernel(self) -> Column:
        """All margins at once: the kernel features are too many for one expression each."""
        directions = np.array([k.direction for k in self.kernel]).T
        phases = np.array([k.phase for k in self.kernel])
        weights = np.array([c.weights for c in self.linear]).T
        intercepts = np.array([c.intercept for c in self.linear])
        scale = np.sqrt(2.0 / len(phases))

        @F.pandas_udf("array<double>")
        def margins(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in parts:
                x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
                yield pd.Series(list(scale * np.cos(x @ directions + phases) @ weights + intercepts))

        return margins(*[F.col(c) for c in self.columns])

    def scores(self) -> Column:
        """Probabilities of the classes, or raw margins of models without them."""
        inputs = [F.col(c).cast("double") for c in self.columns]
        if self.kind == "network":
            return self._network()
        if self.kind == "kernel":
            return self._kernel()
        if self.trees:
            boosted = self.kind == "boost"
            classes = 1 + max(t.cls for t in self.trees) if boosted else len(self.trees[0].nodes[0].leaf)
            return F.pandas_udf(_walked(self.trees, classes, boosted), "array<double>")(*inputs)
        margins = [F.lit(c.intercept) + _dot(c.weights, inputs) for c in self.linear]
        if self.kind == "binary":
            margins = [-margins[0], margins[0]]
        return F.array(*(_softmax(margins) if self.kind == "logistic" else margins))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``scores`` and ``prediction``, the first class with the highest score."""
        scored = df.withColumn("scores", self.scores())
        best = F.array_position("scores", F.array_max("scores")) - 1
        return scored.withColumn("prediction", best.cast("double"))
