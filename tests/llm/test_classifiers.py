"""Both classifiers, by held-out accuracy and on odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelens.llm import quality, toxicity
from slicelens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, label int, positive string"


def accuracy(spark, folder, name, label):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES[name](spark, folder).join(labels, "doc_id").filter("held_out").select("score", "predicted", label)
    found = [(r.score, r.predicted, r[label]) for r in rows.collect()]
    assert all(0 <= s <= 1 for s, _, _ in found)
    return [(p, y) for _, p, y in found]


def test_quality_held_out(spark):
    found = accuracy(spark, "/root/testdata/sf0.01", "op2_quality_classifier", "quality")
    assert np.mean([p == y for p, y in found]) > 0.95
    assert np.mean([p for p, y in found if y == 1]) > 0.95


def test_toxicity_held_out(spark):
    found = accuracy(spark, "/root/testdata/sf0.1", "op5_toxicity", "toxic")
    assert np.mean([p == y for p, y in found]) > 0.96
    assert np.mean([p for p, y in found if y == 1]) > 0.8


def odd_texts():
    rng = random.Random(0)
    prose = [" ".join(rng.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(60)) for _ in range(200)]
    rows = [(i, t if i % 4 else t.upper() + " vile!!" * 9, "s", i % 4, "p") for i, t in enumerate(prose)]
    rows += [(900, None, "s", 0, "p"), (901, "", "s", 0, "p"), (902, " \n", "s", 0, "p"), (903, "é" * 2_500_000, "s", 0, "p"),
             (904, "sun moon " * 300_000, "s", 0, "p"), (None, "sun", "s", 0, "p"), (905, "sun", "s", 0, "p"),
             (905, "sun", "s", 0, "p")]
    return rows


@pytest.mark.parametrize("op", ["quality", "toxicity"])
def test_odd_input(make, op):
    rows = odd_texts()
    docs = make(rows, SCHEMA)
    labels = [(i, int(bool(k)), int(not k)) for i, _, _, k, _ in rows if i is not None and i < 200]
    labels += [(900, None, None), (1234, 1, 1), (None, 0, 1)]
    labels = make(labels, "doc_id long, quality int, toxic int")
    if op == "quality":
        score = quality.quality_score(F.col("text"), quality.fit_quality(docs, labels))
    else:
        score = toxicity.toxicity_score(F.col("text"), toxicity.fit_toxicity(docs, labels))
    got = docs.select("doc_id", score.alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    by = {r.doc_id: r.s for r in got}
    good, bad = np.mean([by[i] for i in range(200) if i % 4]), np.mean([by[i] for i in range(0, 200, 4)])
    assert good - bad > 0.5 if op == "quality" else bad - good > 0.5
    assert by[900] == by[901] == by[902] if op == "quality" else by[900] == by[901] == by[902]


def test_without_labels_or_rows(make):
    docs, none = make(odd_texts()[:9], SCHEMA), make([], "doc_id long, quality int, toxic int")
    for table in (docs, make([], SCHEMA)):
        q = table.select(quality.quality_score(F.col("text"), quality.fit_quality(table, none)).alias("s")).collect()
        t = table.select(toxicity.toxicity_score(F.col("text"), toxicity.fit_toxicity(table, none)).alias("s")).collect()
        assert {r.s for r in q} <= {1.0} and all(r.s < 0.5 for r in t)


def test_passages_do_not_depend_on_the_batch():
    texts = ["a b c " * 90, "", None, "X! " * 205]
    whole = list(quality.passages(texts))
    assert [int(r) for r in whole[0][1]] == [0, 0, 0, 1, 2, 3, 3, 3]
    for i, t in enumerate(texts):
        alone = np.concatenate([x for x, _ in quality.passages([t])])
        np.testing.assert_allclose(alone, np.concatenate([x[r == i] for x, r in whole]), atol=1e-6)


def test_gradient_of_attention():
    rng = np.random.default_rng(0)
    model = quality.Attention(quality.WIDTH)
    x, starts, y = rng.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3]), np.array([0.0, 1.0, 1.0])

    def loss():
        s = model.forward(x, starts)["s"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = model.gradient(model.forward(x, starts), y, starts)
    for name, p in model.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert (up - down) / 2e-5 == pytest.approx(grad[name][at], abs=1e-6)


def test_risk_needs_no_negatives():
    rng = np.random.default_rng(0)
    x_p = rng.normal(2, 1, (300, 4)).astype(np.float32)
    x_u = np.concatenate((rng.normal(2, 1, (200, 4)), rng.normal(-2, 1, (800, 4)))).astype(np.float32)
    w, b = toxicity.fit_nnpu(x_p, x_u, 0.2)
    assert np.mean(x_p @ w + b > 0) > 0.95 and np.mean(x_u[200:] @ w + b > 0) < 0.05
