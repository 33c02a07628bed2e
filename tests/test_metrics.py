import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelens.operators import curves, history, metrics

# A recorded evaluation and a recorded 40-epoch run.
CONFUSION = ((91, 6, 3), (3, 84, 13), (5, 33, 62))
VALIDATION = (
    40.67, 58.33, 56.67, 59.67, 67.67, 81.00, 67.33, 69.67, 70.00, 69.67,
    75.67, 67.33, 67.33, 81.33, 77.00, 77.67, 70.67, 77.00, 73.00, 79.00,
    75.00, 77.33, 73.67, 77.00, 74.33, 76.67, 73.00, 78.33, 77.67, 78.00,
    77.33, 78.67, 78.00, 77.33, 78.67, 78.33, 79.00, 78.67, 78.33, 79.00,
)
# End of fixed values.


@pytest.fixture(scope="module")
def recorded(spark):
    rows = [("m", t, p) for t in range(3) for p in range(3) for _ in range(CONFUSION[t][p])]
    return spark.createDataFrame(rows, "model string, y_true bigint, y_pred bigint")


def test_recorded_report(recorded):
    report = {r["entry"]: r for r in metrics.classification_report(metrics.confusion_matrix(recorded)).collect()}
    shown = {e: tuple(None if r[c] is None else round(r[c], 4) for c in ("precision", "recall", "f1"))
             for e, r in report.items()}
    assert shown == {
        "0": (0.9192, 0.91, 0.9146), "1": (0.6829, 0.84, 0.7534), "2": (0.7949, 0.62, 0.6966),
        "accuracy": (None, None, 0.79), "macro avg": (0.799, 0.79, 0.7882),
        "weighted avg": (0.799, 0.79, 0.7882),
    }
    assert report["0"]["support"] == 100 and report["macro avg"]["support"] == 300
    row = metrics.model_comparison(recorded).first()
    assert [round(row[c], 2) for c in ("accuracy", "precision", "recall", "f1")] == [79.0, 79.9, 79.0, 78.82]


def test_empty_cells_and_undefined_scores(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 2, 0)], "model string, y_true bigint, y_pred bigint")
    cells = metrics.confusion_matrix(df)
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 2
    scores = {r["cls"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.per_class_prf(cells).collect()}
    assert scores == {0: (0.5, 1.0, pytest.approx(2 / 3)), 1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0)}
    pct = {(r["y_true"], r["y_pred"]): r["pct"] for r in metrics.confusion_pct(cells).collect()}
    assert pct[0, 0] == 100.0 and pct[1, 0] is None


def test_recorded_history(spark):
    rows = [("r", i + 1, v, 1010.0) for i, v in enumerate(VALIDATION)]
    df = spark.createDataFrame(rows, "run string, epoch bigint, val_acc double, epoch_sec double")
    marked = history.running_best(df).filter("is_best").orderBy("epoch").collect()
    assert [r["epoch"] for r in marked] == [1, 2, 4, 5, 6, 14]
    assert history.best_epoch(df).first()["best_epoch"] == 14
    rates = {r["epoch"]: r["lr"] for r in history.learning_rates(df, 40).collect()}
    assert round(rates[1], 6) == 0.003994 and round(rates[20], 6) == 0.00205 and rates[40] == pytest.approx(1e-4)
    eta = {r["epoch"]: r["eta"] for r in history.running_eta(df, 40).collect()}
    assert eta[1] == "10h56m30s" and eta[40] == "00m00s"


def scored(spark, n, scores, seed=1, parts=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randrange(3)
        rows.append(("m", y, [scores(rng) + 0.4 * (y == c) for c in range(3)]))
    df = spark.createDataFrame(rows, "model string, y_true bigint, scores array<double>")
    return rows, curves.class_scores(df.repartition(parts))


def plain_curve(rows, cls):
    pairs = sorted(((r[2][cls], r[1] == cls) for r in rows), reverse=True)
    thresholds, tps, fps, tp, fp = [], [], [], 0, 0
    for i, (s, pos) in enumerate(pairs):
        tp, fp = tp + pos, fp + (not pos)
        if i + 1 == len(pairs) or pairs[i + 1][0] != s:
            thresholds.append(s), tps.append(tp), fps.append(fp)
    return np.array(tps), np.array(fps)


SCORES = {"continuous": lambda r: r.random(), "ties": lambda r: round(r.random(), 1),
          "squeezed": lambda r: 0.5 + r.random() * 1e-9}


@pytest.mark.parametrize("kind", SCORES)
def test_curve_points_and_areas(spark, kind):
    rows, df = scored(spark, 300, SCORES[kind])
    full = curves.roc_curve(df, drop_collinear=False)
    kept = curves.roc_curve(df)
    areas = {r["cls"]: r["auc"] for r in curves.roc_auc(df).collect()}
    macro = {}
    for c in range(3):
        tps, fps = plain_curve(rows, c)
        points = full.filter(F.col("cls") == c).orderBy("tp", "fp").collect()
        assert [(r["tp"], r["fp"]) for r in points] == [(0, 0), *zip(tps, fps)]
        keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True] if len(tps) > 2 else np.ones(len(tps), bool)
        drawn = kept.filter(F.col("cls") == c).orderBy("tp", "fp").collect()
        assert [(r["tp"], r["fp"]) for r in drawn] == [(0, 0), *zip(tps[keep], fps[keep])]
        positive = [r[2][c] for r in rows if r[1] == c]
        negative = [r[2][c] for r in rows if r[1] != c]
        wins = sum((p > q) + (p == q) / 2 for p in positive for q in negative)
        assert areas[c] == pytest.approx(wins / len(positive) / len(negative), rel=1e-9)
        macro[c] = (np.r_[0, fps[keep]] / fps[-1], np.r_[0, tps[keep]] / tps[-1])
    grid = np.unique(np.concatenate([x for x, _ in macro.values()]))
    mean = sum(np.interp(grid, *macro[c]) for c in macro) / 3
    curve = curves.macro_roc_curve(kept, (0, 1, 2)).orderBy("fpr").collect()
    assert [r["fpr"] for r in curve] == pytest.approx(list(grid))
    assert [r["tpr"] for r in curve] == pytest.approx(list(mean))
    area = float(np.sum(np.diff(grid) * (mean[1:] + mean[:-1]) / 2))
    assert curves.macro_roc_auc(kept, (0, 1, 2)).first()["macro_auc"] == pytest.approx(area)


@pytest.mark.parametrize("buckets", [1, 4, 1000])
def test_interpolation_matches_numpy(spark, buckets):
    rng = random.Random(2)
    xs = sorted(rng.choice([0.1, 0.3, 0.5, rng.random()]) for _ in range(40))
    ys = sorted(rng.random() for _ in xs)
    grid = [rng.random() * 1.4 - 0.2 for _ in range(200)] + xs
    knots = spark.createDataFrame([("k", x, y) for x, y in zip(xs, ys)], "g string, x double, y double")
    asked = spark.createDataFrame([("k", x) for x in set(grid)], "g string, x double")
    found = curves.interpolate(knots, asked, ["g"], F.floor(F.col("x") * buckets)).collect()
    assert len(found) == len(set(grid))
    for r in found:
        assert r["y"] == pytest.approx(float(np.interp(r["x"], xs, ys)), abs=1e-12)


def test_log_loss(spark):
    df = spark.createDataFrame(
        [("m", 0, [0.7, 0.2, 0.1]), ("m", 1, [0.3, 0.4, 0.3])], "model string, y_true bigint, p array<double>"
    )
    weighted = (-math.log(0.7) - 2.5 * math.log(0.4)) / 3.5
    assert metrics.weighted_log_loss(df).first()["log_loss"] == pytest.approx(weighted)
    plain = (-math.log(0.7) - math.log(0.4)) / 2
    assert metrics.weighted_log_loss(df, weighted=False).first()["log_loss"] == pytest.approx(plain)
