import pytest
from pyspark.sql import functions as F

from slicelens.operators import curves, metrics, models, scaling, stored
from slicelens.plans import model_queries
from slicelens.plans.sample_queries import keyed
from slicelens.settings import FEATURES, LABEL
from slicelens.sources.synthetic import synthetic_rows


@pytest.fixture(scope="module")
def data(spark):
    rows = synthetic_rows(spark.range(360), F.pmod("id", F.lit(3)).cast("bigint"))
    rows = scaling.angle_clip(scaling.standardize(rows, FEATURES), FEATURES)
    return models.compact(rows, 360)


FITS = {
    "forest": lambda d: models.fit_random_forest(d, trees=20, depth=6),
    "boost": lambda d: models.fit_gradient_boost(d, rounds=3),
    "kernel": lambda d: models.fit_rbf_svm(d, size=64, rounds=20),
    "logistic": models.fit_weighted_logistic,
    "network": lambda d: models.fit_weighted_network(d, hidden=(8,), rounds=40),
}


@pytest.fixture(scope="module")
def fitted(data):
    train = data.filter("id % 4 > 0")
    return {name: fit(train) for name, fit in FITS.items()}


@pytest.fixture(scope="module")
def table(data, fitted):
    return models.score_table(fitted, data.filter("id % 4 = 0"), "id").cache()


@pytest.mark.parametrize("name", list(FITS))
def test_stored_model_scores_as_the_fitted_one(spark, data, fitted, table, tmp_path, name):
    stored.save_model(spark, fitted[name], str(tmp_path / name))
    back = stored.load_model(spark, str(tmp_path / name))
    ours = models.score_table({name: back}, data.filter("id % 4 = 0"), "id")
    want = {r.sample_id: r for r in table.filter(F.col("model") == name).collect()}
    got = {r.sample_id: r for r in ours.collect()}
    assert got.keys() == want.keys() and len(got) == 90
    for key, row in want.items():
        assert got[key].scores == pytest.approx(row.scores, rel=1e-9, abs=1e-9)
        assert (got[key].y_pred, got[key].y_true) == (row.y_pred, row.y_true)


def test_stored_binary_model(spark, data, tmp_path):
    two = data.withColumn("y", scaling.binary_label(F.col(LABEL)))
    model = models.fit_binary_linear(two, FEATURES[:4], "y")
    stored.save_model(spark, model, str(tmp_path / "m"))
    back = stored.load_model(spark, str(tmp_path / "m"))
    assert back.kind == "binary" and back.columns == list(FEATURES[:4])
    pairs = models.predict_sign(back, models.predict_sign(model, two).select(*FEATURES, "y", F.col("y_pred").alias("f")))
    assert pairs.filter("y_pred <> f").count() == 0 and pairs.count() == 360


def test_a_model_is_replaced_as_a_whole(spark, fitted, tmp_path):
    place = str(tmp_path / "m")
    stored.save_model(spark, fitted["forest"], place)
    stored.save_model(spark, fitted["logistic"], place)
    assert stored.load_model(spark, place).kind == "logistic"
    with pytest.raises(TypeError):
        stored.save_model(spark, object(), place)
    assert stored.load_model(spark, place).kind == "logistic"


def test_scores_are_finite_and_complete(table):
    assert table.count() == 5 * 90
    assert table.filter("size(scores) <> 3 OR exists(scores, s -> s IS NULL OR isnan(s))").count() == 0
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
    likely = table.filter(F.col("model").isin("forest", "logistic", "network"))
    assert likely.filter(F.abs(total - 1) > 1e-6).count() == 0


def test_models_learn_separable_classes(table):
    for row in metrics.model_comparison(table).collect():
        assert row["accuracy"] > 90, row
    for row in curves.roc_auc(curves.class_scores(table)).collect():
        assert row["auc"] > 0.95, row


def test_importances(data):
    model = FITS["forest"](data)
    ranked = models.rank_importance(models.feature_importance(model, data)).collect()
    values = [r["importance"] for r in ranked]
    assert len(ranked) == 8 and values == sorted(values) and sum(values) == pytest.approx(1)


def test_binary(data):
    two = data.withColumn("y", scaling.binary_label(F.col(LABEL)))
    model = models.fit_binary_linear(two, FEATURES[:4], "y")
    found = models.predict_sign(model, two)
    assert {r[0] for r in found.select("y_pred").distinct().collect()} <= {-1.0, 1.0}
    assert found.filter("y = y_pred").count() / found.count() > 0.9


def test_every_window_not_fitted_on_is_scored(spark, folder, monkeypatch):
    monkeypatch.setattr(model_queries, "PER_CLASS", 32)
    ids = {f"{r.capture_id}:{r.k}" for r in keyed(spark, folder).collect()}
    fitted = {r.sample_id for r in model_queries.prepared(spark, folder).filter("NOT is_test").collect()}
    rows = model_queries.scored_by(spark, folder, logistic=models.fit_weighted_logistic).collect()
    scored = [r.sample_id for r in rows]
    assert len(fitted) == 3 * 24 and len(scored) == len(set(scored))
    assert set(scored) == ids - fitted
