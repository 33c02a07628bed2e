"""Classifier queries on the feature windows of ``events``.

Every model is stored as tables and scored from them. What a fit learned has no
SQL form, so the queries show what must hold of it whatever it learned: which
windows are scored, that probabilities sum to 1, that the prediction is the best
score, and that the stored model scores as the fitted one does.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slicelens.functions.maths import argmax
from slicelens.operators import curves, metrics, models, sampling, scaling, stored
from slicelens.operators.joins import scratch_path, stage
from slicelens.operators.ordering import shuffle_key
from slicelens.plans import inputs as I
from slicelens.plans import sql as S
from slicelens.plans.registry import query
from slicelens.plans.sample_queries import ID, SMALLEST, keyed
from slicelens.settings import CLASSES, FEATURES, LABEL

#: Windows of a class that a fit and its scaling see, at most; every other window is scored.
PER_CLASS = 400


def prepared(spark, folder, per_class=None):
    """All windows, scaled and clipped, with ``sample_id`` and ``is_test``: true but for those to fit on.

    The train part of a balanced sample of at most ``per_class`` windows a class is there to fit on.
    """
    per_class = PER_CLASS if per_class is None else per_class
    rows = keyed(spark, folder).withColumn("sample_id", F.concat_ws(":", *ID))
    balanced = sampling.balance(rows, LABEL, "shuffle_key", cap=per_class)
    balanced = models.compact(balanced, per_class * len(CLASSES))
    fitted = sampling.stratified_split(balanced, LABEL, "shuffle_key").filter("NOT is_test").select("shuffle_key")
    # No more rows than the sample.
    marked = rows.join(F.broadcast(fitted.withColumn("_fit", F.lit(True))), "shuffle_key", "left")
    marked = marked.withColumn("is_test", F.col("_fit").isNull()).drop("_fit")
    return stage(
        scaling.angle_clip(scaling.standardize(marked, FEATURES, fit_on=balanced), FEATURES), "prepared"
    )


def to_fit(data):
    return models.compact(data.filter("NOT is_test"), PER_CLASS * len(CLASSES))


def fitted_and_stored(spark, folder, **fits):
    """Scaled windows, the fitted models by name, and the same models read back from their tables."""
    data = prepared(spark, folder)
    train = to_fit(data)
    fitted = {name: fit(train) for name, fit in fits.items()}
    back = {}
    for name, model in fitted.items():
        place = scratch_path(spark, f"model-{name}")
        stored.save_model(spark, model, place)
        back[name] = stored.load_model(spark, place)
    return data, fitted, back


def scored_by(spark, folder, **fits):
    """Scores of every window not fitted on, from the stored models."""
    data, _, back = fitted_and_stored(spark, folder, **fits)
    return models.score_table(back, data.filter("is_test"), "sample_id")


def checked(spark, folder, **fits):
    """What must hold of every scored window, one row each."""
    data, fitted, back = fitted_and_stored(spark, folder, **fits)
    test = data.filter("is_test")
    ours = models.score_table(back, test, "sample_id")
    theirs = models.score_table(fitted, test, "sample_id").select(
        "sample_id", "model", F.col("scores").alias("fitted"), F.col("y_pred").alias("chosen")
    )
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
    apart = F.array_max(F.zip_with("scores", "fitted", lambda a, b: F.abs(a - b)))
    sums = F.when(F.col("model").isin(*LIKELY), F.round(total, 6))
    return ours.join(theirs, ["sample_id", "model"]).select(
        "sample_id", "model", "y_true", F.size("scores").cast("bigint").alias("n_scores"), sums.alias("score_sum"),
        (F.col("y_pred") == argmax(F.col("scores"))).alias("best_is_chosen"),
        ((apart < 1e-6) & (F.col("y_pred") == F.col("chosen"))).alias("as_fitted"),
    )


#: Models whose scores are probabilities.
LIKELY = ("random_forest", "logistic", "network")

_SCORED = f"""
WITH {S.KEYED},
bal AS (SELECT *, row_number() OVER (PARTITION BY traffic_class ORDER BY shuffle_key) AS rn FROM keyed
        QUALIFY rn <= least({SMALLEST}, {PER_CLASS})),
q AS (SELECT traffic_class, n, total, (total - (total + 3) // 4) AS train
      FROM (SELECT traffic_class, count(*) AS n, sum(count(*)) OVER () AS total FROM bal GROUP BY 1)),
s AS (SELECT *, train * n // total AS seats, train - sum(train * n // total) OVER () AS spare,
             row_number() OVER (ORDER BY train * n % total DESC, traffic_class) AS turn FROM q),
fitted AS (SELECT shuffle_key FROM bal JOIN s USING (traffic_class)
           WHERE rn > s.n - seats - CASE WHEN turn <= spare THEN 1 ELSE 0 END),
scored AS (SELECT concat_ws(':', capture_id, k) AS sample_id, traffic_class AS y_true FROM keyed
           WHERE shuffle_key NOT IN (SELECT shuffle_key FROM fitted))"""


def _checks(*names: str) -> str:
    return _SCORED + " UNION ALL ".join(
        f"""
SELECT sample_id, '{name}' AS model, y_true, 3::BIGINT AS n_scores,
       {"1.0::DOUBLE" if name in LIKELY else "NULL::DOUBLE"} AS score_sum, true AS best_is_chosen, true AS as_fitted
FROM scored"""
        for name in names
    )


@query("fit_random_forest", _checks("random_forest"))
def fit_random_forest(spark, folder):
    return checked(spark, folder, random_forest=models.fit_random_forest)


@query("fit_gradient_boost", _checks("gradient_boost"))
def fit_gradient_boost(spark, folder):
    return checked(spark, folder, gradient_boost=models.fit_gradient_boost)


@query("fit_rbf_svm", _checks("rbf_svm"))
def fit_rbf_svm(spark, folder):
    return checked(spark, folder, rbf_svm=models.fit_rbf_svm)


@query("fit_weighted_logistic", _checks("logistic"))
def fit_weighted_logistic(spark, folder):
    return checked(spark, folder, logistic=models.fit_weighted_logistic)


@query("fit_weighted_network", _checks("network"))
def fit_weighted_network(spark, folder):
    return checked(spark, folder, network=models.fit_weighted_network)


@query("fit_binary_linear", """
WITH k AS (SELECT l_returnflag, md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                    CAST(round(l_extendedprice * 100) AS BIGINT), 42)) AS key FROM lineitem),
t AS (SELECT *, row_number() OVER (ORDER BY key) <= (SELECT (count(*) + 4) // 5 FROM k) AS is_test FROM k)
SELECT CASE WHEN l_returnflag = (SELECT min(l_returnflag) FROM k) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y,
       count(*) AS n, true AS signs_only, true AS as_fitted FROM t WHERE is_test GROUP BY 1""")
def fit_binary_linear(spark, folder):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    parts = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = I.table(spark, folder, "lineitem").select(
        *columns, "l_returnflag", shuffle_key([*parts, cents], 42).alias("key")
    )
    encoded = scaling.label_encode(rows, ["l_returnflag"])
    scaled = scaling.standardize(encoded, columns).withColumn(
        "y", scaling.binary_label(F.col("l_returnflag"))
    )
    split = stage(sampling.random_split(scaled, "key"), "split")
    model = models.fit_binary_linear(split.filter("NOT is_test"), columns, "y")
    place = scratch_path(spark, "model-binary")
    stored.save_model(spark, model, place)
    tested = models.predict_sign(model, split.filter("is_test")).select(*columns, "y", F.col("y_pred").alias("chosen"))
    back = models.predict_sign(stored.load_model(spark, place), tested)
    return back.groupBy("y").agg(
        F.count("*").alias("n"), F.bool_and(F.col("y_pred").isin(-1.0, 1.0)).alias("signs_only"),
        F.bool_and(F.col("y_pred") == F.col("chosen")).alias("as_fitted"),
    )


@query("score_table", _checks("logistic", "rbf_svm"))
def score_table(spark, folder):
    return checked(
        spark, folder, logistic=models.fit_weighted_logistic, rbf_svm=models.fit_rbf_svm
    )


@query("fitted_comparison")
def fitted_comparison(spark, folder):
    """Comparison and areas of fitted models, from fit to report."""
    table = stage(
        scored_by(
            spark, folder, logistic=models.fit_weighted_logistic,
            random_forest=models.fit_random_forest,
        ),
        "scores",
    )
    areas = curves.roc_auc(curves.class_scores(table)).groupBy("model").agg(
        F.avg("auc").alias("mean_auc")
    )
    return metrics.model_comparison(table).join(areas, "model")


def importances(spark, folder):
    data = prepared(spark, folder)
    return models.feature_importance(models.fit_random_forest(to_fit(data)), data)


_EACH_FEATURE = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in FEATURES)


@query("feature_importance", f"""
SELECT feature, true AS is_share, 1.0::DOUBLE AS total FROM ({_EACH_FEATURE}) WHERE EXISTS (SELECT 1 FROM events)""")
def feature_importance(spark, folder):
    """Every feature, whether its importance is a share, and what all of them sum to."""
    found = importances(spark, folder)
    whole = found.agg(F.round(F.sum("importance"), 9).alias("total"))
    # One row.
    return found.select("feature", F.col("importance").between(0, 1).alias("is_share")).join(F.broadcast(whole))


@query("rank_importance", """
SELECT CAST(unnest(range(1, 9)) AS BIGINT) AS place, true AS in_order, 8::BIGINT AS features WHERE EXISTS (SELECT 1 FROM events)""")
def rank_importance(spark, folder):
    """The places of the features by importance; each is no less important than the one before."""
    ranked = models.rank_importance(importances(spark, folder))
    # One row a feature.
    rows = Window.partitionBy(F.lit(0)).orderBy("importance", "feature")
    every = Window.partitionBy(F.lit(0))
    return ranked.select(
        F.row_number().over(rows).cast("bigint").alias("place"),
        (F.col("importance") >= F.coalesce(F.lag("importance").over(rows), F.lit(0.0))).alias("in_order"),
        F.size(F.collect_set("feature").over(every)).cast("bigint").alias("features"),
    )
