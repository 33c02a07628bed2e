"""Evaluation queries over predictions and history derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelens.functions.maths import argmax, epoch_micros, softmax
from slicelens.operators import curves, history, metrics
from slicelens.operators.joins import stage
from slicelens.operators.scaling import binary_label
from slicelens.plans import inputs as I
from slicelens.plans.registry import query, rounded
from slicelens.settings import CLASSES, FLOOR_RATE, LEARNING_RATE

MODELS = (0, 1, 2, 3)

PRED = """
pred AS (
  SELECT event_id AS sample_id, concat('model_', m) AS model, user_id % 3 AS y_true,
         CASE WHEN (event_id + m) % 10 < 7 THEN user_id % 3 ELSE (event_id + m) % 3 END AS y_pred,
         value * (1 + m) + CASE WHEN user_id % 3 = 0 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS s0,
         value * (1 + m) + CASE WHEN user_id % 3 = 1 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS s1,
         value * (1 + m) + CASE WHEN user_id % 3 = 2 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS s2
  FROM events, (SELECT unnest([0, 1, 2, 3]) AS m)
)"""

CELLS = PRED + """,
grid AS (SELECT concat('model_', m) AS model, t AS y_true, p AS y_pred
         FROM (SELECT unnest([0, 1, 2, 3]) AS m), (SELECT unnest([0, 1, 2]) AS t), (SELECT unnest([0, 1, 2]) AS p)),
cells AS (SELECT grid.model, CAST(grid.y_true AS BIGINT) AS y_true, CAST(grid.y_pred AS BIGINT) AS y_pred,
                 count(pred.sample_id) AS n
          FROM grid LEFT JOIN pred ON grid.model = pred.model AND grid.y_true = pred.y_true
               AND grid.y_pred = pred.y_pred GROUP BY 1, 2, 3)"""

PRF = CELLS + """,
tp AS (SELECT model, y_true AS cls, n AS tp FROM cells WHERE y_true = y_pred),
sup AS (SELECT model, y_true AS cls, CAST(sum(n) AS BIGINT) AS support FROM cells GROUP BY 1, 2),
prd AS (SELECT model, y_pred AS cls, CAST(sum(n) AS BIGINT) AS predicted FROM cells GROUP BY 1, 2),
prf AS (SELECT model, cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS "precision",
               CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
               CASE WHEN predicted + support > 0 THEN 2.0::DOUBLE * tp / (predicted + support) ELSE 0 END AS f1,
               support
        FROM tp JOIN sup USING (model, cls) JOIN prd USING (model, cls))"""

LONG = PRED + """,
long AS (SELECT model, 0 AS cls, s0 AS score, y_true = 0 AS pos FROM pred
         UNION ALL SELECT model, 1, s1, y_true = 1 FROM pred
         UNION ALL SELECT model, 2, s2, y_true = 2 FROM pred),
steps AS (SELECT model, CAST(cls AS BIGINT) AS cls, score, count(*) FILTER (WHERE pos) AS p,
                 count(*) FILTER (WHERE NOT pos) AS n FROM long GROUP BY 1, 2, 3),
cum AS (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
               lead(p) OVER (PARTITION BY model, cls ORDER BY score DESC) AS next_p,
               lead(n) OVER (PARTITION BY model, cls ORDER BY score DESC) AS next_n,
               row_number() OVER (PARTITION BY model, cls ORDER BY score DESC) AS rn,
               sum(p) OVER (PARTITION BY model, cls) AS all_p, sum(n) OVER (PARTITION BY model, cls) AS all_n
        FROM steps WINDOW w AS (PARTITION BY model, cls ORDER BY score DESC)),
pts AS (SELECT model, cls, score, tp, fp, fp / all_n AS fpr, tp / all_p AS tpr FROM cum
        WHERE rn = 1 OR next_p IS NULL OR next_p <> p OR next_n <> n
        UNION ALL SELECT DISTINCT model, cls, CAST(NULL AS DOUBLE), 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM steps)"""

MACRO = LONG + """,
knots AS (SELECT model, cls, fpr AS x, min(tpr) AS lo, max(tpr) AS hi FROM pts GROUP BY 1, 2, 3),
grid AS (SELECT model, x, CAST(cls AS BIGINT) AS cls FROM (SELECT DISTINCT model, x FROM knots), (SELECT unnest([0, 1, 2]) AS cls)),
j AS (SELECT g.model, g.cls, g.x, k.x AS kx, k.lo, k.hi FROM grid g LEFT JOIN knots k USING (model, cls, x)),
f AS (SELECT *, last_value(kx IGNORE NULLS) OVER b AS x0, last_value(hi IGNORE NULLS) OVER b AS y0,
             first_value(kx IGNORE NULLS) OVER a AS x1, first_value(lo IGNORE NULLS) OVER a AS y1 FROM j
      WINDOW b AS (PARTITION BY model, cls ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY model, cls ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
itp AS (SELECT model, cls, x, CASE WHEN hi IS NOT NULL THEN hi
                                   ELSE (y1 - y0) / (x1 - x0) * (x - x0) + y0 END AS y FROM f),
mean AS (SELECT model, x AS fpr, avg(y) AS tpr FROM itp GROUP BY 1, 2)"""


def predictions(spark, folder) -> DataFrame:
    """Four models' predictions and class scores for every event."""
    truth = F.pmod("user_id", F.lit(3)).cast("bigint")
    moved = F.col("event_id") + F.col("m")
    guess = F.when(F.pmod(moved, F.lit(10)) < 7, F.col("y_true")).otherwise(F.pmod(moved, F.lit(3)))
    score = [
        F.col("value") * (1 + F.col("m")) + F.when(F.col("y_true") == c, 20.0).otherwise(0.0)
        for c in CLASSES
    ]
    return (
        I.table(spark, folder, "events")
        .select("event_id", "value", truth.alias("y_true"))
        .withColumn("m", F.explode(F.array(*[F.lit(m) for m in MODELS])))
        .select(
            F.col("event_id").alias("sample_id"),
            F.concat(F.lit("model_"), F.col("m").cast("string")).alias("model"),
            "y_true",
            guess.cast("bigint").alias("y_pred"),
            F.array(*score).alias("scores"),
        )
    )


def cells(spark, folder):
    return metrics.confusion_matrix(predictions(spark, folder))


def scored(spark, folder):
    return curves.class_scores(predictions(spark, folder))


@query("join_truth_prediction", f"""
WITH {PRED} SELECT model, count(*) AS samples, CAST(sum(CAST(y_true = y_pred AS INT)) AS BIGINT) AS correct
FROM pred GROUP BY 1""")
def join_truth_prediction(spark, folder):
    every = predictions(spark, folder)
    truth = I.table(spark, folder, "events").select(
        F.col("event_id").alias("sample_id"), F.pmod("user_id", F.lit(3)).alias("y_true")
    )
    paired = metrics.join_predictions(truth, every.select("sample_id", "model", "y_pred"))
    return paired.groupBy("model").agg(
        F.count("*").alias("samples"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("correct")
    )


@query("join_class_weight", """
SELECT user_id % 3 AS y_true, count(*) AS samples,
       sum(CASE WHEN user_id % 3 = 1 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM events GROUP BY 1""")
def join_class_weight(spark, folder):
    truth = I.table(spark, folder, "events").select(
        F.pmod("user_id", F.lit(3)).cast("bigint").alias("y_true")
    )
    weighted = truth.join(F.broadcast(metrics.class_weights(spark)), "y_true")
    return weighted.groupBy("y_true").agg(
        F.count("*").alias("samples"), F.sum("weight").alias("weight")
    )


@query("confusion_matrix", f"WITH {CELLS} SELECT * FROM cells")
def confusion_matrix(spark, folder):
    return cells(spark, folder)


@query("confusion_pct", f"""
WITH {CELLS} SELECT model, y_true, y_pred, round(100.0 * n / sum(n) OVER (PARTITION BY model, y_true), 6) AS pct FROM cells""")
def confusion_pct(spark, folder):
    return rounded(metrics.confusion_pct(cells(spark, folder)), pct=6)


@query("accuracy", f"WITH {PRED} SELECT model, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS accuracy FROM pred GROUP BY 1")
def accuracy(spark, folder):
    return rounded(metrics.accuracy(predictions(spark, folder)), accuracy=6)


@query("per_class_prf", f"""
WITH {PRF} SELECT model, cls, round("precision", 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf""")
def per_class_prf(spark, folder):
    return rounded(metrics.per_class_prf(cells(spark, folder)), precision=6, recall=6, f1=6)


@query("macro_prf", f"""
WITH {PRF} SELECT model, round(avg("precision"), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1
FROM prf GROUP BY 1""")
def macro_prf(spark, folder):
    table = metrics.macro_prf(metrics.per_class_prf(cells(spark, folder)))
    return rounded(table, precision=6, recall=6, f1=6)


@query("classification_report", f"""
WITH {PRF},
acc AS (SELECT model, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n) AS a, sum(n) AS n FROM cells GROUP BY 1),
rep AS (
  SELECT model, CAST(cls AS VARCHAR) AS entry, "precision", recall, f1, support FROM prf
  UNION ALL SELECT model, 'accuracy', NULL, NULL, a, n FROM acc
  UNION ALL SELECT model, 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support) FROM prf GROUP BY 1
  UNION ALL SELECT model, 'weighted avg', sum("precision" * support) / sum(support),
                   sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM prf GROUP BY 1)
SELECT model, entry, round("precision", 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rep""")
def classification_report(spark, folder):
    return rounded(metrics.classification_report(cells(spark, folder)), precision=6, recall=6, f1=6)


@query("model_comparison", f"""
WITH {PRF}, acc AS (SELECT model, avg(CAST(y_true = y_pred AS DOUBLE)) * 100 AS a FROM pred GROUP BY 1)
SELECT model, round(any_value(a), 4) AS accuracy, round(avg("precision") * 100, 4) AS precision,
       round(avg(recall) * 100, 4) AS recall, round(avg(f1) * 100, 4) AS f1 FROM prf JOIN acc USING (model) GROUP BY 1""")
def model_comparison(spark, folder):
    table = metrics.model_comparison(predictions(spark, folder))
    return rounded(table, accuracy=4, precision=4, recall=4, f1=4)


_PROBABILITIES = PRED + """,
e AS (SELECT *, exp((s0 - greatest(s0, s1, s2)) / 10) AS e0, exp((s1 - greatest(s0, s1, s2)) / 10) AS e1,
             exp((s2 - greatest(s0, s1, s2)) / 10) AS e2 FROM pred),
q AS (SELECT *, CASE y_true WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END / (e0 + e1 + e2) AS p,
             CASE WHEN y_true = 1 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM e)"""


def probabilities(spark, folder):
    scaled = F.transform("scores", lambda s: s / 10)
    return predictions(spark, folder).withColumn("p", softmax(scaled))


@query("weighted_log_loss", f"WITH {_PROBABILITIES} SELECT model, round(sum(-w * ln(p)) / sum(w), 6) AS log_loss FROM q GROUP BY 1")
def weighted_log_loss(spark, folder):
    return rounded(metrics.weighted_log_loss(probabilities(spark, folder)), log_loss=6)


@query("log_loss", f"WITH {_PROBABILITIES} SELECT model, round(avg(-ln(p)), 6) AS log_loss FROM q GROUP BY 1")
def log_loss(spark, folder):
    return rounded(metrics.weighted_log_loss(probabilities(spark, folder), weighted=False), log_loss=6)


@query("squared_loss", """
SELECT event_type, round(avg(power(value / 100 - CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END, 2)), 6) AS squared_loss
FROM events GROUP BY 1""")
def squared_loss(spark, folder):
    rows = I.table(spark, folder, "events").select(
        "event_type", (F.col("value") / 100).alias("score"),
        binary_label(F.pmod("user_id", F.lit(2))).alias("y"),
    )
    return rounded(metrics.squared_loss(rows, "score", "y", ["event_type"]), squared_loss=6)


@query("roc_curve", f"""
WITH {LONG} SELECT model, cls, score, tp, fp, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM pts""")
def roc_curve(spark, folder):
    return rounded(curves.roc_curve(scored(spark, folder)), fpr=9, tpr=9)


@query("roc_curve_all_points", f"""
WITH {LONG} SELECT model, cls, score, tp, fp FROM cum
UNION ALL SELECT DISTINCT model, cls, CAST(NULL AS DOUBLE), 0::BIGINT, 0::BIGINT FROM steps""")
def roc_curve_all_points(spark, folder):
    every = curves.roc_curve(scored(spark, folder), drop_collinear=False)
    return every.select("model", "cls", "score", "tp", "fp")


@query("roc_ties", """
WITH steps AS (SELECT round(value, 0) AS score, count(*) FILTER (WHERE event_type = 'purchase') AS p,
                      count(*) FILTER (WHERE event_type <> 'purchase') AS n FROM events GROUP BY 1),
cum AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp FROM steps)
SELECT 'value' AS model, 0::BIGINT AS cls, round(CAST(sum(n * (tp - p / 2.0)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc FROM cum""")
def roc_ties(spark, folder):
    rows = I.table(spark, folder, "events").select(
        F.lit("value").alias("model"), F.lit(0).cast("bigint").alias("cls"),
        F.round("value", 0).alias("score"), (F.col("event_type") == "purchase").alias("is_class"),
    )
    return rounded(curves.roc_auc(rows), auc=6)


@query("roc_auc", f"""
WITH {LONG}, t AS (SELECT model, cls, fpr, tpr, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM pts
                   WINDOW w AS (PARTITION BY model, cls ORDER BY fpr, tpr))
SELECT model, cls, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM t GROUP BY 1, 2""")
def roc_auc(spark, folder):
    return rounded(curves.roc_auc(scored(spark, folder)), auc=6)


@query("interp_asof", f"WITH {MACRO} SELECT model, cls, round(x, 9) AS x, round(y, 6) AS y FROM itp")
def interp_asof(spark, folder):
    points = staged_points(spark, folder)
    every = F.array(*[F.lit(c).cast("bigint") for c in CLASSES])
    grid = curves.fpr_grid(points).withColumn("cls", F.explode(every))
    knots = points.select("model", "cls", F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    found = curves.interpolate(knots, grid, ["model", "cls"], curves.rate_bucket(points, "x"))
    return rounded(found, x=9, y=6)


def staged_points(spark, folder):
    return stage(curves.roc_curve(scored(spark, folder)), "points")


@query("distinct_union", f"WITH {LONG} SELECT model, round(x, 12) AS fpr FROM (SELECT DISTINCT model, fpr AS x FROM pts)")
def distinct_union(spark, folder):
    grid = curves.fpr_grid(curves.roc_curve(scored(spark, folder)))
    return rounded(grid.withColumnRenamed("x", "fpr"), fpr=12)


@query("macro_roc_curve", f"WITH {MACRO} SELECT model, round(fpr, 9) AS fpr, round(tpr, 6) AS tpr FROM mean")
def macro_roc_curve(spark, folder):
    return rounded(curves.macro_roc_curve(staged_points(spark, folder), CLASSES), fpr=9, tpr=6)


@query("macro_roc_auc", f"""
WITH {MACRO}, t AS (SELECT model, fpr - lag(fpr) OVER w AS width, (tpr + lag(tpr) OVER w) / 2 AS height FROM mean
                    WINDOW w AS (PARTITION BY model ORDER BY fpr))
SELECT model, round(sum(width * height), 6) AS macro_auc FROM t GROUP BY 1""")
def macro_roc_auc(spark, folder):
    return rounded(curves.macro_roc_auc(staged_points(spark, folder), CLASSES), macro_auc=6)


@query("argmax_class", """
SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS cls FROM embeddings""")
def argmax_class(spark, folder):
    rows = I.table(spark, folder, "embeddings")
    return rows.select("vec_id", argmax(F.col("embedding")).cast("bigint").alias("cls"))


@query("softmax", """
WITH x AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS entry, exp(unnest(embedding)::DOUBLE) AS e FROM embeddings)
SELECT vec_id, entry::BIGINT AS entry, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM x""")
def softmax_rows(spark, folder):
    scores = F.transform("embedding", lambda v: v.cast("double"))
    rows = I.table(spark, folder, "embeddings").select("vec_id", F.posexplode(softmax(scores)).alias("entry", "p"))
    return rounded(rows.withColumn("entry", F.col("entry").cast("bigint")), p=6)


@query("sign_predict", """
SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS entry, sign(unnest(embedding)::DOUBLE)::DOUBLE AS sign
FROM embeddings""")
def sign_predict(spark, folder):
    rows = I.table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("entry", "v"))
    return rows.select(
        "vec_id", F.col("entry").cast("bigint").alias("entry"), F.signum(F.col("v").cast("double")).alias("sign")
    )


HISTORY = """
d AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS epoch, user_id, value, ts FROM events),
hist AS (SELECT run, epoch, round(avg(value), 2) AS val_acc, CAST(count(*) AS DOUBLE) AS epoch_sec FROM d GROUP BY 1, 2)"""


def daily(spark, folder) -> DataFrame:
    events = I.table(spark, folder, "events")
    start = 1_704_067_200_000_000  # 2024-01-01
    day = F.floor((epoch_micros(events, "ts") - start) / I.DAY_US) + 1
    return events.select(F.col("event_type").alias("run"), day.alias("epoch"), "user_id", "value")


def epoch_history(spark, folder) -> DataFrame:
    """Daily aggregates of each event type as the epochs of a training run."""
    return (
        daily(spark, folder)
        .groupBy("run", "epoch")
        .agg(
            F.round(F.avg("value"), 2).alias("val_acc"),
            F.count("*").cast("double").alias("epoch_sec"),
        )
    )


@query("running_best", f"""
WITH {HISTORY} SELECT run, epoch, val_acc, val_acc = max(val_acc) OVER (PARTITION BY run ORDER BY epoch) AS is_best FROM hist""")
def running_best(spark, folder):
    return history.running_best(epoch_history(spark, folder).drop("epoch_sec"))


@query("running_eta", f"""
WITH {HISTORY}, x AS (SELECT run, epoch, avg(epoch_sec) OVER (PARTITION BY run ORDER BY epoch) * (30 - epoch) AS eta_sec FROM hist)
SELECT run, epoch, round(eta_sec, 6) AS eta_sec,
       CASE WHEN floor(eta_sec) >= 3600
            THEN printf('%dh%02dm%02ds', CAST(floor(eta_sec) AS BIGINT) // 3600, CAST(floor(eta_sec) AS BIGINT) % 3600 // 60, CAST(floor(eta_sec) AS BIGINT) % 60)
            ELSE printf('%02dm%02ds', CAST(floor(eta_sec) AS BIGINT) // 60, CAST(floor(eta_sec) AS BIGINT) % 60) END AS eta
FROM x""")
def running_eta(spark, folder):
    eta = history.running_eta(epoch_history(spark, folder), epochs=30)
    return rounded(eta.select("run", "epoch", "eta_sec", "eta"), eta_sec=6)


@query("best_epoch", f"""
WITH {HISTORY} SELECT run, epoch AS best_epoch, val_acc FROM hist
QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_acc DESC, epoch) = 1""")
def best_epoch(spark, folder):
    return history.best_epoch(epoch_history(spark, folder))


@query("epoch_mean_loss", f"""
WITH {HISTORY}, b AS (SELECT run, epoch, user_id % 7 AS batch, avg(value) AS loss, count(*) AS n,
                             count(*) FILTER (WHERE value > 50) AS correct FROM d GROUP BY 1, 2, 3)
SELECT run, epoch, round(sum(loss * n) / sum(n), 6) AS train_loss, round(sum(correct) / sum(n), 6) AS train_acc
FROM b GROUP BY 1, 2""")
def epoch_mean_loss(spark, folder):
    batches = daily(spark, folder).groupBy(
        "run", "epoch", F.pmod("user_id", F.lit(7)).alias("batch")
    ).agg(
        F.avg("value").alias("loss"), F.count("*").alias("n"),
        F.count_if(F.col("value") > 50).alias("correct"),
    )
    return rounded(history.epoch_mean_loss(batches), train_loss=6, train_acc=6)


@query("cosine_lr", f"""
WITH {HISTORY}, t AS (SELECT run, max(epoch) AS epochs FROM hist GROUP BY 1)
SELECT run, epoch, round({FLOOR_RATE} + ({LEARNING_RATE} - {FLOOR_RATE}) * (1 + cos(pi() * epoch / epochs)) / 2, 9) AS lr
FROM hist JOIN t USING (run)""")
def cosine_lr(spark, folder):
    hist = epoch_history(spark, folder).select("run", "epoch")
    last = F.max("epoch").over(Window.partitionBy("run"))
    return rounded(history.learning_rates(hist, last), lr=9)
