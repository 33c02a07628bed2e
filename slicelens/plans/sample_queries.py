"""Sampling, splitting, scaling and description queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicelens.functions.maths import one_hot
from slicelens.operators import sampling, scaling, summaries
from slicelens.operators.joins import stage
from slicelens.operators.ordering import positions, shuffle_key
from slicelens.plans import inputs as I
from slicelens.plans import sql as S
from slicelens.plans.packet_queries import features
from slicelens.plans.registry import query, rounded
from slicelens.settings import (
    CLASSES,
    FEATURES,
    LABEL,
    STEM_SYNTHETIC_BOUNDS,
    SYNTHETIC_BOUNDS,
    SYNTHETIC_NORMALS,
)
from slicelens.sources import synthetic

ID = ["capture_id", "k"]
SMALLEST = "(SELECT min(c) FROM (SELECT count(*) AS c FROM keyed GROUP BY traffic_class))"


def keyed(spark, folder):
    """Feature windows with their shuffle key, evaluated once."""
    found = features(spark, folder)
    return stage(found.withColumn("shuffle_key", shuffle_key([F.col(c) for c in ID], 42)), "keyed")


@query("class_counts", f"WITH {S.FEATURES} SELECT traffic_class, count(*) AS n FROM feat GROUP BY 1")
def class_counts(spark, folder):
    return summaries.class_counts(features(spark, folder))


@query("seeded_shuffle", """
SELECT event_id, md5(concat_ws(':', event_id, 42)) AS shuffle_key,
       row_number() OVER (ORDER BY md5(concat_ws(':', event_id, 42))) AS position FROM events""")
def seeded_shuffle(spark, folder):
    rows = I.table(spark, folder, "events").select("event_id").withColumn(
        "shuffle_key", shuffle_key(F.col("event_id"), 42)
    )
    return positions(rows, [], "shuffle_key")


@query("balance_and_cap", f"""
WITH {S.KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY traffic_class ORDER BY shuffle_key) AS rn FROM keyed)
SELECT capture_id, k, traffic_class FROM r WHERE rn <= least({SMALLEST}, 400)""")
def balance_and_cap(spark, folder):
    return sampling.balance(keyed(spark, folder), LABEL, "shuffle_key", cap=400).select(*ID, LABEL)


@query("balance_classes", """
WITH e AS (SELECT event_id, event_type, md5(concat_ws(':', event_id, 42)) AS shuffle_key FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY shuffle_key) AS rn FROM e)
SELECT event_id, event_type FROM r
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM events GROUP BY event_type))""")
def balance_classes(spark, folder):
    rows = I.table(spark, folder, "events").select("event_id", "event_type").withColumn(
        "shuffle_key", shuffle_key(F.col("event_id"), 42)
    )
    kept = sampling.balance(rows, "event_type", "shuffle_key", at_least=50)
    return kept.select("event_id", "event_type")


@query("head_per_class", """
WITH e AS (SELECT o_orderkey, o_orderpriority, md5(concat_ws(':', o_orderkey, 7)) AS shuffle_key FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY shuffle_key) AS rn FROM e)
SELECT o_orderkey, o_orderpriority, shuffle_key FROM r WHERE rn <= 300""")
def head_per_class(spark, folder):
    rows = I.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority").withColumn(
        "shuffle_key", shuffle_key(F.col("o_orderkey"), 7)
    )
    return sampling.head_per_class(rows, "o_orderpriority", "shuffle_key", 300)


@query("stratified_split", f"""
WITH {S.KEYED},
r AS (SELECT *, row_number() OVER (PARTITION BY traffic_class ORDER BY shuffle_key) AS rn FROM keyed),
q AS (SELECT traffic_class, n, total, (total - (total + 3) // 4) AS train
      FROM (SELECT traffic_class, count(*) AS n, sum(count(*)) OVER () AS total FROM keyed GROUP BY 1)),
s AS (SELECT *, train * n // total AS seats, train - sum(train * n // total) OVER () AS spare,
             row_number() OVER (ORDER BY train * n % total DESC, traffic_class) AS turn FROM q)
SELECT capture_id, k, r.traffic_class,
       rn <= s.n - seats - CASE WHEN turn <= spare THEN 1 ELSE 0 END AS is_test
FROM r JOIN s USING (traffic_class)""")
def stratified_split(spark, folder):
    return sampling.stratified_split(keyed(spark, folder), LABEL, "shuffle_key").select(*ID, LABEL, "is_test")


@query("stratified_split_uneven", """
WITH e AS (SELECT o_orderkey, o_orderpriority, md5(concat_ws(':', o_orderkey, 42)) AS shuffle_key FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY shuffle_key) AS rn FROM e),
q AS (SELECT o_orderpriority, n, total, (total - (total + 3) // 4) AS train
      FROM (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS total FROM e GROUP BY 1)),
s AS (SELECT *, train * n // total AS seats, train - sum(train * n // total) OVER () AS spare,
             row_number() OVER (ORDER BY train * n % total DESC, o_orderpriority) AS turn FROM q)
SELECT o_orderkey, o_orderpriority, rn <= s.n - seats - CASE WHEN turn <= spare THEN 1 ELSE 0 END AS is_test
FROM r JOIN s USING (o_orderpriority)""")
def stratified_split_uneven(spark, folder):
    rows = I.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority").withColumn(
        "shuffle_key", shuffle_key(F.col("o_orderkey"), 42)
    )
    return sampling.stratified_split(rows, "o_orderpriority", "shuffle_key").drop("shuffle_key")


@query("random_split", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey, 42)))
       <= (SELECT (count(*) + 4) // 5 FROM orders) AS is_test FROM orders""")
def random_split(spark, folder):
    rows = I.table(spark, folder, "orders").select("o_orderkey").withColumn(
        "shuffle_key", shuffle_key(F.col("o_orderkey"), 42)
    )
    return sampling.random_split(rows, "shuffle_key").select("o_orderkey", "is_test")


def _z(column: str) -> str:
    return (
        f"CASE WHEN stddev_pop({column}) OVER () = 0 THEN {column} - avg({column}) OVER () "
        f"ELSE ({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER () END"
    )


@query("standardize", f"""
WITH {S.FEATURES}
SELECT capture_id, k, {", ".join(f"round({_z(c)}, 6) AS {c}" for c in FEATURES)} FROM feat""")
def standardize(spark, folder):
    scaled = scaling.standardize(stage(features(spark, folder), "features"), FEATURES)
    return rounded(scaled.select(*ID, *FEATURES), **dict.fromkeys(FEATURES, 6))


@query("standardize_on_train", """
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem),
t AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2,
             stddev_pop(l_extendedprice) AS s2 FROM e WHERE l_discount < 0.05)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m1) / s1, 6) AS l_quantity,
       round((l_extendedprice - m2) / s2, 6) AS l_extendedprice FROM e, t""")
def standardize_on_train(spark, folder):
    rows = I.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    columns = ["l_quantity", "l_extendedprice"]
    scaled = scaling.standardize(rows, columns, fit_on=rows.filter("l_discount < 0.05"))
    return rounded(scaled.drop("l_discount"), l_quantity=6, l_extendedprice=6)


@query("angle_clip", f"""
WITH {S.FEATURES}
SELECT capture_id, k, {", ".join(f"round(least(greatest({_z(c)}, -pi()), pi()), 6) AS {c}" for c in FEATURES)}
FROM feat""")
def angle_clip(spark, folder):
    scaled = scaling.standardize(stage(features(spark, folder), "features"), FEATURES)
    clipped = scaling.angle_clip(scaled, FEATURES).select(*ID, *FEATURES)
    return rounded(clipped, **dict.fromkeys(FEATURES, 6))


@query("label_encode", """
WITH v AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS i
           FROM (SELECT DISTINCT o_orderpriority FROM orders)),
w AS (SELECT o_orderstatus, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS j
      FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT o_orderkey, i AS o_orderpriority, j AS o_orderstatus
FROM orders JOIN v USING (o_orderpriority) JOIN w USING (o_orderstatus)""")
def label_encode(spark, folder):
    rows = I.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return scaling.label_encode(rows)


@query("label_encode_many", """
WITH v AS (SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS i FROM (SELECT DISTINCT c_name FROM customer))
SELECT c_custkey, i AS c_name FROM customer JOIN v USING (c_name)""")
def label_encode_many(spark, folder):
    return scaling.label_encode(I.table(spark, folder, "customer").select("c_custkey", "c_name"))


@query("binary_label", f"""
WITH {S.FEATURES}
SELECT capture_id, k, CASE WHEN traffic_class = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM feat""")
def binary_label(spark, folder):
    return features(spark, folder).select(*ID, scaling.binary_label(F.col(LABEL)).alias("y"))


@query("first_k_features", """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem""")
def first_k_features(spark, folder):
    wide = I.table(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey", "l_returnflag"
    )
    return scaling.first_features(wide, 4)


@query("one_hot_truth", """
SELECT event_id, CAST(user_id % 3 = 0 AS BIGINT) AS is_0, CAST(user_id % 3 = 1 AS BIGINT) AS is_1,
       CAST(user_id % 3 = 2 AS BIGINT) AS is_2 FROM events""")
def one_hot_truth(spark, folder):
    label = F.pmod("user_id", F.lit(3))
    return I.table(spark, folder, "events").select("event_id", *one_hot(label, CLASSES))


@query("epoch_batches", """
WITH e AS (SELECT event_id, epoch, md5(concat_ws(':', event_id, epoch, 42)) AS key
           FROM events, (SELECT unnest([1, 2, 3]) AS epoch)),
r AS (SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY key) - 1) // 32 AS batch FROM e)
SELECT event_id, CAST(epoch AS BIGINT) AS epoch, batch FROM r
WHERE batch < (SELECT count(*) // 32 FROM events)""")
def epoch_batches(spark, folder):
    rows = I.table(spark, folder, "events").select("event_id")
    return sampling.epoch_batches(rows, F.col("event_id"), epochs=3, batch_size=32)


def _described(column: str) -> str:
    quartiles = ", ".join(
        f"round_even(quantile_cont({column}, {q}), 2) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75)
    )
    return f"""SELECT '{column}' AS feature, count({column}) AS n, round_even(avg({column}), 2) AS mean,
       round_even(stddev_samp({column}), 2) AS std, round_even(min({column}), 2) AS min, {quartiles},
       round_even(max({column}), 2) AS max FROM feat"""


@query("describe_features", f"WITH {S.FEATURES} " + " UNION ALL ".join(_described(c) for c in FEATURES))
def describe_features(spark, folder):
    return summaries.describe_features(features(spark, folder))


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_lineitem", "WITH feat AS (SELECT * FROM lineitem) "
       + " UNION ALL ".join(_described(c) for c in _LINE))
def describe_lineitem(spark, folder):
    return summaries.describe_features(I.table(spark, folder, "lineitem"), _LINE)


def _correlated(a: str, b: str) -> str:
    if a == b:
        return f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, 1.0::DOUBLE AS correlation"
    return f"SELECT '{a}', '{b}', round(corr({a}, {b}), 6) FROM feat"


@query("feature_correlation", f"WITH {S.FEATURES} "
       + " UNION ALL ".join(_correlated(a, b) for a in FEATURES for b in FEATURES))
def feature_correlation(spark, folder):
    return rounded(summaries.feature_correlation(features(spark, folder)), correlation=6)


@query("class_histogram", f"""
WITH {S.FEATURES},
r AS (SELECT traffic_class, min(avg_pkt_size_bytes) AS lo, max(avg_pkt_size_bytes) AS hi FROM feat GROUP BY 1),
c AS (SELECT traffic_class, least(CAST(floor((avg_pkt_size_bytes - lo) / ((hi - lo) / 25)) AS BIGINT), 24) AS bin,
             count(*) AS n FROM feat JOIN r USING (traffic_class) GROUP BY 1, 2),
g AS (SELECT traffic_class, lo, hi, unnest(range(25)) AS bin FROM r)
SELECT g.traffic_class, g.bin, round(lo + g.bin * ((hi - lo) / 25), 6) AS left_edge, coalesce(n, 0) AS n
FROM g LEFT JOIN c ON g.traffic_class = c.traffic_class AND g.bin = c.bin""")
def class_histogram(spark, folder):
    found = stage(features(spark, folder), "features")
    return rounded(summaries.class_histogram(found, "avg_pkt_size_bytes"), left_edge=6)


def _normal(i: int) -> str:
    """Box-Muller normal of one row and feature, from quarters of an md5."""
    digest = f"md5(concat_ws(':', id, {i // 4}, 42))"
    pair = i // 2 % 2 * 2
    u, v = (
        f"((('0x' || substr({digest}, {1 + 8 * part}, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)"
        for part in (pair, pair + 1)
    )
    return f"sqrt(-2.0 * ln({u})) * {'cos' if i % 2 == 0 else 'sin'}(2.0 * pi() * {v})"


def _synthetic(i: int, bounds=SYNTHETIC_BOUNDS) -> str:
    pick = lambda j: "CASE cls " + " ".join(
        f"WHEN {c} THEN {float(SYNTHETIC_NORMALS[c][i][j])}::DOUBLE" for c in CLASSES
    ) + " END"
    low, high = bounds[i]
    value = f"{pick(0)} + {pick(1)} * ({_normal(i)})"
    value = f"greatest({value}, {float(low)}::DOUBLE)"
    return f"least({value}, {float(high)}::DOUBLE)" if high is not None else value


def _synthetic_sql(source: str, bounds) -> str:
    made = ", ".join(f"round({_synthetic(i, bounds)}, 6) AS {c}" for i, c in enumerate(FEATURES))
    return f"WITH e AS ({source}) SELECT id, {made}, cls AS traffic_class FROM e"


_EACH_EVENT = "SELECT event_id AS id, event_id % 3 AS cls FROM events"


def _synthetic_events(spark, folder, bounds):
    ids = I.table(spark, folder, "events").select(F.col("event_id").alias("id"))
    made = synthetic.synthetic_rows(ids, F.pmod("id", F.lit(3)).cast("bigint"), bounds)
    return rounded(made, **dict.fromkeys(FEATURES, 6))


@query("synth_class_rows", _synthetic_sql(_EACH_EVENT, SYNTHETIC_BOUNDS))
def synth_class_rows(spark, folder):
    return _synthetic_events(spark, folder, SYNTHETIC_BOUNDS)


@query("synth_class_rows_by_stem", _synthetic_sql(_EACH_EVENT, STEM_SYNTHETIC_BOUNDS))
def synth_class_rows_by_stem(spark, folder):
    return _synthetic_events(spark, folder, STEM_SYNTHETIC_BOUNDS)


@query("fallback_source", f"WITH {S.FEATURES} SELECT capture_id, k, {S.SHOWN}, traffic_class FROM feat")
def fallback_source(spark, folder):
    chosen, _ = synthetic.or_synthetic(features(spark, folder), rows=1200)
    return rounded(chosen, **S.DIGITS)


@query("fallback_taken", f"""
WITH {S.FEATURES}, two AS (SELECT * FROM feat WHERE traffic_class <> 2),
n AS (SELECT count(*) // 3 AS per FROM two),
made AS ({_synthetic_sql("SELECT id, id // per AS cls FROM n, (SELECT unnest(range(3 * per)) AS id FROM n)",
                         STEM_SYNTHETIC_BOUNDS)})
SELECT id, {", ".join(FEATURES)}, CAST(traffic_class AS BIGINT) AS traffic_class FROM made""")
def fallback_taken(spark, folder):
    """Windows that lack a class: as many synthetic rows stand in, within the bounds by stem."""
    two = stage(features(spark, folder).filter(F.col(LABEL) != 2), "two-classes")
    chosen, _ = synthetic.or_synthetic(two, rows=two.count(), bounds=STEM_SYNTHETIC_BOUNDS)
    return rounded(chosen, **dict.fromkeys(FEATURES, 6))
