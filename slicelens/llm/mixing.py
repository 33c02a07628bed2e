"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue. A document's virtual finish time is the number of
words its shuffled source has sent up to and including it, divided by the
source's target. Sorting all copies by finish time and stopping at the total
budget serves the sources in proportion to their targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelens.llm.common import WORD, by_range, contained, read, running, stage
from slicelens.llm.registry import query
from slicelens.operators.ordering import shuffle_key

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 6


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


@contained
def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources by code point, null last, take ``weights`` in turn. The total is
    shared by weight; a source stops at ``most`` times its size and the excess
    goes to the others by weight. A source is stopped exactly if its level
    ``most * size / weight`` lies under the level that the sources of higher
    levels would share, so one pass in order of level settles all of them.
    An empty table has no targets; sources without words have target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    named = by_range(by_source.withColumn("one", F.lit(1).cast("bigint")), order, "by_name")
    turn = F.pmod(F.col("one_before"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("bigint")
    weighed = (
        running(named, [], "by_name", order, ["one"])
        .withColumn("weight", weight)
        .withColumn("room", F.col("source_size") * most)
        .withColumn("level", F.col("room") / F.col("weight"))
        .select("source", "source_size", "weight", "room", "level")
    )
    order = [F.col("level"), *order]
    levels = running(by_range(weighed, order, "by_level"), [], "by_level", order, ["weight", "room"])
    levels = stage(levels, "levels")
    whole = levels.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    total, all_weights = whole.first()
    total, all_weights = total or 0, all_weights or 1
    share = (F.lit(total) - F.col("room_before")) / (F.lit(all_weights) - F.col("weight_before"))
    stopped = levels.withColumn("stopped", share > F.col("level"))
    taken, used = stopped.filter("stopped").agg(F.sum("room"), F.sum("weight")).first()
    left, rest = total - (taken or 0), max(all_weights - (used or 0), 1)
    target = F.when(F.col("stopped"), F.col("room").cast("double")).otherwise(
        F.col("weight") * (F.lit(left) / F.lit(rest))
    )
    return stopped.select("source", "source_size", target.alias("target"))


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


@contained
def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row of ``docs``.

    Needs ``doc_id, source, text``; other columns are not looked at. ``copies``
    is how often the mix takes the document, 0 to ``most``. Null or empty texts
    have size 0 and are never taken. The shuffle is the md5 of id and seed, then
    size and a hash of the text, so reruns and other partitionings agree; many
    null ids spread over tasks by it. Rows of one id and text are
    interchangeable. The budget is the total of all sizes.
    """
    taken = _queued(docs, weights, most, seed)
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies")


def _queued(docs: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    """What ``mix`` returns, and ``tie``, the hash of the text."""
    rows = stage(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), _tie(F.col("text")).alias("tie"),
            shuffle_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed).alias("key"),
            # Staged, so it stays; keeps equal rows apart in ranges.
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),
        ),
        "sizes",
    )
    goals = targets(rows, weights, most)
    order = [F.col("source").isNull(), *[F.col(c) for c in ("source", "key", "size", "tie", "row")]]
    queued = running(by_range(rows, order, "queue"), ["source"], "queue", order[2:], ["size"])
    g = goals.select(F.col("source").alias("_source"), "source_size", "target")
    queued = stage(
        queued.join(g, F.col("source").eqNullSafe(F.col("_source")))
        .select(
            "doc_id", "source", "size", "tie", "key", "source_size", "target",
            (F.col("size_before") + F.col("size")).alias("sent"),
        ),
        "queued",
    )
    finish = (F.col("copy") * F.col("source_size") + F.col("sent")) / F.col("target")
    copies = (
        queued.filter("size > 0 AND target > 0")
        .select("size", "key", "source_size", "target", "sent",
                F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(most)])).alias("copy"))
        .select("size", "key", "copy", finish.alias("finish"))
    )
    order = [F.col("finish"), F.col("key"), F.col("copy")]
    served = running(by_range(copies, order, "served"), [], "served", order, ["size"])
    total = rows.agg(F.sum("size")).first()[0] or 0
    last = (
        served.filter(F.col("size_before") + F.col("size") <= total)
        .agg(F.max(F.struct("finish", "key", "copy"))).first()[0]
    )
    if last is None:
        return queued.select("doc_id", "source", "size", "tie", "source_size", "target",
                             F.lit(0).alias("copies"))
    cut = F.struct(F.lit(last.finish).alias("finish"), F.lit(last.key).alias("key"),
                   F.lit(last.copy).cast("bigint").alias("copy"))
    n = sum(
        (
            F.when(
                F.struct(
                    (F.lit(i).cast("bigint") * F.col("source_size") + F.col("sent"))
                    / F.col("target"),
                    F.col("key"),
                    F.lit(i).cast("bigint"),
                )
                <= cut,
                1,
            ).otherwise(0)
            for i in range(most)
        ),
        F.lit(0),
    )
    return queued.select(
        "doc_id", "source", "size", "tie", "source_size", "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), n).otherwise(0).alias("copies"),
    )


@contained
def _taken(docs: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    return _queued(docs, weights, most, seed)


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all columns.

    Rows of one id and text are interchangeable: the mix says how many of them
    it takes how often, and any of them fill these places.
    """
    taken = _taken(docs.select("doc_id", "source", "text"), weights, most, seed)
    places = taken.groupBy(F.col("doc_id").alias("id"), F.col("size").alias("words"), F.col("tie").alias("mark")).agg(
        F.array(*[F.count_if(F.col("copies") >= i) for i in range(1, most + 1)]).alias("places")
    )
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        columns.alias("doc"), word_count(F.col("text")).alias("size"), _tie(F.col("text")).alias("tie")
    )
    turn = Window.partitionBy("doc.doc_id", "size", "tie").orderBy("size")
    copies = F.size(F.filter("places", lambda n: n >= F.col("turn")))
    same = (
        F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("words"))
        & (F.col("tie") == F.col("mark"))
    )
    return (
        rows.withColumn("turn", F.row_number().over(turn))
        .join(places.hint("merge"), same)
        .withColumn("copies", copies).filter("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("doc.*")
    )


SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), '{SEED}')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w
  FROM sources),
levels AS (
  SELECT *, 3 * source_size / w AS level,
         sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER before, 0) AS room_before,
         coalesce(sum(w) OVER before, 0) AS w_before
  FROM weighed
  WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, (total - room_before) / (weights - w_before) > level AS stopped FROM levels),
rest AS (
  SELECT any_value(total) - coalesce(sum(3 * source_size) FILTER (stopped), 0) AS l,
         any_value(weights) - coalesce(sum(w) FILTER (stopped), 0) AS r FROM marked),
goals AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE)
              ELSE w * (CAST(l AS DOUBLE) / CAST(greatest(r, 1) AS DOUBLE)) END AS target
  FROM marked, rest),
queued AS (
  SELECT s.doc_id, s.size, s.k, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT doc_id, k, size, c, CAST(c * source_size + sent AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS c) WHERE size > 0 AND target > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, k, c ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM served
  WHERE upto <= (SELECT sum(size) FROM sizes) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""


@query("op6_mixing_sources", SQL)
def op6_mixing_sources(spark, folder):
    """Words that a 5-2-1 mix of the sources takes from every document."""
    return mix(read(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
    )
