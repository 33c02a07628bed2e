"""Line dedup by how many distinct sites a line is spread over.

A HyperLogLog sketch of sites per line hash is built map-side and merged by
the aggregation. Lines whose estimate lies near the threshold are counted
exactly. A line at or over the threshold is boilerplate: it stays in the
document with the smallest id and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelens.llm.common import contained, read, stage
from slicelens.llm.registry import query

SITES = 3
LG_K = 12
BLANKS = " \t\r\f\v"


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def line_hashes(text: Column) -> Column:
    """Hashes of the distinct lines of a text, without blank ones."""
    full = F.filter(_trimmed(text), lambda x: x != "")
    return F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))


@contained
def boilerplate_lines(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """``line, first`` of the lines found on at least ``sites`` sites.

    ``lines`` has one row a document and distinct line: ``doc_id, site, line``.
    ``first`` is the smallest id that holds the line. The sketch's relative
    error is 0.83 / sqrt(2^lg_k); estimates within four errors of the
    threshold, half a site at least, are replaced by exact counts.
    """
    near = max(0.5, 4 * 0.83 / 2 ** (lg_k / 2) * sites)
    # Sketches leave empty strings out, so no site may be one.
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.concat(F.lit("="), "site"), lg_k)).alias("spread"),
        F.min("doc_id").alias("first"),
    )
    spread = stage(spread.filter(F.col("spread") >= sites - near), "spread")
    unsure = spread.filter(F.col("spread") <= sites + near)
    exact = (
        lines.join(unsure.select("line"), "line", "left_semi")
        .groupBy("line", "site").agg(F.lit(1).alias("one"))
        .groupBy("line").agg(F.count("one").alias("n"))
        .filter(F.col("n") >= sites).select("line")
    )
    return spread.filter(F.col("spread") > sites + near).select("line", "first").unionByName(
        unsure.join(exact, "line", "left_semi").select("line", "first")
    )


@contained
def lines_to_cut(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """``id, cut``: the hashes of the lines that leave a document, for those that lose some."""
    lines = stage(
        docs.select(
            "doc_id", F.coalesce("source", F.lit("")).alias("site"),
            F.explode(line_hashes(F.col("text"))).alias("line"),
        ),
        "lines",
    )
    return (
        lines.join(boilerplate_lines(lines, sites, lg_k), "line")
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("line").alias("cut"))
    )


def strip_boilerplate(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """``doc, text, n_lines, n_removed`` of every row: the row itself, and its cleaned text.

    Needs ``doc_id, source, text``; ``doc`` is a struct of all columns, so no
    name can clash. A document's site is its source, null and empty being one
    site. Lines are compared without blanks at their ends; blank lines always
    stay. ``n_lines`` counts the lines that are not blank, ``n_removed`` those
    taken out. A null text stays null with counts of 0. A line within one
    document only, or in rows that share an id, is never cut.
    """
    cut = lines_to_cut(docs.select("doc_id", "source", "text"), sites, lg_k)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # Always a shuffle join: the lists of lines grow with the documents.
    rows = rows.join(cut.hint("merge"), F.col("doc.doc_id").eqNullSafe(F.col("id")), "left")
    text = F.col("doc.text")
    stays = F.filter(
        F.split(text, "\n"),
        lambda x: (F.btrim(x, F.lit(BLANKS)) == "")
        | ~F.array_contains(F.col("cut"), F.xxhash64(F.btrim(x, F.lit(BLANKS)))),
    )
    clean = F.when(F.col("cut").isNull(), text).otherwise(F.array_join(stays, "\n"))
    full = lambda t: F.size(F.filter(_trimmed(t), lambda x: x != ""))
    return (
        rows.select("doc", "cut", clean.alias("text"))
        .select(
            "doc", "text",
            F.when(text.isNull(), 0).otherwise(full(text)).alias("n_lines"),
            F.when(F.col("cut").isNull(), 0).otherwise(full(text) - full(F.col("text"))).alias("n_removed"),
        )
    )


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text FROM documents),
lines AS (
  SELECT r, doc_id, site, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT r, doc_id, site, string_split(text, chr(10)) AS a FROM docs WHERE text IS NOT NULL)),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS x FROM lines),
common AS (
  SELECT x, min(doc_id) AS first FROM trimmed WHERE x <> '' GROUP BY x
  HAVING count(DISTINCT site) >= {SITES}),
marked AS (
  SELECT t.*, t.x <> '' AND c.first IS NOT NULL AND t.doc_id <> c.first AS cut
  FROM trimmed t LEFT JOIN common c ON t.x = c.x),
texts AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS text,
         CAST(count(*) FILTER (x <> '') AS INTEGER) AS n_lines,
         CAST(count(*) FILTER (cut) AS INTEGER) AS n_removed
  FROM marked GROUP BY r)
SELECT d.doc_id, t.text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM docs d LEFT JOIN texts t ON d.r = t.r
"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark, folder):
    """Every document without the lines that are spread over many sources."""
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    return strip_boilerplate(docs).select("doc.doc_id", "text", "n_lines", "n_removed")
