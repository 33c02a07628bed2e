"""URL filters by the ratio of two character language models.

Rules judge the URLs they match. Those URLs train two Markov models of
variable order, one of accepted and one of rejected URLs; an unmatched URL is
judged by the difference of its log-likelihoods per character, against a
threshold calibrated on URLs the models have not seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelens.llm.common import contained, read, stage
from slicelens.llm.registry import query

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDER = 4
#: Printable ASCII, the mark for everything else, and the end mark.
SYMBOLS = 96
MICRO = 1_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    host = F.translate(host, ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest matching rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (host == name) | host.endswith(f".{name}")
        found = F.when(
            fits & path.startswith(start),
            F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")),
        ).otherwise(found)
    return found


def grams(text: Column, order: int = ORDER) -> Column:
    """Every run of ``order`` characters of the padded text, in one linear pass."""
    plain = F.regexp_replace(text, "[^\\x21-\\x7E]", "\u007f")
    padded = F.concat(F.lit("\u0002" * (order - 1)), plain, F.lit("\u0003"))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order}}}))"), F.lit(1))


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio`` (millionths of a nat) from ``gram, accepted, rejected``.

    Witten-Bell: a context seen n times with u successors gives the shorter
    context the weight u / (n + u); a context never seen gives it all.
    """
    shorter = None
    for length in range(1, order + 1):
        table = counts.groupBy(F.substring("gram", order + 1 - length, length).alias("gram")).agg(
            F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
        )
        context = Window.partitionBy(F.substring("gram", 1, length - 1))
        for c in ("accepted", "rejected"):
            table = table.withColumn(f"n_{c}", F.sum(c).over(context)).withColumn(
                f"u_{c}", F.sum((F.col(c) > 0).cast("bigint")).over(context)
            )
        if shorter is None:
            table = table.withColumns({f"q_{c}": F.lit(1 / SYMBOLS) for c in ("accepted", "rejected")})
        else:
            table = table.join(
                shorter, F.substring(table["gram"], 2, length - 1) == F.col("suffix"), "left"
            )
        p = {
            f"p_{c}": F.when(
                F.col(f"n_{c}") > 0,
                (F.col(c) + F.col(f"u_{c}") * F.col(f"q_{c}"))
                / (F.col(f"n_{c}") + F.col(f"u_{c}")),
            ).otherwise(F.col(f"q_{c}"))
            for c in ("accepted", "rejected")
        }
        table = table.withColumns(p)
        shorter = table.select(
            F.col("gram").alias("suffix"),
            F.col("p_accepted").alias("q_accepted"),
            F.col("p_rejected").alias("q_rejected"),
        )
    ratio = F.round((F.log("p_accepted") - F.log("p_rejected")) * MICRO).cast("bigint")
    return table.select("gram", ratio.alias("ratio"))


@contained
def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages``.

    Needs ``page_id, url``. ``score`` is the mean log-likelihood difference per
    character (null where a rule decides). Four fifths of the ruled URLs, by
    hash, train; the rest place the threshold where both classes lie equally
    many deviations away. A null or empty URL is modelled as empty. Where rules
    accept nothing or reject nothing there is no model, and what no rule
    decides is allowed.
    """
    host, path = url_parts(F.col("url"))
    text = F.translate(F.coalesce("url", F.lit("")), ascii_uppercase, ascii_lowercase)
    rows = stage(
        pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
        .withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
        .select(
            F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "text",
            F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"),
            (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("calibrates"),
        ),
        "urls",
    )
    cut = rows.select(
        "row", "verdict", "calibrates", F.explode(grams(F.col("text"), order)).alias("gram")
    )
    trains = ~F.col("calibrates")
    counts = stage(
        cut.groupBy("gram").agg(
            F.count_if((F.col("verdict") == "allow") & trains).alias("accepted"),
            F.count_if((F.col("verdict") == "block") & trains).alias("rejected"),
        ),
        "grams",
    )
    ratios = stage(log_ratios(counts, order), "ratios")
    unread = F.col("verdict").isNull() | F.col("calibrates")
    scored = (
        cut.filter(unread).join(ratios, "gram").groupBy("row")
        .agg((F.sum("ratio") / F.count("ratio") / MICRO).alias("score"))
    )
    scored = stage(
        rows.select("row", "page_id", "host", "path", "rule", "verdict")
        .join(scored, "row", "left"), "scored"
    )
    ends = {
        r.verdict: (r.middle, r.spread or 0.0)
        for r in scored.filter("verdict IS NOT NULL AND score IS NOT NULL").groupBy("verdict")
        .agg(F.avg("score").alias("middle"), F.stddev_pop("score").alias("spread")).collect()
    }
    if {"allow", "block"} <= ends.keys():
        (high, wide), (low, narrow) = ends["allow"], ends["block"]
        both = wide + narrow
        edge = (high * narrow + low * wide) / both if both > 0 else (high + low) / 2
        own = F.when(F.round("score", 9) >= round(edge, 9), "allow").otherwise("block")
    else:
        own = F.lit("allow")
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", own).alias("verdict"),
        F.when(F.col("verdict").isNull(), F.col("score")).alias("score"),
    )


@query("op10_url_filters")
def op10_url_filters(spark, folder):
    """Verdict on every page's URL."""
    return judge_urls(read(spark, folder, "pages"))
