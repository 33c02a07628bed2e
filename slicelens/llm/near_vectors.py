"""Embedding near-dedup by Euclidean p-stable hashing.

A table's bucket is ``k`` projections of the unit vector on normal directions,
each shifted, divided by the bucket width and rounded down. Vectors that share
a bucket in any table are compared by their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelens.llm.common import contained, read, stage
from slicelens.llm.components import components
from slicelens.llm.registry import query
from slicelens.llm.words import mixed

LEAST = 0.93
WIDTH = 2.0
#: Share of the pairs at exactly the least cosine that share a bucket; nearer pairs do more often.
FOUND = 0.995
#: Unrelated vectors of a label that meet in one bucket, on average.
STRANGERS = 16
#: Rows of one bucket that are compared in one task; larger buckets are split into tiles.
TILE = 4096
PAIRS = 1 << 15


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points at this distance into one cell."""
    t = width / distance
    normal = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def tables_for(rows: int, least: float = LEAST) -> tuple[int, int]:
    """Projections a table and number of tables for so many rows of one label.

    As LSH theory has it: so many projections that unrelated (orthogonal)
    vectors rarely meet, then so many tables that linked ones rarely miss.
    """
    near, far = collision(math.sqrt(2 - 2 * least)), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(rows, 1) / STRANGERS) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - near**k)))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def signatures(dim: int, k: int, tables: int, x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Bucket numbers, one column a table, of the rows of ``x`` (unit vectors)."""
    rng = np.random.default_rng([seed, dim, k])
    cells = np.floor((x @ rng.normal(size=(dim, k * tables)) + rng.uniform(0, WIDTH, k * tables)) / WIDTH)
    cells = cells.astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
    out = np.repeat(mixed(np.arange(1, tables + 1, dtype=np.uint64) + np.uint64(dim << 32))[None], len(x), 0)
    for i in range(k):
        out = mixed(out + cells[:, :, i])
    return out.view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very small or large components stay finite.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _hashed(k: int, tables: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch.vector.map(len)
            for dim in sorted(sizes.unique()):
                part = batch[sizes == dim]
                for lo in range(0, len(part), 1024):
                    rows = part.iloc[lo : lo + 1024]
                    x = np.stack(rows.vector.to_numpy()).astype(kind)
                    yield pd.DataFrame({
                        "id": rows.id, "label": rows.label,
                        "vector": [v.tobytes() for v in x],
                        "buckets": list(signatures(dim, k, tables, unit(x.astype(np.float64)))),
                    })

    return run


def _pairs(bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers i < j of equal buckets, some at a time; ``bucket`` is sorted."""
    n = len(bucket)
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, n)
    after = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n) - 1
    upto = np.cumsum(after)
    lo = 0
    while lo < n:
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        i = np.repeat(np.arange(lo, hi), after[lo:hi])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[lo:hi] - after[lo:hi] - done, after[lo:hi])
        lo = hi


def _compared(least: float, kind: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in frame.groupby(frame.vector.map(len), sort=True):
            part = part.sort_values(["bucket", "id"], ignore_index=True)
            label, half, ids = pd.factorize(part.label)[0], part.half.to_numpy(), part.id.to_numpy()
            x = np.frombuffer(b"".join(part.vector), kind).reshape(len(part), -1)
            for i, j in _pairs(part.bucket.to_numpy()):
                # Both rows from one half of a tile: another tile compares them.
                keep = (label[i] == label[j]) & (ids[i] != ids[j]) & ((half[i] == 0) | (half[i] != half[j]))
                i, j = i[keep], j[keep]
                lo, hi = (int(i.min()), int(j.max()) + 1) if len(i) else (0, 0)
                if not len(i):
                    continue
                u = unit(x[lo:hi].astype(np.float64))
                near = np.einsum("ij,ij->i", u[i - lo], u[j - lo]) >= least
                found.append(pd.DataFrame({"a": ids[i[near]], "b": ids[j[near]]}))
        if not found:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return pd.concat(found).drop_duplicates()

    return run


@contained
def near_pairs(classes: DataFrame, rows: int, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """Linked pairs ``a < b`` of the distinct vectors ``id, label, vector``.

    ``rows`` is the size of the largest label. Buckets beyond ``tile`` rows are
    cut into chunks by id; every two chunks meet in a tile of their own, so all
    pairs of a bucket are compared, none in one oversized task.
    """
    k, tables = tables_for(rows, least)
    kind = "<f4" if classes.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"
    hashed = stage(
        classes.select("id", "label", "vector")
        .mapInPandas(_hashed(k, tables, kind), "id long, label string, vector binary, buckets array<long>"),
        "hashed",
    )
    each = hashed.select("id", "label", "vector", F.explode("buckets").alias("bucket"))
    counts = stage(
        each.groupBy("label", "bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets"
    )
    # Tasks by rows as tiled: a bucket of c chunks sends each row to c tiles.
    tiled = F.col("n") * F.ceil(F.col("n") / F.lit(tile))
    total = counts.agg(F.sum(tiled)).first()[0] or 0
    groups = max(1, math.ceil(total / tile))
    met = each.join(counts, ["label", "bucket"])
    chunks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiled = (
        met.withColumn("chunks", chunks).withColumn("chunk", chunk).withColumn("other", other)
        .select(
            "id", "label", "vector",
            F.xxhash64("label", "bucket", F.least("chunk", "other"), F.greatest("chunk", "other"))
            .alias("bucket"),
            F.signum(F.col("other") - F.col("chunk")).cast("int").alias("half"),
        )
        .withColumn("group", F.pmod(F.col("bucket"), F.lit(groups)))
    )
    pairs = tiled.groupBy("group").applyInPandas(_compared(least, kind), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@contained
def link_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    least: float = LEAST, tile: int = TILE,
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Vectors of one label (of any type, by its text) link from cosine ``least`` up. Null labels, null keys
    and vectors that are null, zero or hold null or non-finite components link
    with nothing; so do vectors of different length. Equal vectors of a label
    are one class that is compared once: its members link with each other and
    with all members of the classes it links with. Rows that repeat a key count
    as one vector, once for each different vector they have.
    """
    kept = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).alias("vector"),
    )
    takes_part = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # 128 bits stand for label and vector in every later step.
    marked = stage(
        kept.select(
            "id", "label", F.when(takes_part, F.col("vector")).alias("vector"),
            F.when(takes_part, F.xxhash64("label", "vector")).alias("h1"),
            F.when(takes_part, F.xxhash64(F.lit(7), "vector", "label")).alias("h2"),
        ),
        "vectors",
    )
    members = (
        marked.filter("h1 IS NOT NULL").groupBy("h1", "h2", "id")
        .agg(F.first("label").alias("label"), F.first("vector").alias("vector"))
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("n"),
             F.first("label").alias("label"), F.first("vector").alias("vector"))
    )
    # Rows of one id may hold several vectors; a class number keeps them apart.
    classes = stage(members.withColumn("id", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    pairs = near_pairs(classes, largest, least, tile)
    small = classes.select("id", "rep", "n")
    both = pairs.union(pairs.select("b", "a"))
    others = (
        both.join(small, both["b"] == small["id"]).groupBy("a").agg(F.sum("n").alias("others"))
    )
    nodes = components(
        pairs.join(small.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a")
        .join(small.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    known = (
        classes.select("h1", "h2", "id", "rep", "n")
        .join(others, classes["id"] == others["a"], "left")
        .join(nodes.withColumnRenamed("id", "node"), F.col("rep") == F.col("node"), "left")
        .select(
            "h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    out = marked.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {LEAST}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(DISTINCT b) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, f.component_id, e.vec_id = f.component_id AS kept
FROM embeddings e JOIN found f ON e.vec_id = f.a LEFT JOIN n ON e.vec_id = n.a
"""


@query("op7_embedding_near_dedup", SQL)
def op7_embedding_near_dedup(spark, folder):
    """Links and components of all embeddings."""
    return link_vectors(read(spark, folder, "embeddings"))
