"""Codes of vectors by product quantisation, learned with Lloyd's rounds over cover trees.

Blocks of vectors, formed within a partition, hold one cover tree for each of
the eight parts. A node covers a run of the block's points within its radius,
and running sums give the sum of any run. A round sends all runs down against
the entries: by the triangle inequality a whole run goes to one entry as soon
as no other can be nearer for any of its points; only the points of leaves that
stay ambiguous are compared one by one. All distances are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicelens.llm.common import contained, one, read, stage
from slicelens.llm.registry import query

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors under one set of trees, and points of a leaf.
BLOCK, LEAF = 4096, 32
#: Largest component in steps; squared distances of long parts still fit 64 bits.
LARGEST = 1 << 26

Tree = tuple[np.ndarray, np.ndarray]
#: Columns of a tree's nodes.
LO, HI, CHILD, CHILDREN, SQUARE = range(5)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for i in range(points.shape[1]):
        step = points[:, i, None] - entries[None, :, i]
        out += step * step
    return out


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Order of the points and nodes (runs of that order) of a cover tree over them.

    A node's first point is its centre; ``SQUARE`` is the squared distance of
    the farthest point of its run. Its children's centres, its own among them,
    lie more than half its radius apart, and every point lies within half the
    radius of its child's centre.
    """
    order = np.arange(len(points))
    nodes = [[0, len(points), 0, 0, 0]]
    for node in nodes:  # grows as it goes
        lo, hi = node[LO], node[HI]
        run = order[lo:hi]
        x = points[run]
        near = ((x - x[0]) ** 2).sum(axis=1)
        node[SQUARE] = radius = int(near.max())
        if radius == 0 or hi - lo <= leaf:
            continue
        owner, centres = np.zeros(len(run), np.int64), [0]
        while True:
            far = int(near.argmax())
            if 4 * int(near[far]) <= radius:
                break
            d = ((x - x[far]) ** 2).sum(axis=1)
            closer = d < near
            near[closer] = d[closer]
            owner[closer] = len(centres)
            centres.append(far)
        first = np.ones(len(run), bool)
        first[centres] = False  # centres come first in their child's run
        order[lo:hi] = run[np.lexsort((first, owner))]
        ends = lo + np.cumsum(np.bincount(owner, minlength=len(centres)))
        node[CHILD], node[CHILDREN] = len(nodes), len(centres)
        nodes += [[int(a), int(b), 0, 0, 0] for a, b in zip([lo, *ends[:-1]], ends, strict=True)]
    return order, np.array(nodes, np.int64)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the runs that start at ``starts``, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def assigned(
    points: np.ndarray, nodes: np.ndarray, entries: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs ``lo, hi`` of the ordered ``points`` and the nearest entry of each (ties to the lower).

    Every point is in exactly one run; a run of one point was compared by itself.
    """
    nodes_at = np.zeros(1 if len(points) else 0, np.int64)
    open_ = np.ones((len(nodes_at), len(entries)), bool)
    while len(nodes_at):
        at = nodes[nodes_at]
        exact = np.where(open_, distances(points[at[:, LO]], entries), np.iinfo(np.int64).max)
        best = exact.argmin(axis=1)
        away, radius = np.sqrt(exact.astype(np.float64)), np.sqrt(at[:, SQUARE].astype(np.float64))
        least = away[np.arange(len(at)), best]
        # An entry is out where it is farther for every point of the run; rounding only keeps entries in.
        bound = (least + 2 * radius) * (1 + 1e-9)
        open_ &= away <= bound[:, None]
        sure = (radius == 0) | (open_.sum(axis=1) == 1)
        yield at[sure, LO], at[sure, HI], best[sure]
        leaf = ~sure & (at[:, CHILDREN] == 0)
        sizes = (at[:, HI] - at[:, LO])[leaf]
        rows = _spread(at[leaf, LO], sizes)
        if len(rows):
            among = np.repeat(open_[leaf], sizes, axis=0)
            d = np.where(among, distances(points[rows], entries), np.iinfo(np.int64).max)
            yield rows, rows + 1, d.argmin(axis=1)
        inner = ~sure & ~leaf
        counts = at[inner, CHILDREN]
        nodes_at, open_ = _spread(at[inner, CHILD], counts), np.repeat(open_[inner], counts, axis=0)


def _planted(columns: list[str], dim: int):
    """Batches of kept vectors to blocks: their trees, and what stays beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(lo, BLOCK)
                vectors = rows.column(rows.schema.get_field_index("vector")).flatten()
                x = np.asarray(vectors.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                x = np.floor(x * SCALE).astype(np.int64)
                trees = [cover_tree(part) for part in np.split(x, PARTS, axis=1)]
                whole = pa.array([0, rows.num_rows], pa.int32())
                held = [
                    pa.ListArray.from_arrays(whole, rows.column(rows.schema.get_field_index(c)))
                    for c in columns
                ]
                yield pa.RecordBatch.from_arrays(
                    [*held, pa.array([x.astype("<i4").tobytes()], pa.binary()),
                     pa.array([[o.astype("<i4").tobytes() for o, _ in trees]], pa.list_(pa.binary())),
                     pa.array([[n.astype("<i8").tobytes() for _, n in trees]], pa.list_(pa.binary()))],
                    names=[*columns, "points", "orders", "nodes"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int):
    """Every block: its batch row, its points, and a part's ordered points, order and nodes."""
    for batch in batches:
        for row in range(batch.num_rows):
            item = {c: batch.column(i)[row] for i, c in enumerate(batch.schema.names)}
            x = np.frombuffer(item["points"].as_py(), "<i4").astype(np.int64).reshape(-1, dim)
            parts = []
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                order = np.frombuffer(item["orders"][p].as_py(), "<i4")
                parts.append((part[order], order, np.frombuffer(item["nodes"][p].as_py(), "<i8").reshape(-1, 5)))
            yield item, parts


def _summed(books: list[np.ndarray], dim: int):
    """Per task: how many parts go to each entry, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dim // PARTS
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        for _, parts in _blocks(batches, dim):
            for p, (points, _, nodes) in enumerate(parts):
                running = np.zeros((len(points) + 1, width), np.int64)
                np.cumsum(points, axis=0, out=running[1:])
                for lo, hi, entry in assigned(points, nodes, books[p]):
                    np.add.at(counts[p], entry, hi - lo)
                    np.add.at(sums[p], entry, running[hi] - running[lo])
        yield pa.RecordBatch.from_pydict(
            {
                "part": [p for p, b in enumerate(books) for _ in b],
                "entry": [e for b in books for e in range(len(b))],
                "n": [int(n) for c in counts for n in c],
                "sums": [s.tolist() for part in sums for s in part],
            },
            schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                              ("sums", pa.list_(pa.int64()))]),
        )

    return run


def _coded(books: list[np.ndarray], dim: int, columns: list[str]):
    """Code and error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, parts in _blocks(batches, dim):
            codes = np.zeros((len(parts[0][0]), PARTS), np.int64)
            error = np.zeros(len(codes), np.int64)
            for p, (points, order, nodes) in enumerate(parts):
                found = np.zeros(len(points), np.int64)
                for lo, hi, entry in assigned(points, nodes, books[p]):
                    found[_spread(lo, hi - lo)] = np.repeat(entry, hi - lo)
                codes[order, p] = found
                error[order] += ((points - books[p][found]) ** 2).sum(axis=1)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * PARTS
            yield pa.RecordBatch.from_arrays(
                [*[item[c].values for c in columns],
                 pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                 pa.array(error)],
                names=[*columns, "code", "error"],
            )

    return run


def kept(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def codebooks_sha256(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(int(x)) for book in books for entry in book for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def learn_codebooks(
    blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS
) -> list[np.ndarray]:
    """Codebooks of all parts after ``rounds`` of Lloyd's over the staged ``blocks``.

    ``first`` holds the vectors that the entries start as, in steps. What a
    round brings to the driver is one row an entry.
    """
    dim = first.shape[1]
    width = dim // PARTS
    books = np.split(first, PARTS, axis=1)
    points = blocks.select("points", "orders", "nodes")
    for _ in range(rounds):
        parts = points.mapInArrow(
            one(_summed(books, dim)), "part int, entry int, n long, sums array<long>"
        )
        totals = parts.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
        )
        after = [b.copy() for b in books]
        for row in totals.filter("n > 0").collect():
            after[row.part][row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
        if all((a == b).all() for a, b in zip(after, books, strict=True)):
            break  # settled: further rounds would change nothing
        books = after
    return books


@contained
def compress_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    rounds: int = ROUNDS,
) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` of every row with a usable vector.

    Components count in steps of 1/4096, rounded down. Rows whose vector is
    null or holds null or non-finite components are dropped. Null keys come
    last in the order that picks the first entries, equal keys go by their
    vectors; with fewer than 16 rows there are as many entries. Repeated rows
    are rows of their own. ``label_error`` sums the error of all rows of equal
    label, null labels together. Other columns are left out. No rows give an
    empty table. Vectors must be of one length, a multiple of 8, and no
    component beyond 2^26 steps (16,384), or a ``ValueError`` says so: there
    is no codebook for the first, and the second keeps sums of squares exact.
    """
    usable = rows.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).filter(kept(F.col("vector")))
    low, high, reach = usable.agg(
        F.min(F.size("vector")), F.max(F.size("vector")),
        F.max(F.array_max(F.transform("vector", F.abs))),
    ).first()
    if low is not None and (low != high or low % PARTS or not low):
        raise ValueError(f"vectors of {low} to {high} components; want one length, a multiple of {PARTS}")
    if reach is not None and reach * SCALE > LARGEST:
        raise ValueError(f"a component of {reach}; want at most {LARGEST / SCALE}")
    kinds = {f.name: f.dataType for f in usable.schema}
    if low is None:
        coded = usable.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        books = []
    else:
        beside = T.StructType([T.StructField(c, T.ArrayType(kinds[c])) for c in ("id", "label")])
        schema = T.StructType(
            [*beside.fields, T.StructField("points", T.BinaryType()),
             T.StructField("orders", T.ArrayType(T.BinaryType())), T.StructField("nodes", T.ArrayType(T.BinaryType()))]
        )
        blocks = stage(usable.mapInArrow(one(_planted(["id", "label"], low)), schema), "blocks")
        start = usable.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
        first = np.floor(np.array([r.vector for r in start], np.float64) * SCALE).astype(np.int64)
        books = learn_codebooks(blocks, first, rounds)
        flat = T.StructType(
            [*[T.StructField(c, kinds[c]) for c in ("id", "label")],
             T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
        )
        coded = stage(blocks.mapInArrow(one(_coded(books, low, ["id", "label"])), flat), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = F.col("own.label").eqNullSafe(F.col("sum.label"))
    return coded.alias("own").join(totals.alias("sum"), same).select(
        F.col("own.id").alias(key), "code", "error", "label_error",
        F.lit(codebooks_sha256(books)).alias("codebooks_sha256"),
    )


def _sql() -> str:
    """Lloyd's rounds written out, one pair of tables a round."""
    width = "len(v) // 8"
    steps = [f"""
WITH good AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, v[part * ({width}) + 1:(part + 1) * ({width})] AS x FROM good, range({PARTS}) t(part)),
e0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (
  SELECT p.r, p.part, e.entry, list_sum(list_transform(range(1, len(x) + 1),
    lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS d FROM p JOIN e{i} e ON p.part = e.part),
a{i} AS MATERIALIZED (
  SELECT r, part, min(d) AS d, CAST(min(d * {ENTRIES} + entry) % {ENTRIES} AS BIGINT) AS entry
  FROM d{i} GROUP BY r, part)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS MATERIALIZED (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
    SELECT part, entry, j, sum(y) AS s, count(*) AS n FROM (
      SELECT a.part, a.entry, unnest(p.x) AS y, unnest(range(len(p.x))) AS j
      FROM a{i} a JOIN p ON a.r = p.r AND a.part = p.part) GROUP BY ALL) GROUP BY ALL),
e{i + 1} AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.c, e.c) AS c FROM e{i} e LEFT JOIN m{i} m
    ON e.part = m.part AND e.entry = m.entry)""")
    return ",".join(steps) + f"""
, coded AS (
  SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM e{ROUNDS}) AS codebooks_sha256
FROM coded JOIN good USING (r)
"""


SQL = _sql()


@query("op13_vector_codes", SQL)
def op13_vector_codes(spark, folder):
    """Codes and errors of all embeddings."""
    return compress_vectors(read(spark, folder, "embeddings"))
