"""Approximate nearest neighbours: NN-descent and greedy graph search.

Every vector keeps its ``WIDTH`` best known neighbours. A round of NN-descent
joins the graph with itself: whoever names v as a neighbour, or is named by v,
meets at v, and all that meet there are compared. At a node that very many name,
they are dealt into companies, other ones in every round, and each company is
compared, so a hub costs its names times a constant. Blocks of a few random
projection trees give the first lists. A search walks the graph from the
query's own list and looks, hop by hop, at the neighbours of its best finds.

The graph is held in shares, near vectors mostly in the same one. Each share first
joins its own nodes in one task, without any exchange. Then shares are joined by
fours, sixteens and so on until all are one: on each level only links inside the
joined shares are followed, and a link to another share sends the vector there,
once a round. Lists are nearly settled by the level before, so that a share
returns only what is nearer than what is listed there.

Graph and search use the vectors as 32-bit floats, which embeddings are, and
products of 64 bits, so near copies keep their order in every list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelens.llm.common import contained, one, read, release, stage, two, unstage
from slicelens.llm.near_vectors import usable
from slicelens.llm.registry import query
from slicelens.llm.words import mixed

#: Neighbours a node keeps.
WIDTH = 40
#: Rows of a block and number of trees for the first lists.
ROWS, TREES = 128, 4
#: Vectors that place the trees' cuts, at most about.
SAMPLE = 2000
#: Rounds end once no more than this share of all neighbours is new.
SETTLED = 0.001
#: Nodes of one task's share of the graph; a vector is sent once to each other share it is wanted in.
SHARE = 1 << 14
#: Cuts along which shares are laid out, beyond one for each doubling of their number.
FINER = 4
#: A query's finds, and those it follows in a hop; hops end once all are followed.
BEAM, FOLLOW = 192, 48
#: Further cuts of a large block in one go.
CUTS = 8
#: Rows compared at once, and finds of a task held before the best are kept.
MEETING, HELD = 1024, 1 << 22
#: Nodes that meet at one node and are all compared with each other; more are dealt anew in every round.
HUB = 4096
#: ``2 ** level`` shares are joined on a level; the next one joins so many of them; on the last all are.
FANS, ALL = 2, 62
#: A level gives way to the next one, which takes over what is new, at this share of new neighbours; the last goes on.
PASSED = 0.05

GRAPH = "node long, share int, code binary, near binary, score binary, fresh binary, news int"
LINKS = "share int, node long, code binary, least double, at binary, fresh binary"
FOUND = "node long, share int, other long, score double"


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)


def _codes(frame: pd.DataFrame) -> np.ndarray:
    """Vectors back from bytes."""
    if not len(frame):
        return np.zeros((0, 1), np.float32)
    return np.frombuffer(b"".join(frame.code), np.float32).reshape(len(frame), -1)


def _products(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Products of few vectors, so that their rounding decides no order."""
    return x.astype(np.float64) @ z.astype(np.float64).T


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return starts, np.append(starts[1:], len(sorted_keys))


def best(row, other, score, fresh, rows: int, width: int):
    """The ``width`` best different others of each row, as padded matrices (id -1, score -inf)."""
    order = np.lexsort((fresh, other, row))
    row, other, score, fresh = row[order], other[order], score[order], fresh[order]
    first = np.append(True, (row[1:] != row[:-1]) | (other[1:] != other[:-1])) if len(row) else np.zeros(0, bool)
    row, other, score, fresh = row[first], other[first], score[first], fresh[first]
    order = np.lexsort((other, -score, row))
    row, other, score, fresh = row[order], other[order], score[order], fresh[order]
    starts, ends = _runs(row)
    rank = np.arange(len(row)) - np.repeat(starts, ends - starts)
    keep = rank < width
    row, rank = row[keep], rank[keep]
    ids = np.full((rows, width), -1, np.int64)
    scores = np.full((rows, width), -np.inf)
    marks = np.zeros((rows, width), np.uint8)
    ids[row, rank], scores[row, rank], marks[row, rank] = other[keep], score[keep], fresh[keep]
    return ids, scores, marks


def _strongest(node, other, score, width: int) -> pd.DataFrame:
    """Finds of one task, no more than ``width`` a node: others could not enter its list."""
    nodes, row = np.unique(node, return_inverse=True)
    ids, scores, _ = best(row, other, score, np.zeros(len(row), np.uint8), len(nodes), width)
    at = ids >= 0
    return pd.DataFrame({
        "node": np.repeat(nodes, at.sum(1)), "other": ids[at], "score": scores[at],
    })


# The graph


def _coded(batches: Iterator[pd.DataFrame], shares: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x = np.stack(batch.vector.to_numpy()).astype(np.float32)
        yield pd.DataFrame({
            "node": batch.node, "share": batch.node % shares, "code": [c.tobytes() for c in x],
        })


def _placed(batches, planes, cuts):
    """The block of each vector in every tree: on which side of each cut it lies."""
    trees, depth = cuts.shape
    for batch in batches:
        side = (_codes(batch) @ planes).reshape(len(batch), trees, depth) > cuts
        block = (side * (1 << np.arange(depth))).sum(axis=2) if depth else np.zeros((len(batch), trees), int)
        yield batch.assign(block=list(block.astype(np.int64)))


def _block_lists(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    x, node = _codes(frame), frame.node.to_numpy()
    near = min(width, len(node) - 1)
    out = []
    for lo in range(0, len(node) if near else 0, 1024):
        s = _products(x[lo : lo + 1024], x)
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        at = np.argpartition(-s, near - 1, axis=1)[:, :near]
        out.append(pd.DataFrame({
            "node": np.repeat(node[lo : lo + 1024], near), "other": node[at.ravel()],
            "score": np.take_along_axis(s, at, 1).ravel(),
        }))
    if not out:
        return pd.DataFrame({"node": [], "share": [], "other": [], "score": []})
    return pd.concat(out).assign(share=0)[["node", "share", "other", "score"]]


def _together(a: np.ndarray, b: np.ndarray, shares: int, level: int) -> np.ndarray:
    """Whether the shares of two nodes are joined on ``level``, in runs of ``2 ** level`` shares."""
    return a % shares >> level == b % shares >> level


def _taken_in(graph: pd.DataFrame, found: pd.DataFrame, width: int, shares: int = 1, level: int = ALL) -> pd.DataFrame:
    """The nodes of a share with their finds merged in; new neighbours are fresh, and those of later levels stay so."""
    graph = graph.sort_values("node", ignore_index=True)
    n = len(graph)
    if not n:
        return graph
    node = graph.node.to_numpy()
    ids = _matrix(graph.near, np.int64, width)
    scores = _matrix(graph.score, np.float64, width)
    old_row, old_at = np.nonzero(ids >= 0)
    row = np.searchsorted(node, found.node.to_numpy())
    later = ~_together(ids[old_row, old_at], node[old_row], shares, level)
    ids, scores, fresh = best(
        np.concatenate((old_row, row)), np.concatenate((ids[old_row, old_at], found.other.to_numpy(np.int64))),
        np.concatenate((scores[old_row, old_at], found.score.to_numpy(np.float64))),
        np.concatenate((later.astype(np.uint8), np.ones(len(row), np.uint8))), n, width,
    )
    return graph.assign(
        near=[r.tobytes() for r in ids], score=[r.tobytes() for r in scores],
        fresh=[r.tobytes() for r in fresh],
        news=(fresh * _together(ids, node[:, None], shares, level)).sum(axis=1),
    )


def _abroad(node: np.ndarray, ids: np.ndarray, shares: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where lists name a node of another share joined on ``level``."""
    node = node[:, None]
    return np.nonzero((ids >= 0) & (ids % shares != node % shares) & _together(ids, node, shares, level))


def _named(batches, shares: int, width: int, level: int):
    """For each neighbour in another share, who names it."""
    for batch in batches:
        ids, fresh = _matrix(batch.near, np.int64, width), _matrix(batch.fresh, np.uint8, width)
        node = batch.node.to_numpy()
        row, at = _abroad(node, ids, shares, level)
        other = ids[row, at]
        yield pd.DataFrame({"share": other % shares, "node": other, "by": node[row], "fresh": fresh[row, at]})


def _packed(graph: pd.DataFrame, r, v, f, shares: int, width: int) -> pd.DataFrame:
    """Vectors of rows ``r`` with the nodes ``v`` they are wanted at, one row a share."""
    if not len(r):
        return pd.DataFrame({c.split()[0]: [] for c in LINKS.split(", ")})
    order = np.lexsort((1 - f.astype(np.int8), v, v % shares, r))
    r, v, f = r[order], v[order], f[order]
    once = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))
    r, v, f = r[once], v[once], f[once]
    starts, ends = _runs(r * shares + v % shares)
    own = r[starts]
    least = _matrix(graph.score, np.float64, width)[:, -1]
    return pd.DataFrame({
        "share": v[starts] % shares, "node": graph.node.to_numpy()[own], "code": graph.code.to_numpy()[own],
        "least": least[own],
        "at": [v[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
        "fresh": [f[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
    })


def _sent(graph: pd.DataFrame, named: pd.DataFrame, shares: int, width: int, level: int) -> pd.DataFrame:
    """Each node's vector, once to every other share that holds a node it names or is named by."""
    graph = graph.sort_values("node", ignore_index=True)
    node = graph.node.to_numpy(np.int64)
    ids, fresh = _matrix(graph.near, np.int64, width), _matrix(graph.fresh, np.uint8, width)
    row, at = _abroad(node, ids, shares, level)
    return _packed(
        graph, np.concatenate((row, np.searchsorted(node, named.node.to_numpy(np.int64)))),
        np.concatenate((ids[row, at], named.by.to_numpy(np.int64))),
        np.concatenate((fresh[row, at], named.fresh.to_numpy(np.uint8))), shares, width,
    )


def _kept(graph: pd.DataFrame, shares: int, width: int) -> pd.DataFrame:
    """The links that stay in their share, whose vectors are there already."""
    graph = graph.sort_values("node", ignore_index=True)
    node = graph.node.to_numpy(np.int64)
    ids, fresh = _matrix(graph.near, np.int64, width), _matrix(graph.fresh, np.uint8, width)
    row, at = np.nonzero((ids >= 0) & (ids % shares == node[:, None] % shares))
    return _packed(
        graph, np.concatenate((row, np.searchsorted(node, ids[row, at]))),
        np.concatenate((ids[row, at], node[row])), np.tile(fresh[row, at], 2), shares, width,
    )


def _meetings(links: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows of ``links`` meet, sorted: node, row, freshness."""
    at = [np.frombuffer(b, np.int64) for b in links["at"]]
    if not at:
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    v, f = np.concatenate(at), np.frombuffer(b"".join(links.fresh), np.uint8)
    order = np.argsort(v, kind="stable")
    return v[order], row[order], f[order]


def _companies(nodes: np.ndarray, turn: int, hub: int) -> list[np.ndarray]:
    """Positions of all that meet at a node, in groups of at most ``hub``, dealt by hash and round."""
    if len(nodes) <= hub:
        return [np.arange(len(nodes))]
    # Hashed twice: a plain difference of two rounds would keep the same company.
    key = mixed(mixed(nodes.astype(np.uint64)) + np.uint64(turn + 1))
    return np.array_split(np.argsort(key, kind="stable"), math.ceil(len(nodes) / hub))


def _joined(links: pd.DataFrame, width: int, turn: int = 0, hub: int = HUB) -> pd.DataFrame:
    """All that meet at a node are compared, unless they met before; at a hub, each company of this round."""
    x, node, least = _codes(links), links.node.to_numpy(), links.least.to_numpy(np.float64, copy=True)
    v, row, fresh = _meetings(links)
    out, held, most = [], 0, HELD
    by = np.argsort(node, kind="stable")

    def kept():
        return _strongest(*(np.concatenate(p) for p in zip(*out, strict=True)), width)

    def raised(strongest):
        """From now on a find must also be nearer than ``width`` finds held."""
        nodes, count = np.unique(strongest.node, return_counts=True)
        last = strongest.score.to_numpy()[np.cumsum(count) - 1]
        nodes, last = nodes[count == width], last[count == width]
        at = by[np.searchsorted(node, nodes, sorter=by)]
        least[at] = np.maximum(least[at], last)

    for lo, hi in zip(*_runs(v), strict=True):
        for company in _companies(node[row[lo:hi]], turn, hub):
            # Whether two met before is not known of a hub's company.
            r, f = row[lo:hi][company], fresh[lo:hi][company].astype(bool) | (hi - lo > hub)
            if not f.any():
                continue
            new = r[f]
            for a in range(0, len(new), MEETING):
                p = new[a : a + MEETING]
                s = _products(x[p], x[r])
                i, j = np.nonzero((s > least[p][:, None]) & (node[p][:, None] != node[r]))
                out.append((node[p[i]], node[r[j]], s[i, j]))
                held += len(i)
                # Two fresh ones find each other above.
                i, j = np.nonzero((s > least[r]) & ~f)
                out.append((node[r[j]], node[p[i]], s[i, j]))
                held += len(i)
                if held > most:
                    strongest = kept()
                    raised(strongest)
                    out = [tuple(strongest[c].to_numpy() for c in ("node", "other", "score"))]
                    held, most = len(strongest), max(HELD, 2 * len(strongest))
    if not out:
        return pd.DataFrame({"node": [], "share": [], "other": [], "score": []})
    return kept().assign(share=0)[["node", "share", "other", "score"]]


def _compared(graph: pd.DataFrame, links: pd.DataFrame, shares: int, width: int, turn: int) -> pd.DataFrame:
    """Finds of all that meet in a share: its own nodes and those whose vectors were sent."""
    parts = [p for p in (_kept(graph, shares, width), links) if len(p)]
    return _joined(pd.concat(parts, ignore_index=True) if parts else links, width, turn)


def _settled(graph: pd.DataFrame, shares: int, width: int, end: float) -> pd.DataFrame:
    """A share's nodes after rounds of their own, without any other share, until the part ``end`` is new."""
    turn, news = 0, math.inf
    while news > end * len(graph) * width:
        found = _joined(_kept(graph, shares, width), width, turn)
        graph = _taken_in(graph, found, width, shares, 0)
        turn, news = turn + 1, graph.news.sum()
    release()
    return graph


def _own_share(found: DataFrame, shares: int) -> DataFrame:
    return found.withColumn("share", F.pmod("node", F.lit(shares)).cast("int"))


def _merged(graph: DataFrame, found: DataFrame, width: int, shares: int = 1, level: int = ALL) -> DataFrame:
    return graph.groupBy("share").cogroup(found.groupBy("share")).applyInPandas(
        two(_taken_in, width=width, shares=shares, level=level), GRAPH
    )


def _links(graph: DataFrame, shares: int, width: int, level: int = ALL) -> DataFrame:
    """What is sent between different shares."""
    back = graph.select("node", "near", "fresh").mapInPandas(
        one(_named, shares=shares, width=width, level=level), "share int, node long, by long, fresh int"
    )
    return graph.groupBy("share").cogroup(back.groupBy("share")).applyInPandas(
        two(_sent, shares=shares, width=width, level=level), LINKS
    )


def _projected(batches, planes):
    for batch in batches:
        yield batch.assign(at=list(_codes(batch).astype(np.float64) @ planes)).drop(columns="code")


def narrowed(blocks: DataFrame, rows: int, length: int, seed: int) -> DataFrame:
    """``node, code, block, part``: blocks beyond twice ``rows`` are cut at medians of their own rows.

    Only rows that no cut parts, whose products are equal, are dealt out by hash.
    """
    rng, whole, before = np.random.default_rng(seed), [], None
    while True:
        sizes = stage(blocks.groupBy("block").agg(F.count("*").alias("n")), "sizes")
        # Far fewer than rows.
        large = F.broadcast(sizes.filter(F.col("n") > 2 * rows))
        n, top = sizes.filter(F.col("n") > 2 * rows).agg(F.count("*"), F.max("n")).first()
        whole.append(blocks.join(large, "block", "left_anti").withColumn("part", F.lit(0).cast("long")))
        if not n:
            break
        over = blocks.join(large, "block")
        if before == sizes.count():
            dealt = F.pmod(F.xxhash64("node", "block"), F.ceil(F.col("n") / F.lit(2 * rows)))
            whole.append(over.withColumn("part", dealt).drop("n"))
            break
        depth = min(CUTS, math.ceil(math.log2(top / rows)))
        planes = rng.normal(size=(length, depth))
        sides = stage(
            over.mapInPandas(one(_projected, planes=planes), "block long, node long, n long, at array<double>"),
            "sides",
        )
        medians = [F.percentile_approx(F.col("at")[i], 0.5, 1000) for i in range(depth)]
        cuts = F.broadcast(sides.groupBy("block").agg(F.array(*medians).alias("cut")))
        deep = F.ceil(F.log2(F.col("n") / F.lit(rows)))
        beyond = [(F.lit(i) < deep) & (F.col("at")[i] > F.col("cut")[i]) for i in range(depth)]
        new = sides.join(cuts, "block").select(
            "node", F.col("block").alias("old"), F.xxhash64("block", *beyond).alias("block")
        )
        code = blocks.select("node", "code", F.col("block").alias("old"))
        blocks, before = stage(code.join(new, ["node", "old"]).select("node", "code", "block"), "blocks"), n
    out = whole[0].select("node", "code", "block", "part")
    for part in whole[1:]:
        out = out.union(part.select("node", "code", "block", "part"))
    return out


def _shares(count: int, share: int) -> int:
    return max(1, math.ceil(count / share))


def _celled(batches, planes, cuts):
    for batch in batches:
        side = np.stack(batch.vector.to_numpy()).astype(np.float64) @ planes > cuts
        yield batch.assign(cell=(side * (1 << np.arange(len(cuts))[::-1])).sum(axis=1).astype(np.int64))


def settle(nodes: DataFrame, count: int, shares: int) -> DataFrame:
    """``nodes`` numbered anew so that near vectors mostly have the same share, ``node % shares``.

    Cuts at medians along the widest directions order the vectors; each share is an equal range of that order.
    """
    if shares == 1:
        return nodes
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= F.lit(int(min(1.0, SAMPLE / count) * (1 << 30)))
    sample = nodes.filter(drawn).select("vector").toPandas()
    if not len(sample):
        return nodes
    sample = np.stack(sample.vector.to_numpy()).astype(np.float64)
    planes = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)[2].T
    planes = planes[:, : math.ceil(math.log2(shares)) + FINER]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    celled = nodes.mapInPandas(
        one(_celled, planes=planes, cuts=np.median(sample @ planes, axis=0)), f"{kinds}, cell long"
    )
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"))
    # Some cells a share.
    cells = stage(
        cells.withColumn("before", F.sum("n").over(Window.orderBy("cell")) - F.col("n")), "cells"
    )
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))
    share = F.floor(place * F.lit(shares) / F.lit(count))
    return stage(
        celled.join(cells, "cell").withColumn("node", F.col("node") * F.lit(shares) + share).select(*nodes.columns),
        "settled",
    )


def build_graph(
    nodes: DataFrame, count: int, width: int = WIDTH, rows: int = ROWS, trees: int = TREES,
    share: int = SHARE, seed: int = 3,
) -> tuple[DataFrame, int]:
    """The graph over ``node, vector`` (different vectors of one length), and its number of shares."""
    shares = _shares(count, share)
    coded = stage(
        nodes.select("node", "vector").mapInPandas(
            one(_coded, shares=shares), "node long, share int, code binary"
        ),
        "coded",
    )
    part = min(1.0, SAMPLE / max(count, 1))
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= F.lit(int(part * (1 << 30)))
    sample = _codes(coded.filter(drawn).select("code").toPandas())
    depth = max(0, math.ceil(math.log2(max(count, 1) / rows)))
    # A tree without cuts is the whole table; one of them will do.
    trees = trees if depth else 1
    planes = np.random.default_rng(seed).normal(size=(sample.shape[1], trees * depth))
    cuts = np.median(sample @ planes, axis=0).reshape(trees, depth) if len(sample) else np.zeros((trees, depth))
    placed = coded.mapInPandas(
        one(_placed, planes=planes, cuts=cuts),
        "node long, share int, code binary, block array<long>",
    )
    blocks = placed.select("node", "code", F.posexplode("block").alias("tree", "block"))
    blocks = blocks.select("node", "code", F.xxhash64("tree", "block").alias("block"))
    found = (
        narrowed(blocks, rows, sample.shape[1], seed + 1)
        .groupBy("block", "part").applyInPandas(one(_block_lists, width=width), FOUND)
    )
    none = lambda value, kind: F.lit(np.full(width, value, kind).tobytes())
    graph = coded.select(
        "*", none(-1, np.int64).alias("near"), none(-np.inf, np.float64).alias("score"),
        none(0, np.uint8).alias("fresh"), F.lit(0).alias("news"),
    )
    graph = stage(_merged(graph, _own_share(found, shares), width), "graph")
    levels = [0, *range(FANS, (shares - 1).bit_length() + FANS, FANS)]
    ends = [PASSED] * (len(levels) - 1) + [SETTLED]
    last, graph = graph, stage(
        graph.groupBy("share").applyInPandas(one(_settled, shares=shares, width=width, end=ends[0]), GRAPH), "graph"
    )
    unstage(last)
    turn = 0
    for level, end in zip(levels[1:], ends[1:], strict=True):
        news = math.inf
        while news > end * count * width:
            links = _links(graph, shares, width, level)
            found = graph.groupBy("share").cogroup(links.groupBy("share")).applyInPandas(
                two(_compared, shares=shares, width=width, turn=turn), FOUND
            )
            turn += 1
            merged = _merged(graph, _own_share(found, shares), width, shares, level)
            last, graph = graph, stage(merged, "graph")
            unstage(last)
            news = graph.agg(F.sum("news")).first()[0] or 0
    return graph, shares


# The search


def _asked(batches, shares: int, beam: int, follow: int):
    """Requests of each query to the shares of the finds it follows now."""
    for batch in batches:
        ids, state = _matrix(batch.near, np.int64, beam), _matrix(batch.fresh, np.uint8, beam)
        least = _matrix(batch.score, np.float64, beam)[:, -1]
        open_ = (ids >= 0) & (state == 1)
        row, at = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= follow))
        v = ids[row, at]
        order = np.lexsort((v % shares, row))
        row, v = row[order], v[order]
        starts, ends = _runs(row * shares + v % shares)
        own = row[starts]
        yield pd.DataFrame({
            "share": v[starts] % shares, "node": batch.node.to_numpy()[own],
            "code": batch.code.to_numpy()[own], "least": least[own],
            "at": [v[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
            "fresh": [b"\1" * int(b - a) for a, b in zip(starts, ends, strict=True)],
        })


def _answered(asked: pd.DataFrame, links: pd.DataFrame, beam: int) -> pd.DataFrame:
    """What the links of the nodes asked for offer above each query's least find."""
    none = pd.DataFrame({"node": [], "share": [], "other": [], "score": []})
    if not len(asked) or not len(links):
        return none
    x, node = _codes(links), links.node.to_numpy()
    q, who, least = _codes(asked), asked.node.to_numpy(), asked.least.to_numpy(np.float64)
    v, row, _ = _meetings(links)
    w, asks, _ = _meetings(asked)
    out, held, most = [], 0, HELD

    def kept():
        return _strongest(*(np.concatenate(p) for p in zip(*out, strict=True)), beam)

    for lo, hi in zip(*_runs(w), strict=True):
        a, b = np.searchsorted(v, w[lo]), np.searchsorted(v, w[lo], side="right")
        # Both sides of a hub are long: in tiles.
        for c in range(lo, hi, MEETING):
            for d in range(a, b, HUB):
                r, p = row[d : min(b, d + HUB)], asks[c : min(hi, c + MEETING)]
                s = _products(q[p], x[r])
                i, j = np.nonzero((s > least[p][:, None]) & (who[p][:, None] != node[r]))
                out.append((who[p[i]], node[r[j]], s[i, j]))
                held += len(i)
                if held > most:
                    strongest = kept()
                    out = [tuple(strongest[n].to_numpy() for n in ("node", "other", "score"))]
                    held, most = len(strongest), max(HELD, 2 * len(strongest))
    if not out:
        return none
    return kept().assign(share=0)[["node", "share", "other", "score"]]


def _advanced(state: pd.DataFrame, found: pd.DataFrame, beam: int, follow: int) -> pd.DataFrame:
    """Finds merged in; those followed last are closed (2), new ones open (1)."""
    state = state.sort_values("node", ignore_index=True)
    n = len(state)
    if not n:
        return state
    ids, marks = _matrix(state.near, np.int64, beam), _matrix(state.fresh, np.uint8, beam)
    scores = _matrix(state.score, np.float64, beam)
    open_ = (ids >= 0) & (marks == 1)
    # 0 sorts first, so what was there keeps its mark against the same node found again.
    closed = (marks == 2) | (open_ & (np.cumsum(open_, axis=1) <= follow))
    row, at = np.nonzero(ids >= 0)
    new = np.searchsorted(state.node.to_numpy(), found.node.to_numpy())
    ids, scores, marks = best(
        np.concatenate((row, new)), np.concatenate((ids[row, at], found.other.to_numpy(np.int64))),
        np.concatenate((scores[row, at], found.score.to_numpy(np.float64))),
        np.concatenate((np.where(closed[row, at], 0, 1), np.ones(len(new)))).astype(np.uint8), n, beam,
    )
    marks = np.where((ids >= 0) & (marks == 0), 2, marks).astype(np.uint8)
    return state.assign(
        near=[r.tobytes() for r in ids], score=[r.tobytes() for r in scores],
        fresh=[r.tobytes() for r in marks], news=(marks == 1).sum(axis=1),
    )


def _begun(batches, width: int, beam: int):
    """A query's first finds: its own node's list, all open."""
    for batch in batches:
        n = len(batch)
        ids, scores = _matrix(batch.near, np.int64, width), _matrix(batch.score, np.float64, width)
        row, at = np.nonzero(ids >= 0)
        ids, scores, marks = best(row, ids[row, at], scores[row, at], np.ones(len(row), np.uint8), n, beam)
        yield batch.assign(
            near=[r.tobytes() for r in ids], score=[r.tobytes() for r in scores],
            fresh=[r.tobytes() for r in marks], news=(marks == 1).sum(axis=1),
        )


def search(
    graph: DataFrame, shares: int, queries: DataFrame, width: int = WIDTH,
    beam: int = BEAM, follow: int = FOLLOW,
) -> DataFrame:
    """``node, other``: the finds of each node in ``queries`` (``node``)."""
    kept = graph.groupBy("share").applyInPandas(one(_kept, shares=shares, width=width), LINKS)
    links = stage(_links(graph, shares, width).union(kept), "links")
    begun = graph.join(queries.hint("merge"), "node", "left_semi")
    state = stage(begun.mapInPandas(one(_begun, width=width, beam=beam), GRAPH), "search")
    while state.agg(F.sum("news")).first()[0]:
        asked = state.mapInPandas(one(_asked, shares=shares, beam=beam, follow=follow), LINKS)
        found = asked.groupBy("share").cogroup(links.groupBy("share")).applyInPandas(
            two(_answered, beam=beam), FOUND
        )
        last, state = state, stage(
            state.groupBy("share").cogroup(_own_share(found, shares).groupBy("share"))
            .applyInPandas(two(_advanced, beam=beam, follow=follow), GRAPH),
            "search",
        )
        unstage(last)

    def finds(batches):
        for batch in batches:
            ids = _matrix(batch.near, np.int64, beam)
            row, at = np.nonzero(ids >= 0)
            yield pd.DataFrame({"node": batch.node.to_numpy()[row], "other": ids[row, at]})

    return state.mapInPandas(finds, "node long, other long")


def _product(x: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([
        float(np.dot(np.asarray(a, np.float64), np.asarray(b, np.float64))) for a, b in zip(x, z, strict=True)
    ], dtype=np.float64)


@contained
def nearest(
    rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", **limits
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each query.

    ``is_query`` is a condition on the rows' key column. Vectors that are null, zero or hold
    null or non-finite components, null keys, and vectors of another length than
    the table's most frequent one (the larger of two) take no part. Equal
    vectors are one node; each of its rows is a candidate of its own, ties go to
    the smaller key. Rows that repeat key and vector count once. With k rows or
    fewer besides the query, all are found.
    """
    all_rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).filter(
        usable(F.col("vector")) & F.col("id").isNotNull()
    )
    length = (
        all_rows.groupBy(F.size("vector").alias("length")).count()
        .orderBy(F.desc("count"), F.desc("length")).first()
    )
    length = length.length if length else 0
    marked = stage(
        all_rows.filter(F.size("vector") == length).select(
            "id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2")
        ),
        "vectors",
    )
    nodes = marked.groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    last, nodes = nodes, settle(nodes, count, _shares(count, SHARE))
    if nodes is not last:
        unstage(last)
    members = stage(
        marked.select("id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
        .select("id", "node"),
        "members",
    )
    asked = members.filter(is_query(F.col("id")))
    wanted = stage(asked.select("node").distinct(), "queries")
    graph, shares = build_graph(nodes, count)
    found = search(graph, shares, wanted, **limits).union(wanted.select("node", F.col("node").alias("other")))
    x = nodes.select("node", F.col("vector").alias("x"))
    z = nodes.select(F.col("node").alias("other"), F.col("vector").alias("z"))
    product = F.pandas_udf(_product, "double")
    scored = stage(
        found.join(x.hint("merge"), "node").join(z.hint("merge"), "other")
        .select("node", "other", product("x", "z").alias("score")),
        "scored",
    )
    # A node's first k + 1 rows are all that can enter a list of k that leaves one row out.
    first = Window.partitionBy("node").orderBy("id")
    few = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    listed = Window.partitionBy("node").orderBy(F.desc("score"), "id")
    lists = (
        scored.join(few.select(F.col("node").alias("other"), "id"), "other")
        .withColumn("r", F.row_number().over(listed)).filter(F.col("r") <= k + 1)
        .select("node", F.col("id").alias("vec_id"), "score")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select(F.col("id").alias("query_id"), "node").join(lists, "node")
        .filter("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark, folder):
    """The 20 nearest vectors of every twentieth embedding."""
    return nearest(read(spark, folder, "embeddings"), lambda key: key % 20 == 0)
