import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slicelens.llm.neighbours import (
    FOUND,
    GRAPH,
    _companies,
    _compared,
    _joined,
    _kept,
    _links,
    _settled,
    _together,
    build_graph,
    nearest,
    search,
    settle,
)
from slicelens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, node string, score string"


def brute(rows, query, k=20):
    x = {i: np.asarray(v, np.float32).astype(float) for i, v in rows}
    scores = sorted((-float(x[query] @ v), i) for i, v in x.items() if i != query)
    return [(i, -s) for s, i in scores[:k]]


def found(make, rows, k=20):
    out = nearest(make([(*r, "n", "s") for r in rows], SCHEMA), lambda key: key % 5 == 0, k).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_small_table_is_exact_with_ties_copies_and_bad_vectors(make):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]
    bad = [(200, None), (205, [0.0] * 6), (210, [float("nan")] * 6), (215, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
           (220, [float("inf")] + [1.0] * 5), (225, [1.0, 2.0]), (None, rows[0][1])]
    got = found(make, rows + bad)
    assert set(got) == {i for i, _ in rows if i % 5 == 0}
    for q, mine in got.items():
        want = brute(rows, q)
        assert [i for i, _ in mine] == [i for i, _ in want]
        np.testing.assert_allclose([s for _, s in mine], [s for _, s in want], rtol=1e-12)


def test_fewer_candidates_than_asked_for(make):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert [i for i, _ in found(make, rows)[0]] == [1, 2]
    assert found(make, [(0, [1.0])]) == {} and found(make, []) == {}


def test_recall_of_the_query(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in table])
    x = np.array([r.embedding for r in table], float)
    out = QUERIES["op3_nearest_neighbours"](spark, folder).groupBy("query_id").agg(F.collect_set("vec_id").alias("v"))
    hit = total = 0
    for r in out.collect():
        q = int(np.flatnonzero(ids == r.query_id)[0])
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
        hit, total = hit + len(want & set(r.v)), total + len(want)
    assert total == 20 * len([i for i in ids if i % 20 == 0]) and hit >= 0.9 * total


def test_recall_inside_one_group_of_near_copies(make):
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + 0.04 * rng.normal(size=(3000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    out = nearest(
        make([(i, v.tolist(), "n", "s") for i, v in enumerate(x)], SCHEMA), lambda key: key % 50 == 0
    ).groupBy("query_id").agg(F.collect_set("vec_id").alias("v"))
    hit = 0
    for r in out.collect():
        s = x.astype(float) @ x[r.query_id].astype(float)
        s[r.query_id] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(r.v))
    assert hit >= 0.95 * 20 * 60, hit / 20 / 60


def linked(make, lists, vectors, width):
    """A graph of one share from lists of neighbours."""
    x = {n: np.float32(v) for n, v in vectors.items()}
    rows = []
    for n in x:
        near = lists.get(n, [])[:width]
        ids, scores = np.full(width, -1, np.int64), np.full(width, -np.inf)
        ids[: len(near)], scores[: len(near)] = near, [float(x[n] @ x[o]) for o in near]
        rows.append((n, 0, x[n].tobytes(), ids.tobytes(), scores.tobytes(), bytes(width), 0))
    return make(rows, GRAPH)


def test_search_follows_until_nothing_is_open(make):
    graph = linked(make, {i: [i + 1] for i in range(29)}, {i: [1.0 + i, 1.0] for i in range(30)}, 1)
    out = search(graph, 1, make([(0,)], "node long"), width=1, beam=4, follow=1).collect()
    assert 29 in {r.other for r in out}


def test_all_nodes_that_name_a_node_are_answered(make):
    spokes = range(100, 300)
    lists = {s: [0] for s in spokes} | {1000 + s: [s] for s in spokes}
    graph = linked(make, lists, {0: [9.0, 0.0]} | {n: [1.0, n / 1e4] for n in lists}, 1)
    asked = make([(1000 + s,) for s in spokes], "node long")
    out = search(graph, 1, asked, width=1).filter("other = 0").collect()
    assert {r.node for r in out} == {1000 + s for s in spokes}


def test_recall_over_many_blocks_and_shares(make):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=64) + 0.04 * rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64))))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    nodes = make([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<float>")
    graph, shares = build_graph(nodes, len(x), rows=64, share=512)
    out = search(graph, shares, make([(i,) for i in range(0, 3000, 25)], "node long"))
    assert shares == 6
    got, hit = {}, 0
    for r in out.collect():
        got.setdefault(r.node, set()).add(r.other)
    for q in range(0, 3000, 25):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hit >= 0.95 * 20 * 120, hit / 20 / 120


def test_companies_of_a_hub_change_and_leave_nobody_out():
    nodes = np.arange(0, 30_000, 3)
    met = []
    for turn in range(6):
        parts = _companies(nodes, turn, 256)
        assert max(map(len, parts)) <= 256 and np.array_equal(np.sort(np.concatenate(parts)), np.arange(len(nodes)))
        met.append({int(i): n for n, part in enumerate(parts) for i in part})
    together = [sum(m[i] == m[i + 1] for m in met) for i in range(0, 9_000, 2)]
    assert 0 < np.mean(together) < 1 and max(together) < 6
    assert [len(p) for p in _companies(nodes[:256], 0, 256)] == [256]


def test_a_hub_costs_its_names_times_a_constant_and_near_names_meet(monkeypatch):
    rng, n, compared = np.random.default_rng(8), 2000, []
    x = rng.normal(size=(n, 16)).astype(np.float32)
    links = pd.DataFrame({
        "share": 0, "node": np.arange(n), "code": [v.tobytes() for v in x], "least": -np.inf,
        "at": [np.array([7]).tobytes()] * n, "fresh": [b"\0"] * n,
    })
    plain = _joined.__globals__["_products"]
    monkeypatch.setitem(_joined.__globals__, "_products", lambda a, b: compared.append(len(a) * len(b)) or plain(a, b))
    found = [_joined(links, 5, turn, 250) for turn in range(40)]
    assert sum(compared) <= 40 * n * 250
    got = pd.concat(found).groupby("node").other.agg(set)
    scores = plain(x, x)
    np.fill_diagonal(scores, -np.inf)
    assert np.mean([int(scores[i].argmax()) in got[i] for i in range(n)]) > 0.95


def lists(rng, shares=3, n=300, width=6):
    """A graph whose lists are drawn, some links fresh."""
    x = rng.normal(size=(n, 8)).astype(np.float32)
    near = np.array([rng.choice(np.delete(np.arange(n), i), width, replace=False) for i in range(n)])
    score = (x.astype(float)[:, None] * x[near]).sum(axis=2)
    by = np.argsort(-score, axis=1)
    near, score = np.take_along_axis(near, by, 1), np.take_along_axis(score, by, 1)
    fresh = rng.integers(0, 2, (n, width)).astype(np.uint8) * (rng.random(n) < 0.3).astype(np.uint8)[:, None]
    return [
        (i, i % shares, x[i].tobytes(), near[i].tobytes(), score[i].tobytes(), fresh[i].tobytes(), 0) for i in range(n)
    ]


def test_nothing_is_sent_inside_a_share_and_all_that_meet_are_compared(make):
    rows, width = lists(np.random.default_rng(9)), 6
    graph = make([(*r[:1], 0, *r[2:]) for r in rows], GRAPH)
    assert _links(graph, 1, width).count() == 0
    graph = make(rows, GRAPH)
    sent = _links(graph, 3, width)
    assert {(r.node % 3 == r.share) for r in sent.collect()} == {False}

    x = {r[0]: np.frombuffer(r[2], np.float32).astype(float) for r in rows}
    least = {r[0]: np.frombuffer(r[4])[-1] for r in rows}
    at = {i: {} for i in x}
    for r in rows:
        for o, f in zip(np.frombuffer(r[3], np.int64).tolist(), r[5], strict=True):
            at[r[0]][o] = at[r[0]].get(o, 0) | f
            at[o][r[0]] = at[o].get(r[0], 0) | f
    want = {}
    for met in at.values():
        for p in met:
            for o in met:
                if p != o and (met[p] or met[o]) and x[p] @ x[o] > least[p]:
                    want.setdefault(p, {})[o] = x[p] @ x[o]
    best = {p: set(sorted(found, key=lambda o: -found[o])[:width]) for p, found in want.items()}
    out = graph.groupBy("share").cogroup(sent.groupBy("share")).applyInPandas(
        lambda a, b: _compared(a, b, shares=3, width=width, turn=0), FOUND
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.node, {})[r.other] = r.score
        assert abs(r.score - want[r.node][r.other]) < 1e-9
    assert {p: set(sorted(found, key=lambda o: -found[o])[:width]) for p, found in got.items()} == best


def test_near_vectors_share_a_share_of_equal_size(make):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(20, 32))[rng.integers(0, 20, 4000)] + 0.4 * rng.normal(size=(4000, 32))
    nodes = make([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "node long, vector array<float>")
    rows = settle(nodes, 4000, 8).collect()
    assert len({r.node for r in rows}) == 4000
    home = {r.vector[0]: r.node % 8 for r in rows}
    home = np.array([home[v] for v in x[:, 0].astype(np.float32).tolist()])
    sizes = np.bincount(home, minlength=8)
    assert len(sizes) == 8 and sizes.min() > 400 and sizes.max() < 600
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1)[:, :20]
    together = np.mean(home[near] == home[:, None])
    assert together > 0.4, together


def test_a_share_settles_alone_and_its_links_abroad_stay_fresh():
    rng, width = np.random.default_rng(11), 6
    rows = pd.DataFrame(lists(rng, shares=4, width=width), columns=[c.split()[0] for c in GRAPH.split(", ")])
    rows["fresh"] = [b"\1" * width] * len(rows)
    x = np.stack([np.frombuffer(c, np.float32).astype(float) for c in rows.code])
    before = np.stack([np.frombuffer(b, np.int64) for b in rows.near])
    for share, graph in rows.groupby("share"):
        out = _settled(graph, 4, width, 0.0)
        assert out.node.tolist() == graph.node.tolist() and out.news.sum() == 0
        mine = graph.node.to_numpy()
        for r in out.itertuples():
            near, score, fresh = np.frombuffer(r.near, np.int64), np.frombuffer(r.score), np.frombuffer(r.fresh, np.uint8)
            np.testing.assert_allclose(score, x[near] @ x[r.node], rtol=1e-6)
            # Nothing from another share is found here, and what was listed gives way to nearer ones only.
            abroad = near % 4 != share
            assert set(near[abroad]) <= set(before[r.node]) and np.array_equal(fresh == 1, abroad)
            gone = np.setdiff1d(before[r.node], near)
            assert not len(gone) or (x[gone] @ x[r.node]).max() <= score[-1] + 1e-9
            assert set(near[~abroad]) <= set(mine)


def test_levels_join_shares_by_fours_until_all_are_one():
    share = np.arange(21)
    assert _together(share[:, None], share, 21, 0).sum() == 21
    assert [_together(np.int64(5), share, 21, 2).nonzero()[0].tolist()] == [[4, 5, 6, 7]]
    assert _together(share[:, None], share, 21, 6).all() and _together(share[:, None], share, 21, 62).all()


def test_finds_of_a_share_are_the_best_however_few_are_held(monkeypatch):
    rng, width = np.random.default_rng(12), 6
    rows = pd.DataFrame(lists(rng, shares=1, width=width), columns=[c.split()[0] for c in GRAPH.split(", ")])
    rows["fresh"] = [b"\1" * width] * len(rows)
    links = _kept(rows, 1, width)
    whole = _joined(links, width)
    compared = []
    plain = _joined.__globals__["_strongest"]
    monkeypatch.setitem(_joined.__globals__, "HELD", 50)
    monkeypatch.setitem(_joined.__globals__, "_strongest", lambda n, *a: compared.append(len(n)) or plain(n, *a))
    few = _joined(links, width)
    assert len(compared) > 2
    pd.testing.assert_frame_equal(whole, few)


def test_shares_return_few_finds_a_vector_and_level(make, monkeypatch):
    x = np.random.default_rng(13).normal(size=(2000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    nodes = make([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<float>")
    rows, plain = [], build_graph.__globals__["_own_share"]
    monkeypatch.setitem(
        build_graph.__globals__, "_own_share", lambda found, shares: rows.append(found.count()) or plain(found, shares)
    )
    for share, levels in ((2000, 0), (500, 1)):
        rows.clear()
        graph, shares = build_graph(nodes, len(x), rows=64, share=share)
        assert shares == 2000 // share
        # The first are those of the trees.
        assert sum(rows[1:]) <= 250 * levels * len(x), rows
        near = {r.node: np.frombuffer(r.near, np.int64)[:20] for r in graph.select("node", "near").collect()}
        scores = x.astype(float) @ x.astype(float).T
        np.fill_diagonal(scores, -np.inf)
        want = np.argsort(-scores, axis=1)[:, :20]
        assert np.mean([len(set(want[i]) & set(near[i].tolist())) / 20 for i in range(len(x))]) > 0.9
