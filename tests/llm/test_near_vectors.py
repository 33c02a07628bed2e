import numpy as np
from test_components import plain

from slicelens.llm.near_vectors import FOUND, collision, link_vectors, tables_for

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string"


def brute(rows):
    good = [(i, np.asarray(v, float), l) for i, v, l in rows
            if i is not None and l is not None and v is not None and None not in v
            and np.isfinite(np.asarray(v, float)).all() and np.any(v)]
    pairs = set()
    for x, (i, a, la) in enumerate(good):
        for j, b, lb in good[x + 1:]:
            if la == lb and len(a) == len(b) and i != j:
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    pairs.add((i, j))
    return pairs


def compare(make, rows, **limits):
    pairs, got = brute(rows), link_vectors(make([(*r, "x", "y") for r in rows], SCHEMA), **limits).collect()
    top = plain(pairs)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_links == len({p for p in pairs if r.vec_id in p}), r
        assert r.component_id == top.get(r.vec_id, r.vec_id)
        assert r.kept == (r.vec_id == r.component_id)
    return pairs


def test_against_brute_force(make):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(60):
        centre = rng.normal(size=16)
        for k in range(rng.integers(1, 6)):
            v = (centre + rng.normal(size=16) * rng.uniform(0.05, 0.4)).astype(np.float32)
            rows.append((len(rows), v.tolist(), int(c % 3)))
    nan, inf = float("nan"), float("inf")
    v = rows[0][1]
    rows += [(1000, None, 0), (1001, v, None), (1002, [0.0] * 16, 0), (1003, [nan] + v[1:], 0),
             (1004, [inf] + v[1:], 0), (1005, [None] + v[1:], 0), (1006, [], 0), (1007, v, rows[0][2]),
             (1008, v, rows[0][2]), (1009, [x * 1e30 for x in v], rows[0][2]), (1010, v[:8], rows[0][2])]
    assert len(compare(make, rows)) > 50


def test_group_of_near_copies_over_many_tiles(make):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.05).astype(np.float32).tolist(), 1) for i in range(150)]
    rows += [(200 + i, base.astype(np.float32).tolist(), 1) for i in range(60)]
    assert len(compare(make, rows, tile=20)) > 10_000


def test_empty_table_and_chances(make):
    assert link_vectors(make([], SCHEMA)).count() == 0
    for n in (1, 100, 10_000, 10**9):
        k, tables = tables_for(n)
        assert 1 - (1 - collision(np.sqrt(2 - 2 * 0.93)) ** k) ** tables >= FOUND


def test_extra_columns_and_labels_as_text(make):
    rows = [(1, [1.0, 0.0], "7", "a", "b"), (2, [0.99, 0.05], "7", "a", "b"), (3, [1.0, 0.0], "8", "a", "b")]
    docs = make(rows, "vec_id long, embedding array<float>, label string, bucket string, n string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    named = make([(r[0], r[1], "x" + r[2], "a", "b") for r in rows], docs.schema)
    assert {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(named).collect()} == got
