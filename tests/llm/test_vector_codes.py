import hashlib
from collections import defaultdict

import numpy as np
import pytest

from slicelens.llm.vector_codes import (
    CHILD, CHILDREN, HI, LO, SQUARE, assigned, compress_vectors, cover_tree, distances,
)

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error string"


def by_hand(rows):
    """Codes by plain loops over Python integers, for rows of (vec_id, vector, label)."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(4096 * x)) for x in r[1]] for r in good]
    width = len(vectors[0]) // 8
    cut = [[tuple(v[p * width : (p + 1) * width]) for v in vectors] for p in range(8)]
    books = [[part[i] for i in range(min(16, len(vectors)))] for part in cut]

    def away(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(x, book):
        return min(range(len(book)), key=lambda e: (away(x, book[e]), e))

    for _ in range(6):
        for p in range(8):
            groups = defaultdict(list)
            for x in cut[p]:
                groups[nearest(x, books[p])].append(x)
            for e, members in groups.items():
                books[p][e] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], defaultdict(int)
    for i, r in enumerate(good):
        codes = [nearest(cut[p][i], books[p]) for p in range(8)]
        error = sum(away(cut[p][i], books[p][codes[p]]) for p in range(8))
        totals[r[2]] += error
        out.append((r[0], "".join(f"{c:02x}" for c in codes), error, r[2]))
    return sorted(((k, c, e, totals[label], sha) for k, c, e, label in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return [
        (i, [float(x) for x in centres[rng.integers(20)] + spread * rng.normal(size=dim)], rng.choice(["a", "b", None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("n,dim,spread", [(400, 16, 0.1), (300, 64, 1.0), (250, 8, 0.3), (10, 24, 1.0), (1, 8, 1.0)])
def test_agrees_with_plain_loops(make, n, dim, spread):
    rows = table(n, dim, n, spread)
    rows += rows[:5]  # repeated rows
    rows += [(None, [0.25] * dim, "a"), (1000, [0.0] * dim, None), (1001, [-1e-9] * dim, "b")]
    rows += [(1002, None, "a"), (1003, [None] * dim, "a"), (1004, [float("nan")] * dim, "b"),
             (1005, [float("inf")] * dim, None)]
    df = compress_vectors(make([(*r, "x", "y") for r in rows], SCHEMA))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(df) == by_hand(rows)


def test_ties_and_copies(make):
    rows = [(i, [float(i % 3)] * 8, "a") for i in range(200)]
    assert got(compress_vectors(make([(*r, "", "") for r in rows], SCHEMA))) == by_hand(rows)


def test_partitions_and_blocks_do_not_matter(make, monkeypatch):
    rows = table(500, 16, 3, 0.2)
    df = make([(*r, "", "") for r in rows], SCHEMA)
    want = by_hand(rows)
    for parts in (1, 9):
        assert got(compress_vectors(df.repartition(parts))) == want


def test_empty_and_unusable(make):
    assert got(compress_vectors(make([], SCHEMA))) == []
    assert got(compress_vectors(make([(1, None, "a", "", ""), (2, [None], "a", "", "")], SCHEMA))) == []
    for vector in ([1.0] * 9, [], [1e9] * 8):
        with pytest.raises(ValueError, match="want"):
            compress_vectors(make([(1, vector, "a", "", "")], SCHEMA))
    with pytest.raises(ValueError, match="want one length"):
        compress_vectors(make([(1, [1.0] * 8, "a", "", ""), (2, [1.0] * 16, "a", "", "")], SCHEMA))


@pytest.mark.parametrize("shape", ["cloud", "copies", "line"])
def test_cover_tree_covers_and_separates(shape):
    rng = np.random.default_rng(5)
    points = {
        "cloud": rng.integers(-4096, 4096, (3000, 4)),
        "copies": np.repeat(rng.integers(-9, 9, (40, 4)), 50, axis=0),
        "line": np.stack([np.arange(2000)] * 4, axis=1) ** 2,
    }[shape]
    order, nodes = cover_tree(points, leaf=8)
    assert sorted(order) == list(range(len(points)))
    x = points[order]
    for node in nodes:
        away = ((x[node[LO] : node[HI]] - x[node[LO]]) ** 2).sum(axis=1)
        assert away.max() == node[SQUARE]
        children = nodes[node[CHILD] : node[CHILD] + node[CHILDREN]]
        if len(children):
            assert [c[LO] for c in children] == [node[LO], *[c[HI] for c in children[:-1]]]
            assert children[-1][HI] == node[HI] and children[0][LO] == node[LO]
            assert all(4 * c[SQUARE] <= node[SQUARE] for c in children)
            centres = x[[c[LO] for c in children]]
            gaps = distances(centres, centres) + np.eye(len(centres), dtype=np.int64) * (1 << 60)
            assert 4 * gaps.min() > node[SQUARE]
        elif node[SQUARE]:
            assert node[HI] - node[LO] <= 8


def test_whole_runs_are_assigned():
    rng = np.random.default_rng(9)
    entries = rng.integers(-4000, 4000, (16, 4))
    points = entries[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 4))
    order, nodes = cover_tree(points)
    x = points[order]
    found, steps = np.full(len(x), -1), 0
    for lo, hi, entry in assigned(x, nodes, entries):
        steps += len(lo)
        for a, b, e in zip(lo, hi, entry, strict=True):
            assert (found[a:b] == -1).all()
            found[a:b] = e
    assert (found == distances(x, entries).argmin(axis=1)).all()
    assert steps < len(x) / 5  # most points went with their run
