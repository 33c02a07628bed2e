import random
import re

import numpy as np
import pandas as pd
import pytest
from test_components import plain

from slicelens.llm import ngram_join
from slicelens.llm.ngram_join import Rule, jaccard_components
from slicelens.llm.words import pieces, shingle_sets

SCHEMA = "doc_id long, text string, id string, n string, component string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    edges = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1:]
             if s and t and den * len(s & t) >= num * len(s | t)]
    return plain(edges)


def compare(make, rows, k=4, num=85, den=100, **limits):
    docs = make([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = jaccard_components(docs, k, num, den, **limits).collect()
    top = brute(rows, k, num, den)
    want = sorted(((i, len(shingles(t, k)), top.get(i, i)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    return top


def texts(seed, n, words=400):
    """Near copies in chains and groups, a passage that many hold, and texts of few words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 150]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 8])):
            rows.append((len(rows), " ".join(base)))
            if rng.random() < 0.8 and len(base) > 5:
                base = base[:]
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    return rows


@pytest.mark.parametrize("limits", [{}, {"frequent": 3, "bits": 16, "tile": 8}])
def test_against_brute_force(make, limits):
    assert len(compare(make, texts(1, 250), **limits)) > 60
    compare(make, texts(2, 150), 5, 80, **limits)


def test_large_group_of_near_copies_and_a_chain(make):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        own = base[:]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    chain = [f"c{i}" for i in range(260)]
    rows += [(1000 - i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(40)]
    top = compare(make, rows, tile=32)
    assert {top[i] for i in range(150) if i in top} == {0}


def test_nulls_empty_ties_long_and_repeated(make):
    long = " ".join(f"l{i % 5000}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three four"),
            (7, "one\ntwo\x0bthree  four"), (8, long), (9, long + " end"), (10, long), (10, long),
            (None, "one two"), (11, "a b c d e f"), (11, "a b c d e f"), (12, "É b"), (13, "é b"),
            (14, "x" * 3_000_000)]
    top = compare(make, rows)
    assert top[5] == 4 and top[7] == 6 and top[9] == 8 == top[10] and 12 not in top
    assert jaccard_components(make([], SCHEMA)).count() == 0


def test_pieces_cut_no_word_and_lose_nothing():
    rng = random.Random(4)
    rows = [None, "", "x" * 50, *["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 200))) for _ in range(50)]]
    back = {}
    for owners, parts in pieces(rows, 16):
        for o, p in zip(owners, parts, strict=True):
            back[o] = back.get(o, "") + p
    assert [back[i] for i in range(len(rows))] == [t or "" for t in rows]
    assert [len(s) for s in shingle_sets(rows, 3)] == [len(shingles(t, 3)) for t in rows]


def entries(seed, rows, components):
    rng = np.random.default_rng(seed)
    n = rng.integers(100, 1200, rows)
    component = rng.integers(0, components, rows)
    return pd.DataFrame({
        "id": np.arange(rows), "n": n, "pos": (n * rng.uniform(0, 0.15, rows)).astype(int), "list": rng.integers(0, 3, rows),
        "component": component, "root": component, "apart": 0, "half": 0, "parity": [bytes(32)] * rows,
    })


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, 9).astype(np.uint64))))
        x, y = (np.frombuffer(ngram_join._parity(s), np.uint64) for s in (a, b))
        assert len(x) * 64 == ngram_join.PARITY
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert ngram_join._parity(a) == ngram_join._parity(a[::-1])


def test_ids_with_several_texts(make):
    rng = random.Random(12)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(12):
            own = base[:]
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(60)] = f"x{rng.random()}"
            rows.append((rng.randint(0, 70), " ".join(own)))
    compare(make, rows, tile=8)


@pytest.mark.parametrize("components", [1, 2, 7, 400])
def test_only_entries_of_different_components_are_paired(monkeypatch, components):
    rule, frame, paired = Rule(85, 100), entries(components, 400, components), []
    windows = ngram_join._windows

    def counted(*args):
        for i, j in windows(*args):
            paired.append(len(i))
            yield i, j

    monkeypatch.setattr(ngram_join, "_windows", counted)
    emit = lambda c, i, j, rule: pd.DataFrame({"a": c["id"][i], "b": c["id"][j]})
    out = ngram_join._met(frame.copy(), rule, emit)
    got = sorted(tuple(sorted(p)) for p in out.itertuples(index=False, name=None))
    f = {k: frame[k].to_numpy() for k in frame}
    i, j = np.triu_indices(len(frame), 1)
    reach = np.minimum(f["pos"][i], f["pos"][j]) + np.minimum(f["n"][i] - f["pos"][i], f["n"][j] - f["pos"][j])
    keep = (f["list"][i] == f["list"][j]) & (f["component"][i] != f["component"][j])
    keep &= reach >= rule.overlap(f["n"][i], f["n"][j])
    assert got == list(zip(i[keep].tolist(), j[keep].tolist(), strict=True))
    assert sum(paired) == len(got)


def test_tasks_follow_the_rows_of_tiles(make, monkeypatch):
    most = {}
    monkeypatch.setattr(ngram_join, "ENTRIES", 1000)
    by_task = ngram_join._by_task

    def seen(lists, size):
        out = by_task(lists, size)
        if "half" in lists.columns:
            most[len(most)] = max((r["count"] for r in out.count().collect()), default=0)
        return out

    monkeypatch.setattr(ngram_join, "_by_task", seen)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(200)]
    compare(make, rows, tile=8)
    assert most and max(most.values()) < 3000
