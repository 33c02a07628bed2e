import random

import pytest

from slicelens.llm.components import components


def plain(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 300)] + [(5, 5), (7, 3), (3, 7)],
    [(400 - i, 399 - i) for i in range(0, 300, 2)],
    [(random.Random(i).randint(0, 500), random.Random(-i).randint(0, 500)) for i in range(350)],
])
def test_smallest_id_reached(make, edges):
    got = components(make(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == plain(edges)
    assert len(got) == len(plain(edges))


def test_empty(make):
    assert components(make([], "a long, b long")).count() == 0
