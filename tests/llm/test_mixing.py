import random

import pytest
from pyspark.sql import functions as F

from slicelens.llm.mixing import mix, mix_documents, targets

SCHEMA = "doc_id long, source string, text string, size string, copies string"


def shared(sizes):
    """Targets by the plain loop: share by weight, stop who is above, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, stopped, left = {}, set(), sum(sizes.values())
    while True:
        rest = sum(weight[s] for s in order if s not in stopped)
        out = {s: 3 * sizes[s] if s in stopped else weight[s] * left / rest for s in order}
        above = [s for s in order if s not in stopped and out[s] > 3 * sizes[s]]
        if not above:
            return out
        stopped |= set(above)
        left -= sum(3 * sizes[s] for s in above)


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 1000}, {None: 10, "": 500, "é": 3, "z": 90},
    {"a": 0, "b": 50}, {"one": 7}, {"a": 1, "b": 2, "c": 3, "d": 4, "e": 500},
])
def test_targets(make, sizes):
    rows = make([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(shared(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_targets_and_reruns_agree(make):
    rng = random.Random(1)
    rows = [
        (i, rng.choice(["a", "a", "a", "b", "c", None]), "w " * rng.randint(0, 30), "x", "y")
        for i in range(600)
    ]
    rows += [(None, "b", "only words", "", ""), (7000, "c", None, "", ""), (7001, "b", "", "", "")]
    docs = make(rows, SCHEMA)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.copies <= 3 for r in got)
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert sum(r.copies * r.size for r in own) == pytest.approx(own[0].target, abs=61)
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = mix_documents(docs)
    assert taken.columns == docs.columns
    counts = {r[0]: r[1] for r in taken.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in got if r.copies}


def test_repeated_rows_and_empty_table(make):
    docs = make([(1, "a", "x y z", "", "")] * 4 + [(2, "b", "x", "", "")], SCHEMA)
    got = mix(docs)
    assert got.count() == 5
    assert mix_documents(docs).count() == got.agg(F.sum("copies")).first()[0]
    assert mix(make([], SCHEMA)).count() == 0
    assert mix_documents(make([], SCHEMA)).count() == 0
    assert {r.copies for r in mix(make([(1, "a", None, "", "")], SCHEMA)).collect()} == {0}


def test_null_ids_and_a_very_long_text(make):
    rows = [(None, "a", f"text {i} " + "w " * (i % 4), "", "") for i in range(400)]
    rows += [(None, None, "same text", "", "")] * 50 + [(5, "b", "long " * 300_000, "", "")]
    docs = make(rows, SCHEMA)
    got = mix(docs)
    own = got.collect()
    assert len(own) == len(rows) and got.columns == ["doc_id", "source", "size", "source_size", "target", "copies"]
    for source in ("a", None):
        mine = [r for r in own if r.source == source]
        assert sum(r.copies * r.size for r in mine) == pytest.approx(mine[0].target, rel=0.02)
    taken = mix_documents(docs)
    counts = {r[0]: r[1] for r in taken.groupBy("text").count().collect()}
    assert sum(counts.values()) == sum(r.copies for r in own)
    assert all(n <= (150 if t == "same text" else 3) for t, n in counts.items())
