import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelens.llm.fill_middle import SkipList, fill_in_middle, line_widths, restored

SCHEMA = "doc_id long, text string, form string, n string"


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def turned(key, text, rate=100, first=50):
    """The same, by lists of lines."""
    units = lines(text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [1, 2, 4, 5, 17, 1000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 50, n)
    units = SkipList(widths)
    before = np.concatenate(([0], np.cumsum(widths)))
    assert [units.points_before(r) for r in range(n + 1)] == before.tolist()
    assert all(lane[1].sum() == n and lane[2].sum() == widths.sum() for lane in units.lanes)
    assert n < 100 or len(units.lanes) > 2


@pytest.mark.parametrize("text", ["a", "\n", "a\n", "\n\n", "a\nb", "é\r\n漢😀\n", "a\n\nb\n\n"])
def test_lines(text):
    assert line_widths(text).tolist() == [len(u) for u in lines(text)]


TEXTS = [
    None, "", " ", "\n", "one line", "a\nb\n", "a\n\n\nb", "é\n漢😀\nx", "has <P> in\nit", "<S>", "x<M>\ny",
    "<P\n>\n<\nS>", "P>\nends with <\nS>", "\r\n\r\n", "same\nsame\n", "same\nsame\n",
    "".join(f"line {i} of a very long text\n" for i in range(40_000)), "w" * 300_000,
]


@pytest.mark.parametrize("rate,first", [(100, 50), (40, 100)])
def test_agrees_with_lists_and_restores(make, rate, first):
    rng = random.Random(rate)
    texts = TEXTS + ["\n".join("ab é"[: rng.randint(0, 4)] for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = [(i, t, "theirs", "n") for i, t in enumerate(texts)] + [(None, "no\nid\n", None, None)] * 2
    got = fill_in_middle(make(rows, SCHEMA), rate=rate, suffix_first=first)
    assert got.columns == ["doc", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(back) == len(rows)
    for r in back:
        want = turned(r.doc.doc_id, r.doc.text or "", rate, first)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.back == (r.doc.text or "")
    assert {r.form for r in back} >= {"plain", "spm"}
    assert sorted(str(r.doc) for r in back) == sorted(str(r) for r in make(rows, SCHEMA).collect())


def test_empty_table(make):
    assert fill_in_middle(make([], SCHEMA)).collect() == []
