import functools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slicelens.llm.sentencepiece import MODEL, Pieces, decoded, encode_checked, encoded, load

SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def best_score(coder, text):
    """The best score of any path, by plain recursion over ends."""
    raw = (" " + text).encode()
    by_text = {}
    for i, r in enumerate(coder.raw):
        if r and not coder.bytes_from <= i < coder.bytes_from + 256:
            by_text.setdefault(r, coder.score[i])
    longest = max(map(len, by_text))

    @functools.cache
    def upto(end):
        if not end:
            return 0.0
        scores = [upto(end - 1) + coder.byte_score]
        scores += [upto(end - n) + by_text[raw[end - n : end]]
                   for n in range(1, min(longest, end) + 1) if raw[end - n : end] in by_text]
        return max(scores)

    for end in range(len(raw)):
        upto(end)
    return upto(len(raw))


def path_score(coder, ids):
    lo = coder.bytes_from
    return sum(coder.byte_score if lo <= i < lo + 256 else coder.score[i] for i in ids)


ODD = ["hello world", "  two  spaces \n\n lines\t", "▁literal ▁▁ mark", "日本語 и ещё", "a" * 300, "\x00\x01",
       "😀é", " ", "\n", "The quick brown fox jumps over the lazy dog."]


@pytest.mark.parametrize("text", ODD)
def test_best_path_and_round_trip(text):
    coder = load(MODEL)
    (ids,) = coder.encode([text])
    assert coder.decode(ids) == text
    assert path_score(coder, ids) == pytest.approx(best_score(coder, text))


def test_long_units_take_the_same_path_as_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/日本語é"))
    texts = ["".join(rng.choice(letters, n)) for n in (5, 80, 600, 2000)] + ["a" * 700, "ab" * 400, "▁" * 50]
    coder = load(MODEL)
    coder._forget()
    together = coder.encode(texts)
    monkeypatch.setattr("slicelens.llm.sentencepiece.LONG", 3)
    coder._forget()
    for one, other, text in zip(together, coder.encode(texts), texts, strict=True):
        assert one.tolist() == other.tolist() and coder.decode(other) == text
    coder._forget()


def test_a_megabyte_without_a_blank(monkeypatch):
    import time

    coder = load(MODEL)
    text = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz0123456789日"), 1 << 20))
    begun = time.monotonic()
    (ids,) = coder.encode([text])
    assert time.monotonic() - begun < 60 and coder.decode(ids) == text
    # What was solved is forgotten by bytes, not by units.
    coder.encode(["x" * (3 << 20)])
    coder.encode(["y"])
    assert coder.held < 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab▁ \ncé", max_size=12), max_size=6))
def test_small_vocabulary(texts):
    pieces = [None, *[f"<{i}>" for i in range(256)], "▁a", "▁", "▁▁", "ab", "b", "a", "abc", "c", "bca"]
    coder = Pieces(pieces, 1)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert coder.decode(ids) == text
        if text:
            assert path_score(coder, ids) == pytest.approx(best_score(coder, text))
        else:
            assert len(ids) == 0


def test_whole_tables(make, spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = encode_checked(docs)
    assert out.filter("restored AND n_tokens = size(ids)").count() == docs.count()


def test_nulls_empty_long_and_repeated(make):
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (4, "two words " * 100_000), (4, "same"), (4, "same"), (None, "no id")]
    docs = make([(*r, "i", "n") for r in rows], SCHEMA)
    out = encode_checked(docs).collect()
    assert len(out) == len(rows) and all(r.restored for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].ids == by[2].ids == [] and out[4].ids == out[5].ids
    assert encode_checked(make([], SCHEMA)).count() == 0
    back = docs.select("text", decoded(encoded(F.col("text"))).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_same_ids_whatever_was_solved_before():
    coder = load(MODEL)
    first = coder.encode(ODD)
    coder._forget()
    for a, b in zip(first, reversed([coder.encode([t])[0] for t in reversed(ODD)]), strict=True):
        np.testing.assert_array_equal(a, b)
