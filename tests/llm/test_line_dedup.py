from slicelens.llm.line_dedup import boilerplate_lines, strip_boilerplate

SCHEMA = "doc_id long, source string, text string, cut string, id int, doc string"


def cleaned(make, rows, **limits):
    docs = make([(*r, "c", 1, "d") for r in rows], SCHEMA)
    out = strip_boilerplate(docs, **limits).select("doc.doc_id", "text", "n_lines", "n_removed", "doc.cut")
    assert {r.cut for r in out.collect()} <= {"c"}
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


def test_spread_lines_stay_once(make):
    rows = [(i, f"s{i}", f"own {i}\n  Menu \n\nlast {i}") for i in range(3)]
    rows += [(9, "s0", "Menu"), (10, "s9", "twice\ntwice"), (11, "s8", "twice")]
    assert cleaned(make, rows) == sorted([
        (0, "own 0\n  Menu \n\nlast 0", 3, 0), (1, "own 1\n\nlast 1", 3, 1), (2, "own 2\n\nlast 2", 3, 1),
        (9, "", 1, 1), (10, "twice\ntwice", 2, 0), (11, "twice", 1, 0),
    ], key=str)


def test_copies_on_one_site_are_no_boilerplate(make):
    rows = [(i, "hot", "the same line") for i in range(50)]
    assert all(r[3] == 0 for r in cleaned(make, rows))


def test_nulls_empty_long_and_repeated(make):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, "a", None), (2, None, ""), (3, "", "x y"), (None, "b", "x y"), (4, "c", "x y"),
            (5, "d", long), (5, "d", long), (6, "e", " \n\t\n")]
    got = cleaned(make, rows)
    assert (1, None, 0, 0) in got and (2, "", 0, 0) in got and (6, " \n\t\n", 0, 0) in got
    assert got.count((5, long, 20_000, 0)) == 2
    # The line stays with the smallest id; a row without id loses it.
    assert (3, "x y", 1, 0) in got and (4, "", 1, 1) in got and (None, "", 1, 1) in got
    assert cleaned(make, []) == []


def test_sketches_and_exact_counts_around_the_threshold(make):
    rows = [(d, f"s{d}", n) for n in range(80, 121) for d in range(n)]
    lines = make(rows, "doc_id long, site string, line long")
    got = {r.line for r in boilerplate_lines(lines, sites=100, lg_k=8).collect()}
    assert got == set(range(100, 121))
    assert {r.first for r in boilerplate_lines(lines, sites=100).collect()} == {0}
