"""The pipeline against plain Python, stage by stage."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_components import plain
from test_ngram_join import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, _score string"


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notice = prose(55)
    rows = []
    for i in range(240):
        lines = [prose(rng.randint(8, 25)) for _ in range(rng.randint(1, 4))]
        if i % 6 == 0:
            lines.insert(1, notice)
        if i % 8 == 0:
            lines.append("idiot scum " * 4)
        rows.append([i, "\n".join(lines), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}"])
    for i in range(240, 270):  # copies and near copies of earlier documents, one site each
        text, source = rows[i - 200][1], rows[i - 200][3]
        rows.append([i, text if i % 2 else text + " more", "en", source])
    rows += [[300, None, None, None], [301, "", "", ""], [None, prose(30), "en", "s1"], [302, prose(30), "de", "s2"]]
    rows.append(rows[-1])
    return [(*r, len(r[1] or ""), "d", "x") for r in rows]


def test_stages(spark, make, tmp_path):
    rows = corpus()
    make(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(r[0] % 8 == 0)) for r in rows if r[0] is not None and r[0] < 200]
    make(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            assert {(r["doc"], r["_score"]) for r in kept[name]} == {("d", "x")}

    clean = [r for r in rows if "idiot" not in (r[1] or "")]
    stays = sorted(str(r.doc_id) for r in kept["toxicity"])
    assert [i for i in stays if i in {str(r[0]) for r in clean}] == sorted(str(r[0]) for r in clean)
    # A handful of labels cannot teach it every toxic text.
    assert len(stays) - len(clean) <= 0.2 * (len(rows) - len(clean))

    sites, first = {}, {}
    for r in kept["toxicity"]:
        for line in {x.strip(" \t\r\f\v") for x in (r.text or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(r.source or "")
            if r.doc_id is not None:
                first[line] = min(first.get(line, r.doc_id), r.doc_id)
    cut = {x for x, s in sites.items() if len(s) >= 3}
    assert cut
    want = []
    for r in kept["toxicity"]:
        stays = [x for x in (r.text or "").split("\n")
                 if x.strip(" \t\r\f\v") not in cut or first[x.strip(" \t\r\f\v")] == r.doc_id]
        if any(x.strip() for x in stays) or not (r.text or "").strip():
            want.append((r.doc_id, None if r.text is None else "\n".join(stays)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in kept["line_dedup"])
    assert all(r.n_chars == len(r.text or "") for r in kept["line_dedup"])

    sets = [(r.doc_id, shingles(r.text, 5)) for r in kept["line_dedup"] if r.doc_id is not None]
    top = plain([(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :]
                 if s and t and 100 * len(s & t) >= 80 * len(s | t)])
    want = {i for i, _ in sets if top.get(i, i) == i} | {None}
    assert sorted(map(str, (r.doc_id for r in kept["near_dedup"]))) == sorted(map(str, want))
    assert len(want) < len({i for i, _ in sets})

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in kept["near_dedup"]}
    taken = sum(size[r.doc_id] for r in kept["mixing"])
    assert sum(size.values()) - 120 < taken <= sum(size.values())
    counts = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= counts <= 3

    assert len(kept["sentencepiece"]) == len(kept["mixing"])
    assert all(r.restored for r in kept["sentencepiece"])


def test_empty_tables(spark, make, tmp_path):
    make([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    make([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_other_texts_of_an_id(spark, make):
    rows = [(1, "a b c d e f g h", "en", "s2", 15), (1, "a b c d e f g h", "en", "s1", 15),
            (1, "another text that has nothing in common", "en", "s1", 39), (None, "x", None, None, 1),
            (2, "a b c d e f g h", "en", "s1", 15)]
    docs = make(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)
    again = corpus_pipeline.near_dedup(spark, docs.repartition(5, "source"), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_stages_are_removed(spark, monkeypatch, tmp_path, make):
    names = []
    docs = make([(i, f"t{i}", "en", "s", 2) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def plain(spark, docs, sf_dir):
        names.append(docs.inputFiles()[0])
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", plain), ("two", plain), ("three", plain)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(names[1]).getFileSystem(spark._jsc.hadoopConfiguration())
    assert [store.exists(path(n)) for n in names] == [True, False, False]
    assert store.exists(path(out.inputFiles()[0]))
