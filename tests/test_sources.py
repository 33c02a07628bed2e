import os
from dataclasses import replace

import pytest
from brute import capture_windows
from pyspark.sql import functions as F

from slicelens.operators import packets as P
from slicelens.operators import summaries
from slicelens.operators import windows as W
from slicelens.settings import BY_STEM, FEATURES, LABEL, TREE
from slicelens.sources import captures, sinks, synthetic, tabular

HEADER = "No., Time ,Source,Destination,Protocol, Length,Info"


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def row(no, second, source="10.0.0.1", length="100", info="1 > 2"):
    clock = f"2022-09-27 13:08:{int(second):02d}.{round(second % 1 * 1e6):06d}"
    return f'{no},{clock},{source},8.8.8.8,TCP,{length},"{info}"'


def lines(times, **kw):
    return [row(i + 1, t, **kw) for i, t in enumerate(times)]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    steady = [i * 0.2 for i in range(24)]
    rows = lines(steady)
    rows[3] = rows[3].replace("2022-09-27", "n/a")
    rows[5] = rows[5].replace(",100,", ",?,")
    rows[7] = rows[7].replace("1 > 2", 'a ""quoted"" comma, here')
    put(root, "Game-Streaming/Cloud Play/a.csv", "\n".join([HEADER, *rows]))
    late = [5.0, 4.0] + [5 + i * 0.2 for i in range(1, 20)]
    put(root, "Game_Streaming/Box/late_start.CSV", "\n".join([HEADER, *lines(late)]))
    put(root, "Metaverse/R/nine.csv", "\n".join([HEADER, *lines([i * 0.3 for i in range(9)])]))
    put(root, "Metaverse/R/ten.csv", "\n".join([HEADER, *lines([i * 0.3 for i in range(10)])]))
    put(root, "Metaverse/R/ten.txt", "\n".join([HEADER, *lines(steady)]))
    swapped = [",".join(reversed(r.split(",")[:6])) for r in lines(steady, source="9.9.9.9")]
    put(root, "Live_Streaming/N/down.csv", "\n".join([",".join(reversed(HEADER.split(",")[:6])), *swapped]))
    put(root, "Stored_Streaming/A/nohdr.csv", "\n".join(["No.,Time,Length", "1,2,3"]))
    put(root, "Stored_Streaming/A/empty.csv", "")
    put(root, "Stored_Streaming/A/wide.csv", "\n".join([HEADER, *lines(steady), row(99, 5.0) + ",x,y"]))
    put(root, "Other/x/c.csv", "\n".join([HEADER, *lines(steady)]))
    put(root, "top.csv", "\n".join([HEADER, *lines(steady)]))
    return root


def test_files_and_keys(spark, tree):
    files = captures.capture_files(spark, tree).collect()
    found = {(r["category"], r["app"], r["path"].rsplit("/", 1)[1]): r["usable"] for r in files}
    assert found == {
        ("game_streaming", "Cloud Play", "a.csv"): True,
        ("game_streaming", "Box", "late_start.CSV"): True,
        ("metaverse", "R", "nine.csv"): True,
        ("metaverse", "R", "ten.csv"): True,
        ("live_streaming", "N", "down.csv"): True,
        ("stored_streaming", "A", "nohdr.csv"): False,
        ("stored_streaming", "A", "wide.csv"): True,
    }


def features(spark, tree):
    files = captures.capture_files(spark, tree)
    raw = captures.scan_capture_tree(spark, tree, files)
    return files, W.window_features(P.typed_packets(raw, (LABEL,)), TREE)


def test_tree_to_features(spark, tree):
    found = {}
    files, windows = features(spark, tree)
    for r in captures.with_capture_names(windows, files).collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], {})[r["k"]] = tuple(r[c] for c in FEATURES)
    steady = [
        dict(pkt_no=i, us=i * 200_000, len=100.0, uplink=True) for i in range(24)
    ]
    changed = [dict(p, len=0.0 if p["pkt_no"] == 5 else 100.0) for p in steady if p["pkt_no"] != 3]
    late = [5_000_000, 4_000_000] + [5_000_000 + i * 200_000 for i in range(1, 20)]
    want = {
        "a.csv": capture_windows(changed, TREE),
        "late_start.CSV": capture_windows(
            [dict(pkt_no=i, us=t, len=100.0, uplink=True) for i, t in enumerate(late)], TREE
        ),
        "ten.csv": capture_windows(
            [dict(pkt_no=i, us=i * 300_000, len=100.0, uplink=True) for i in range(10)], TREE
        ),
        "down.csv": capture_windows([dict(p, uplink=False) for p in steady], TREE),
    }
    assert found.keys() == want.keys()
    for name in want:
        assert found[name].keys() == want[name].keys(), name
        for k in want[name]:
            assert found[name][k] == pytest.approx(want[name][k], rel=1e-9, abs=1e-6)


def test_quoted_text_is_kept(spark, tree):
    raw = captures.scan_capture_tree(spark, tree, captures.capture_files(spark, tree))
    assert raw.filter(F.col("Info") == 'a "quoted" comma, here').count() == 1


def test_apps_without_windows_are_listed(spark, tree):
    rows = summaries.load_summary(*features(spark, tree)).collect()
    shown = {r["app"]: (r["files"], r["files_used"], r["windows"] > 0) for r in rows}
    assert shown == {"Cloud Play": (1, 1, True), "Box": (1, 1, True), "R": (2, 1, True),
                     "N": (1, 1, True), "A": (2, 0, False)}


@pytest.fixture(scope="module")
def stems(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stems"))
    steady = [i * 0.1 for i in range(40)]
    put(root, "zoom.csv", "\n".join(["Time_S, PKT_LEN ,dport"] + [f"{t:.6f},{50 + i},{443 if i % 2 else 5000}" for i, t in enumerate(steady)]))
    put(root, "sub/Zoom.csv", "time,length\n1,1")
    put(root, "b/zepeto.csv", "\n".join(["timestamp,note,len"] + [f"{100 + t:.6f},x,{i}" for i, t in enumerate(steady)]))
    put(root, "c/Zepeto.csv", "time,length\n1,1")
    put(root, "Roblox.csv", "when,length\n1,2")
    put(root, "b/YOUTUBE.csv", "time,length\n1,1")
    put(root, "b/deep/MSteams.csv", "time,length\n1,1")
    rows = [f"{t:.6f},60,{'' if i == 2 else 80}" for i, t in enumerate(steady)]
    put(root, "MOBILEGAME.csv", "\n".join(["time,length,dst port", *rows]))
    return root


def test_stem_search_order(spark, stems):
    rows = captures.find_stems(captures.list_files(spark, stems), stems).collect()
    found = {r["stem"]: r["path"] and r["path"].split(stems + "/")[1] for r in rows}
    assert len(found) == 10
    assert {s: p for s, p in found.items() if p} == {
        "Zoom": "zoom.csv", "Zepeto": "b/zepeto.csv", "Roblox": "Roblox.csv",
        "Mobilegame": "MOBILEGAME.csv",
    }


def test_stems_to_features(spark, stems):
    raw = captures.scan_by_stem(spark, stems)
    typed = P.typed_port_packets(raw, (LABEL,))
    spec = replace(BY_STEM, cap=400)
    found = {}
    for r in W.window_features(typed, spec).collect():
        found.setdefault(r["capture_id"], {})[r["k"]] = tuple(r[c] for c in FEATURES)
    times = [i * 100_000 for i in range(40)]
    want = {
        "Zoom": [dict(pkt_no=i, us=t, len=50.0 + i, uplink=bool(i % 2)) for i, t in enumerate(times)],
        "Zepeto": [dict(pkt_no=i, us=t, len=float(i), uplink=None) for i, t in enumerate(times)],
        "Mobilegame": [dict(pkt_no=i, us=t, len=60.0, uplink=True) for i, t in enumerate(times) if i != 2],
    }
    assert found.keys() == want.keys()
    for stem, packets in want.items():
        expected = capture_windows(packets, spec)
        assert found[stem].keys() == expected.keys()
        for k, values in expected.items():
            assert found[stem][k] == pytest.approx(values, rel=1e-6, abs=1e-3)


def test_no_stem_found(spark, tmp_path):
    put(str(tmp_path), "x.csv", "time,length\n1,2")
    with pytest.raises(FileNotFoundError):
        captures.scan_by_stem(spark, str(tmp_path))


def test_tabular(spark, tmp_path):
    put(str(tmp_path), "t.csv", "a,b,label\n1,x,0\n2.5,y,1\n")
    df = tabular.scan_tabular_csv(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["double", "string", "int"]
    fixed = tabular.scan_tabular_csv(spark, str(tmp_path / "t.csv"), "a string, b string, label string")
    assert [t for _, t in fixed.dtypes] == ["string"] * 3


def test_fallback(spark):
    two = synthetic.synthetic_rows(spark.range(90), F.pmod("id", F.lit(2)).cast("bigint"))
    made, used = synthetic.or_synthetic(two, 1200)
    assert used and {r["count"] for r in made.groupBy(LABEL).count().collect()} == {400}
    three = synthetic.synthetic_rows(spark.range(90), F.pmod("id", F.lit(3)).cast("bigint"))
    assert synthetic.or_synthetic(three, 1200) == (three, False)


def test_synthetic_moments(spark):
    rows = synthetic.synthetic_rows(spark.range(6000), F.pmod("id", F.lit(3)).cast("bigint"))
    stats = {r[LABEL]: r for r in rows.groupBy(LABEL).agg(
        F.avg("throughput_kbps").alias("m"), F.stddev("throughput_kbps").alias("s"),
        F.min("throughput_kbps").alias("lo")).collect()}
    assert stats[0]["m"] == pytest.approx(14000, rel=0.03)
    assert stats[1]["s"] == pytest.approx(1200, rel=0.06)
    assert all(r["lo"] >= 1.0 for r in stats.values())


def test_report_is_committed_as_a_whole(spark, tmp_path):
    place = str(tmp_path / "report")
    assert sinks.read_report(spark, place) == {}
    paths = sinks.write_report({"a": spark.range(3), "b": spark.range(5)}, place)
    assert spark.read.parquet(paths["b"]).count() == 5
    fails = spark.range(4).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_report({"a": spark.range(9), "b": fails}, place)
    assert {n: df.count() for n, df in sinks.read_report(spark, place).items()} == {"a": 3, "b": 5}
    sinks.write_report({"b": spark.range(2)}, place)
    assert {n: df.count() for n, df in sinks.read_report(spark, place).items()} == {"b": 2}
    kept = [n for n in os.listdir(place) if n.startswith("version-")]
    assert len(kept) == 1


def test_one_layout_reads_only_its_columns(spark, tmp_path):
    put(str(tmp_path), "Metaverse/R/a.csv", "\n".join([HEADER, *lines([i * 0.3 for i in range(12)])]))
    put(str(tmp_path), "Metaverse/R/b.csv", "\n".join([HEADER, *lines([i * 0.3 for i in range(9)])]))
    files = captures.capture_files(spark, str(tmp_path))
    raw = captures.scan_capture_tree(spark, str(tmp_path), files)
    assert raw.count() == 21 and raw.filter("broken").count() == 0
    plan = P.typed_packets(raw)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c1:string,c2:string,c5:string,c7:string>" in plan


def test_long_headers_and_repeatable_ids(spark, tmp_path):
    wide = ",".join(["Time", *[f"column{i}" for i in range(9000)], "Length", "Source", "Destination"])
    assert len(wide) > 90_000
    put(tmp_path / "wide", "Metaverse/Roblox/a.csv", wide + "\n")
    files = captures.capture_files(spark, str(tmp_path / "wide")).collect()
    assert [(len(f.header), f.usable) for f in files] == [(9004, True)]
    for root in ("one", "two"):
        for name in "abcdefg":
            put(tmp_path / root, f"Metaverse/Roblox/{name}.csv", "Time,Length,Source,Destination\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        ids = []
        for root, cost in (("one", "1"), ("one", "200m"), ("two", before)):
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            rows = captures.capture_files(spark, str(tmp_path / root)).collect()
            ids.append({f.path.rsplit("/", 1)[1]: f.capture_id for f in rows})
        assert ids[0] == ids[1] == ids[2] and len(ids[0]) == 7
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def scanned(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("layouts", [1, 2])
def test_raw_text_is_not_shuffled(spark, tmp_path, layouts):
    rows = lines([i * 0.3 for i in range(12)])
    for name in "abc":
        put(str(tmp_path), f"Metaverse/R/{name}.csv", "\n".join([HEADER, *rows]))
    put(str(tmp_path), "Metaverse/R/nohdr.csv", "No.,Time,Length\n1,2,3")
    if layouts == 2:
        swapped = [",".join(reversed(r.split(",")[:6])) for r in rows]
        put(str(tmp_path), "Live_Streaming/N/d.csv", "\n".join([",".join(reversed(HEADER.split(",")[:6])), *swapped]))
    raw = captures.scan_capture_tree(spark, str(tmp_path), captures.capture_files(spark, str(tmp_path)))
    shown = scanned(raw)
    assert "Exchange hashpartitioning" not in shown and "SortMergeJoin" not in shown
    assert raw.count() == 36 + 12 * (layouts - 1)
    assert {r[0] for r in raw.select("Time").distinct().collect()} == {r.split(",")[1] for r in rows}


def test_unmapped_files_are_not_in_the_scan(spark, tree):
    files = captures.capture_files(spark, tree)
    raw = captures.scan_capture_tree(spark, tree, files)
    opened = {f.split(tree + "/")[1].split("/")[0] for f in raw.inputFiles() if tree in f}
    assert opened == {"Game-Streaming", "Game_Streaming", "Metaverse", "Live_Streaming", "Stored_Streaming"}
    listed = captures.list_files(spark, captures.mapped_folders(spark, tree))
    assert not [r.path for r in listed.collect() if "/Other/" in r.path or r.path.endswith("/top.csv")]


def test_unreadable_unmapped_file_does_no_harm(spark, tmp_path):
    put(str(tmp_path), "Metaverse/R/a.csv", "\n".join([HEADER, *lines([i * 0.3 for i in range(12)])]))
    put(str(tmp_path), "Secret/R/a.csv", "x")
    os.chmod(tmp_path / "Secret", 0)
    try:
        root = str(tmp_path)
        assert captures.scan_capture_tree(spark, root, captures.capture_files(spark, root)).count() == 12
    finally:
        os.chmod(tmp_path / "Secret", 0o755)


def test_odd_folder_names(spark, tmp_path):
    root = str(tmp_path / "a [b] 100% + c" / "data")
    put(root, "category=Metaverse/App {1} +%41/x y.csv", "\n".join([HEADER, *lines([i * 0.3 for i in range(12)])]))
    files = captures.capture_files(spark, root).collect()
    assert [(f.category, f.app, f.usable) for f in files] == [("metaverse", "App {1} +%41", True)]
    raw = captures.scan_capture_tree(spark, root, captures.capture_files(spark, root))
    assert {(r.capture_id, r[LABEL]) for r in raw.collect()} == {(files[0].capture_id, 2)}


def test_tree_without_mapped_folders(spark, tmp_path):
    put(str(tmp_path), "Other/R/a.csv", HEADER)
    files = captures.capture_files(spark, str(tmp_path))
    assert files.count() == 0
    with pytest.raises(FileNotFoundError):
        captures.scan_capture_tree(spark, str(tmp_path), files)


def test_listing_does_not_start_a_task_for_every_folder(spark, tmp_path):
    root = str(tmp_path)
    for i in range(300):
        put(root, f"Metaverse/app{i}/a.csv", HEADER + "\n" + row(1, 0.5))
    before = spark.conf.get(captures.LISTING, None)
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        files = captures.capture_files(spark, root)
        raw = captures.scan_capture_tree(spark, root, files)
        jobs = context.statusTracker().getJobIdsForGroup("listing")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert tasks and max(tasks) <= captures.few_tasks(spark) < 300
    assert spark.conf.get(captures.LISTING, None) == before
    assert files.filter("usable").count() == raw.count() == 300


def test_listing_keeps_a_setting_of_its_own(spark, tmp_path):
    put(str(tmp_path), "Metaverse/R/a.csv", HEADER)
    spark.conf.set(captures.LISTING, "3")
    try:
        assert captures.list_files(spark, str(tmp_path)).count() == 1
        assert spark.conf.get(captures.LISTING) == "3"
    finally:
        spark.conf.unset(captures.LISTING)


def test_capture_files_hold_what_sparks_writer_writes(spark, tmp_path):
    cells = ['a "quoted" one', "with, comma", "", None, "  blanks  ", "plain", "back\\slash", "é→"]
    rows = [
        (i, cells[i % 8], None if i % 5 == 0 else i / 4, (None, "", "k1", "k2")[i % 4], i % 3 if i % 7 else None)
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "`No ` int, text string, x double, top string, app int")
    df = df.unionAll(df.filter("app = 1"))
    ours, theirs = f"{tmp_path}/ours", f"{tmp_path}/theirs"
    captures.write_capture_files(df, ours, ["top", "app"], [F.desc("No ")])
    df.repartition("top", "app").write.partitionBy("top", "app").option("header", True).option("escape", '"').csv(theirs)

    def found(root):
        read = spark.read.option("header", True).option("escape", '"').csv(root)
        return sorted(tuple(str(c) for c in r) for r in read.collect())

    def folders(root):
        return sorted(p.removeprefix(root) for p, _, names in os.walk(root) if any(n.endswith(".csv") for n in names))

    assert found(ours) == found(theirs) and len(found(ours)) == df.count()
    assert folders(ours) == folders(theirs)
    names = [n for _, _, inside in os.walk(ours) for n in inside]
    assert set(names) == {"part.csv"} and len(names) == len(folders(ours))
    with open(f"{ours}/top=k1/app=1/part.csv", encoding="utf-8") as f:
        numbers = [int(text.split(",")[0]) for text in f.read().splitlines()[1:]]
    assert numbers == sorted(numbers, reverse=True) and len(numbers) > 20


def test_capture_files_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "a string, app bigint")
    captures.write_capture_files(df, f"{tmp_path}/none", ["app"])
    assert captures.list_files(spark, f"{tmp_path}/none").count() == 0


def test_long_capture_spans_batches(spark, tmp_path):
    df = spark.range(25_000, numPartitions=3).select(F.col("id").alias("n"), F.lit(7).alias("app"))
    captures.write_capture_files(df, str(tmp_path), ["app"], ["n"])
    with open(tmp_path / "app=7" / "part.csv") as f:
        assert f.read().split() == ["n", *map(str, range(25_000))]
