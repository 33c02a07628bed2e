"""Reading trees and folders of packet-capture CSV files.

Only mapped folders are opened, in one scan with positional text columns. A
file's header, fetched once per file from its first bytes, says which position
holds what. The keys of a row come from its path by expression, so raw text is
never shuffled: only the files that differ from the usual layout, or cannot be
used, are looked up.
"""

from __future__ import annotations

import contextlib
import csv
import io
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelens.functions.text import category_key
from slicelens.operators.joins import attach, stage
from slicelens.settings import (
    CATEGORY_SLICES,
    COLUMN_ALIASES,
    LABEL,
    REQUIRED_COLUMNS,
    STEM_SLICES,
)

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
GLOB = r"([\\{}\[\]*?])"
HEADER_STEP = 1 << 16
OPEN_FILES = 8
CORE_TASKS = 4
ROW_BITS = (1 << 33) - 1
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
CAPTURE_COLUMNS = ("Time", "Source", "Destination", "Protocol", "Length", "Info")


def mapped_folders(spark: SparkSession, root: str) -> list[str]:
    """The top folders of ``root`` whose name stands for a known category.

    One listing of ``root`` itself; no other folder is opened.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in store.listStatus(top):
        name = re.sub("^[^=]+=", "", status.getPath().getName())
        if status.isDirectory() and name.lower().replace("-", "_") in CATEGORY_SLICES:
            found.append(re.sub(GLOB, r"\\\1", status.getPath().toString()))
    return sorted(found)


def few_tasks(spark: SparkSession) -> int:
    """Tasks for work that goes by the file, whatever the number of files."""
    return CORE_TASKS * spark.sparkContext.defaultParallelism


@contextlib.contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Tables read inside are listed by a few tasks a core, each with many folders.

    By Spark's default every folder has its own task, up to 10,000 of them below each root.
    """
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, min(int(before or 10_000), few_tasks(spark)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(LISTING)
        else:
            spark.conf.set(LISTING, before)


def list_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """``path`` of every .csv file (any case) below ``root``; contents are not read.

    Spark's listing leaves out files of zero bytes.
    """
    if not root:
        return spark.createDataFrame([], "path string")
    with _listing(spark):
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.[cC][sS][vV]")
            .load(root)
        )
    # Spark plans a file as 4 MB: a task for every 32 small ones.
    return found.select(F.col("_metadata.file_path").alias("path")).coalesce(few_tasks(spark))


def _relative(path: Column, root: str) -> Column:
    """The part of a path below ``root``, plain; cheap enough for every row."""
    top = re.sub(SCHEME, "", root).rstrip("/")
    host, store = F.instr(path, "://"), F.instr(path, ":/")
    slash = F.call_function("locate", F.lit("/"), path, F.when(host > 0, host + 3).otherwise(store))
    after = F.when(store > 0, slash).otherwise(1)
    return F.substring(_plain_path(F.substring(path, after, F.lit(1 << 30))), len(top) + 2, 1 << 30)


def _category(relative: Column) -> Column:
    folder = F.substring_index(relative, "/", 1)
    return category_key(F.when(folder.contains("="), F.regexp_replace(folder, "^[^=]+=", "")).otherwise(folder))


def with_path_keys(files: DataFrame, root: str) -> DataFrame:
    """Add ``category`` (normalised top folder) and ``app`` (leaf folder).

    Files directly in ``root`` have no category and are dropped. A Hive-style
    folder name ``key=value`` counts as ``value``.
    """
    parts = F.split(_relative(F.col("path"), root), "/")
    unkeyed = lambda name: F.regexp_replace(name, "^[^=]+=", "")
    return (
        files.withColumn("_parts", parts)
        .filter(F.size("_parts") > 1)
        .withColumn("category", _category(_relative(F.col("path"), root)))
        .withColumn("app", unkeyed(F.element_at("_parts", -2)))
        .drop("_parts")
    )


def label_categories(files: DataFrame) -> DataFrame:
    """Add the slice label of the category; unmapped categories are dropped."""
    mapping = files.sparkSession.createDataFrame(
        list(CATEGORY_SLICES.items()), f"category string, {LABEL} bigint"
    )
    return files.join(F.broadcast(mapping), "category")


def _plain_path(path: Column) -> Column:
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), decoded).otherwise(path)


def with_unit(files: DataFrame) -> DataFrame:
    """Add ``unit``: the file, or the folder ``x.csv`` whose part files make up one table."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.withColumn(
        "unit", F.when(folder.rlike(r"(?i)\.csv$"), folder).otherwise(F.col("path"))
    )


def find_stems(files: DataFrame, root: str) -> DataFrame:
    """One row per known application stem with its file, or NULL when missing.

    Looked for in ``root`` as written, lower and upper case, then in each direct
    sub-folder (by name) as written and lower case; the first hit wins. A table
    written by Spark, a folder ``stem.csv`` of part files, counts as a file.
    """
    spark = files.sparkSession
    stems = spark.createDataFrame(list(STEM_SLICES.items()), f"stem string, {LABEL} bigint")
    tries = [
        (s, f"{name}.csv", depth, turn)
        for s in STEM_SLICES
        for depth, names in ((1, (s, s.lower(), s.upper())), (2, (s, s.lower())))
        for turn, name in enumerate(names)
    ]
    wanted = spark.createDataFrame(tries, "stem string, file string, depth int, turn int")
    hits = (
        with_unit(files).select(F.col("unit").alias("path")).distinct()
        .withColumn("_parts", F.split(_relative(F.col("path"), root), "/"))
        .select(
            "path",
            F.size("_parts").alias("depth"),
            F.element_at("_parts", -1).alias("file"),
            F.when(F.size("_parts") > 1, F.element_at("_parts", 1)).otherwise("").alias("folder"),
        )
        .join(F.broadcast(wanted), ["file", "depth"])
        .groupBy("stem")
        .agg(F.min(F.struct("depth", "folder", "turn", "path")).alias("best"))
        .select("stem", F.col("best.path").alias("path"))
    )
    return stems.join(hits, "stem", "left").select("stem", LABEL, "path")


def _store(path: str):
    """Arrow's file system of a path with scheme, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if re.match(r"file:/[^/]", path) else path)


def _first_line(path: str) -> list[str]:
    """Column names in the first line of a file; empty when it cannot be read."""
    try:
        system, name = _store(path)
        with system.open_input_stream(name) as f:
            head = b""
            while b"\n" not in head and (more := f.read(HEADER_STEP)):
                head += more
    except (OSError, ValueError):
        return []
    # Lines end where Spark's reader ends them: at \n, \r\n or \r.
    line = re.split("\r\n|\n|\r", head.decode("utf-8-sig", errors="replace"), maxsplit=1)[0]
    return [c.strip() for c in next(csv.reader([line]), [])]


def with_headers(files: DataFrame) -> DataFrame:
    """Add ``header``, the trimmed column names of every file.

    Reads the first bytes of each file, some at a time in every task; Spark's
    text sources could only find first lines by scanning everything.
    """

    @F.pandas_udf("array<string>")
    def header(paths: pd.Series) -> pd.Series:
        with ThreadPoolExecutor(OPEN_FILES) as pool:
            return pd.Series(list(pool.map(_first_line, paths)), dtype=object)

    return files.withColumn("header", header.asNondeterministic()("path"))


def header_inventory(files: DataFrame) -> DataFrame:
    """``path, header`` of every file."""
    return with_headers(files).select("path", "header")


def missing_columns(header: Column, required=REQUIRED_COLUMNS) -> Column:
    return F.array_except(F.array(*[F.lit(c) for c in required]), header)


def alias_position(header: Column, name: str) -> Column:
    """Zero-based position of the first column, in file order, that is an alias of ``name``."""
    aliases = F.array(*[F.lit(a) for a in COLUMN_ALIASES[name]])
    known = F.transform(header, lambda h: F.array_contains(aliases, F.lower(F.trim(h))))
    return F.array_position(known, True) - F.lit(1)


def write_capture_files(df: DataFrame, root: str, keys: list[str], order=()) -> None:
    """Rows as CSV files with header, one for each value of ``keys``: ``<root>/<key>=<value>/../part.csv``.

    ``order`` sorts the rows of a file. Spark's partitioned writer sets the permissions of every
    local file by a process of its own and commits file after file on the driver. Here every task
    streams its sorted rows into one file after the other, with no more than a batch in memory. A file
    gets its name when it is whole, so a repeated task does no harm.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    place = store.makeQualified(path).toUri().toString()
    names = [c for c in df.columns if c not in keys]
    value = lambda k: F.coalesce(F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")), F.lit(NO_VALUE))
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), value(k)) for k in keys])
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names]), {"escape": '"'})
    first = io.StringIO()
    csv.writer(first, lineterminator="\n").writerow(names)
    header = first.getvalue().encode()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _store(place)
        at, out, files = None, None, 0
        mark = f"_{uuid.uuid4().hex}.part"

        def end() -> None:
            if out is not None:
                out.close()
                system.move(f"{top}/{at}/{mark}", f"{top}/{at}/part.csv")

        for batch in batches:
            folders, lines = batch["folder"].to_numpy(), batch["line"].to_numpy()
            cuts = np.flatnonzero(folders[1:] != folders[:-1]) + 1
            for lo, hi in pairwise([0, *cuts, len(lines)] if len(lines) else []):
                if folders[lo] != at:
                    end()
                    at, files = folders[lo], files + 1
                    system.create_dir(f"{top}/{at}")
                    out = system.open_output_stream(f"{top}/{at}/{mark}")
                    out.write(header)
                out.write(("\n".join(lines[lo:hi]) + "\n").encode())
        end()
        yield pd.DataFrame({"files": [files]})

    rows = df.withColumn("_folder", folder).repartition("_folder").sortWithinPartitions("_folder", *order)
    written = rows.select(F.col("_folder").alias("folder"), line.alias("line")).mapInPandas(write, "files bigint")
    written.write.format("noop").mode("overwrite").save()


def _scan_rows(spark: SparkSession, paths, width: int) -> DataFrame:
    """Data rows of CSV files as text ``c0, c1, ..`` with ``path`` and file order ``pkt_no``."""
    names = [f"c{i}" for i in range(width)]
    with _listing(spark):
        rows = (
            spark.read.schema(", ".join(f"{n} string" for n in names))
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("escape", '"')
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.[cC][sS][vV]")
            .option("ignoreCorruptFiles", True)
            .csv(paths)
        )
    # A row is longer than a byte, so its count within a task, added to the
    # offset of its block, orders the rows of a file.
    row = F.monotonically_increasing_id().bitwiseAND(ROW_BITS)
    return rows.select(
        *names,
        F.col("_metadata.file_path").alias("path"),
        (F.col("_metadata.file_block_start") + row).alias("pkt_no"),
    )


def _read(
    spark: SparkSession, paths, files: DataFrame, file_id: Column, positions: dict[str, Column], marks=()
) -> DataFrame:
    """Rows of the usable files: text columns by name, ``pkt_no, path, file_id, broken``.

    For a name in ``marks`` also ``has_<name>``: whether the row's file has that column.

    ``files`` has ``file_id, header, usable``; ``file_id`` gives the same of a
    row's ``path``. The most common layout is read by position without a look
    at the files. Files with another layout, and those that cannot be used, are
    the exceptions that rows are joined to. When all usable files have one
    layout, as exports of one tool do, the CSV reader skips the other columns.
    """
    names = list(positions)
    width = F.size("header").cast("int").alias("width")
    at = [p.cast("int").alias(f"at_{n}") for n, p in positions.items()]
    described = stage(files.select("file_id", "usable", width, *at), "layouts")
    layout = ["width", *[f"at_{n}" for n in names]]
    common = (
        described.filter("usable").groupBy(*layout).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), *layout).limit(2).collect()
    )
    if not common:
        raise FileNotFoundError(f"no usable capture file below {paths}")
    usual = common[0]
    widest = described.filter("usable").agg(F.max("width")).first()[0]
    rows = _scan_rows(spark, paths, widest + 1).withColumn("file_id", file_id)
    if len(common) == 1:
        own = lambda n: F.lit(usual[n])
        cell = lambda n: F.col(f"c{usual[n]}") if usual[n] >= 0 else F.lit(None).cast("string")
        overflow = F.col(f"c{widest}")
        rows = rows.join(described.filter("NOT usable").select("file_id"), "file_id", "left_anti")
    else:
        same = F.lit(True)
        for n in layout:
            same &= F.col(n) == F.lit(usual[n])
        others = described.filter(~(F.col("usable") & same)).withColumn("other", F.lit(True))
        rows = attach(rows, others, ["file_id"], "left").filter("other IS NULL OR usable")
        cells = F.array(*[f"c{i}" for i in range(widest + 1)])
        own = lambda n: F.when(F.col("other"), F.col(n)).otherwise(F.lit(usual[n]))
        cell = lambda n: F.when(own(n) >= 0, F.get(cells, own(n)))
        overflow = F.get(cells, own("width"))
    cells = [cell(f"at_{n}").alias(n) for n in names]
    has = [(own(f"at_{n}") >= 0).alias(f"has_{n}") for n in marks]
    return rows.select("pkt_no", "path", "file_id", *cells, overflow.isNotNull().alias("broken"), *has)


def capture_files(spark: SparkSession, root: str) -> DataFrame:
    """Every mapped capture file, evaluated once.

    Columns ``capture_id, path, category, app, traffic_class, header, usable``. The
    numeric ``capture_id`` stands for the long path in every later shuffle; it
    is the hash of the path below ``root``, so reruns and other partitionings,
    and another place of the tree, give the same one.
    """
    files = label_categories(with_path_keys(list_files(spark, mapped_folders(spark, root)), root))
    described = with_headers(files).withColumn(
        "usable", F.size(missing_columns(F.col("header"))) == 0
    )
    known = stage(
        described.withColumn("capture_id", F.xxhash64(_relative(F.col("path"), root))), "files"
    )
    n, ids = known.agg(F.count("*"), F.count_distinct("capture_id")).first()
    if n != ids:
        raise ValueError(f"{n - ids} capture files below {root} share an id; split the tree")
    return known


def scan_capture_tree(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Raw text packets of ``<root>/<category>/.../<app>/*.csv``, one capture per file.

    ``files`` comes from :func:`capture_files`. Files without the required columns
    are skipped, folders without a category are not opened. A row with more
    cells than its header is marked ``broken``, which rejects its capture.
    """
    positions = {c: F.array_position("header", c) - 1 for c in CAPTURE_COLUMNS}
    relative = _relative(F.col("path"), root)
    rows = _read(
        spark, mapped_folders(spark, root), files.withColumnRenamed("capture_id", "file_id"),
        F.xxhash64(relative), positions,
    )
    labels = F.create_map(*[F.lit(x) for pair in CATEGORY_SLICES.items() for x in pair])
    label = F.element_at(labels, _category(relative)).cast("bigint")
    return rows.select(
        "pkt_no", *CAPTURE_COLUMNS, "broken", F.col("file_id").alias("capture_id"), label.alias(LABEL)
    )


def with_capture_names(windows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``path, category, app`` to rows that carry a ``capture_id``."""
    return attach(windows, files.select("capture_id", "path", "category", "app"), ["capture_id"])


def scan_by_stem(spark: SparkSession, root: str) -> DataFrame:
    """Raw text packets of the one file per known application stem below ``root``.

    Columns are found by alias; a file without a time or length column is
    skipped, one without a port column gets no direction.
    """
    listed = list_files(spark, root)
    # At most one row per known stem.
    found = stage(find_stems(listed, root).filter("path IS NOT NULL"), "stems")
    units = F.broadcast(found.withColumnRenamed("path", "unit"))
    parts = with_headers(with_unit(listed).join(units, "unit"))
    positions = {name: alias_position(F.col("header"), name) for name in COLUMN_ALIASES}
    readable = F.coalesce((positions["time"] >= 0) & (positions["length"] >= 0), F.lit(False))
    files = stage(
        parts.select("unit", "header", F.xxhash64("path").alias("file_id"), readable.alias("usable")), "files"
    )
    paths = [u for (u,) in files.filter("usable").select(_plain_path(F.col("unit"))).distinct().collect()]
    if not paths:
        raise FileNotFoundError(f"no usable application file below {root}")
    rows = _read(spark, paths, files, F.xxhash64("path"), positions, marks=("dst_port",))
    return with_unit(rows).join(units, "unit").select(
        "pkt_no", *positions, "broken", F.col("stem").alias("capture_id"),
        F.col("has_dst_port").alias("has_port"), LABEL,
    )
