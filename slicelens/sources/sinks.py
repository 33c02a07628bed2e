"""Writing the tables of a report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_report.json"


def _store(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def report_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where the tables of the committed report are; empty before the first."""
    store, path = _store(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not store.exists(path):
        return {}
    source = store.open(path)
    try:
        text = bytes(source.readAllBytes()).decode("utf-8")
    finally:
        source.close()
    return {name: f"{folder.rstrip('/')}/{place}" for name, place in json.loads(text).items()}


def read_report(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the committed report."""
    return {name: spark.read.parquet(path) for name, path in report_paths(spark, folder).items()}


def write_report(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write all tables as Parquet below ``folder`` and commit them together; return the paths.

    They are written to a new version and become the report by one rename of
    the manifest that names them. If a write fails, the former report stays.
    Tables of the former version go after the commit.
    """
    spark = next(iter(tables.values())).sparkSession
    top, version = folder.rstrip("/"), f"version-{uuid.uuid4().hex}"
    store, path = _store(spark, f"{top}/{version}")
    former = {p.rsplit("/", 2)[1] for p in report_paths(spark, folder).values()}
    try:
        for name, df in tables.items():
            df.write.parquet(f"{top}/{version}/{name}")
        _commit(spark, top, version, {name: f"{version}/{name}" for name in tables})
    except BaseException:
        store.delete(path, True)
        raise
    for old in former:
        store.delete(_store(spark, f"{top}/{old}")[1], True)
    return report_paths(spark, folder)


def _commit(spark: SparkSession, top: str, version: str, places: dict[str, str]) -> None:
    files = spark._jvm.org.apache.hadoop.fs
    store, staged = _store(spark, f"{top}/{version}/{MANIFEST}")
    out = store.create(staged, True)
    try:
        out.write(bytearray(json.dumps(places, indent=1).encode("utf-8")))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    over[0] = files.Options.Rename.OVERWRITE
    target = store.makeQualified(files.Path(f"{top}/{MANIFEST}"))
    context = files.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(staged), target, over)
