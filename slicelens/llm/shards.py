"""Two-pass external shuffle into shards, with DataFrame functions only.

The first pass scatters rows by a seeded hash over so many buckets that each
fits in a task's memory. The second shuffles each bucket (``shuffle`` is the
inside-out Fisher-Yates) and writes it. Buckets in a row are one uniform random
order of all rows; the shards are equal cuts of that order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicelens.llm.common import contained, read, stage
from slicelens.llm.registry import query

SHARDS = 8
SEED = 7
#: Bytes of rows that one task holds while it shuffles them.
BUCKET = 16 << 20


def _bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory."""
    flat = 0
    texts = []
    for field in schema:
        at = F.col(f"doc.`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            texts.append(F.coalesce(F.octet_length(at), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            texts.append(F.coalesce(F.size(at), F.lit(0)) * 16)
        flat += 16
    return sum(texts, F.lit(flat)).cast("long")


def _hashable(kind: T.DataType) -> bool:
    text = kind.simpleString()
    return "map<" not in text and "variant" not in text


def _seeded(schema: T.StructType, seed: int) -> Column:
    columns = [F.col(f"doc.`{f.name}`") for f in schema if _hashable(f.dataType)]
    return F.xxhash64(F.lit(seed).cast("long"), *columns)


@contained
def scattered(rows: DataFrame, bucket_bytes: int = BUCKET, seed: int = SEED) -> DataFrame:
    """``bucket, place, doc``: every row's bucket and its place (from 0) in the bucket's random order.

    The result is written once; a bucket is one task of that write, its rows in order of place.
    """
    doc = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc"))
    light = stage(
        doc.select(_seeded(rows.schema, seed).alias("h"), _bytes(rows.schema).alias("size")), "light"
    )
    buckets = max(1, math.ceil((light.agg(F.sum("size")).first()[0] or 0) / bucket_bytes))
    # Rows alike in every column share a hash. Where they would fill a good part of a bucket they are
    # dealt out one by one: which of them goes where cannot be seen. Fewer than 4 hashes a bucket can
    # be that heavy, so the list is bounded by the number of buckets.
    heavy = stage(
        light.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .filter((F.col("size") > bucket_bytes / 4) & (F.col("n") > 1))
        .select("h", F.lit(True).alias("alike")),
        "heavy",
    )
    hashed = doc.withColumn("h", _seeded(rows.schema, seed))
    salt = F.lit(None).cast("long")
    if not heavy.isEmpty():
        hashed = hashed.join(F.broadcast(heavy), "h", "left")
        salt = F.when(F.col("alike"), F.monotonically_increasing_id())
    bucket = F.pmod(F.xxhash64("h", salt), F.lit(buckets)).cast("int")
    # A bucket's number is its partition's, which fixes the seed of its shuffle.
    held = hashed.select("doc", "h", bucket.alias("bucket")).repartitionById(buckets, F.col("bucket"))
    members = held.groupBy("bucket").agg(F.collect_list(F.struct("h", "doc")).alias("members"))
    in_order = F.array_sort(
        "members", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    )
    mixed = members.select("bucket", F.shuffle(in_order, seed).alias("members"))
    placed = mixed.select("bucket", F.posexplode("members").alias("place", "member"))
    return placed.select("bucket", F.col("place").cast("long"), "member.doc")


def shuffled_shards(
    rows: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET, seed: int = SEED
) -> DataFrame:
    """``doc, shard, slot``: all rows in a random order, cut into shards of equal count.

    Counts of two shards differ by one at most; ``slot`` runs from 0 without a
    gap in each. ``doc`` holds the row's columns, so no name can clash. Nulls in
    any column, empty and very long texts are rows like others: a row larger
    than a bucket has a task of its own. Rows alike in every column are dealt
    out one by one. With fewer rows than shards some shards are empty; an empty
    table gives an empty table. Reruns agree; where rows alike fill a quarter of
    a bucket, as long as the files are split alike.
    """
    placed = scattered(rows, bucket_bytes, seed)
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    total = placed.count()
    # One row a bucket meets in this window, and buckets are as few as the bytes allow.
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Staged, so that its size is known before the join and the rows are not shuffled for it.
    starts = stage(
        counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts"
    )
    # The first place of shard s is s * total / shards, rounded up.
    return (
        placed.join(starts, "bucket").select("doc", (F.col("start") + F.col("place")).alias("at"))
        .withColumn("shard", F.expr(f"CAST(at * {shards} DIV {max(total, 1)} AS INT)"))
        .select("doc", "shard", F.expr(f"at - (shard * {total}L + {shards - 1}) DIV {shards}").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard under ``path``; the rows of a file stand in order of their slot.

    No shuffle: a bucket's rows lie together and are sorted where they are.
    """
    rows = sharded.select("doc", "slot", "shard").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)


@query("op12_sharding")
def op12_sharding(spark, folder):
    """All documents in shards 0 to 7; sizes and digests come from the texts as written."""
    sharded = shuffled_shards(read(spark, folder, "documents"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return sharded.select(
        "doc.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
