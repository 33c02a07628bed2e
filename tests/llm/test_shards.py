import math
import os
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slicelens.llm.shards import scattered, shuffled_shards, write_shards

SCHEMA = "doc_id long, text string, shard int, slot long, bucket string"


def hashed(value, seed):
    """Spark's xxhash64 of one value; a null leaves the seed."""
    if value is None:
        return seed
    raw = value.encode() if isinstance(value, str) else int(value).to_bytes(8, "little", signed=True)
    return xxhash.xxh64_intdigest(raw, seed)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fisher_yates(n, seed):
    """Inside-out Fisher-Yates on a Mersenne twister seeded as Spark's."""
    draw = np.random.RandomState([seed >> 32, seed & 0xFFFFFFFF])

    def below(n):
        while True:
            bits = int(draw.randint(0, 1 << 32, dtype=np.uint64)) >> 1
            if n & (n - 1) == 0:
                return (n * bits) >> 31
            if bits - bits % n + n - 1 < 1 << 31:
                return bits % n

    order = list(range(n))
    for i in range(n):
        j = below(i + 1)
        order[i], order[j] = order[j], i
    return order


def by_hand(rows, bucket_bytes, shards):
    """``(doc_id, shard, slot)`` by plain loops, for rows of (doc_id, text)."""
    size = sum(32 + len((t or "").encode()) for _, t in rows)
    buckets = max(1, math.ceil(size / bucket_bytes))
    held = [[] for _ in range(buckets)]
    for key, text in rows:
        h = hashed(text, hashed(key, hashed(7, 42)))
        held[signed(hashed(signed(h), 42)) % buckets].append((signed(h), key))
    order = []
    for b, members in enumerate(held):
        members.sort()
        order += [members[i][1] for i in fisher_yates(len(members), 7 + b)]
    cuts = [math.ceil(s * len(rows) / shards) for s in range(shards + 1)]
    return {(order[p], s, p - cuts[s]) for s in range(shards) for p in range(cuts[s], cuts[s + 1])}


@pytest.mark.parametrize("n,bucket_bytes,shards", [(500, 3000, 8), (300, 1 << 20, 8), (5, 60, 8), (97, 900, 3)])
def test_agrees_with_plain_loops(make, n, bucket_bytes, shards):
    rows = [(i if i % 40 else None if i == 0 else i, None if i % 31 == 7 else f"é text {i}" * (i % 9)) for i in range(n)]
    docs = make(rows, "doc_id long, text string")
    got = shuffled_shards(docs, shards, bucket_bytes)
    assert {(r.doc.doc_id, r.shard, r.slot) for r in got.collect()} == by_hand(rows, bucket_bytes, shards)
    again = shuffled_shards(docs.repartition(7), shards, bucket_bytes)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def law_holds(rows, n, shards):
    slots = {s: [] for s in range(shards)}
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_repeated_rows_fill_no_bucket(make):
    rows = [(1, "the same text", 3, None, "b")] * 3000 + [(i, f"t{i}", None, 5, None) for i in range(300)]
    rows += [(None, None, None, None, None)] * 400 + [(7, "long " * 50_000, 1, 1, "x")]
    docs = make(rows, SCHEMA)
    sizes = [r[1] for r in scattered(docs, 20_000).groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 4 * sum(sizes) / len(sizes)
    got = shuffled_shards(docs, 8, 20_000)
    out = got.collect()
    law_holds(out, len(rows), 8)
    assert Counter(str(r.doc) for r in out) == Counter(str(r) for r in docs.collect())
    copies = Counter(r.shard for r in out if r.doc.text == "the same text")
    assert min(copies.values()) > 250 and len(copies) == 8


def test_order_is_uniform(make):
    docs = make([(i, str(i)) for i in range(64)], "doc_id long, text string")
    places = np.zeros((64, 8))
    for seed in range(12):
        for r in shuffled_shards(docs, 8, 1000, seed).collect():
            places[r.doc.doc_id, r.shard] += 1
    expected = 12 / 8
    chi = ((places - expected) ** 2 / expected).sum()
    assert chi < 64 * 7 + 6 * math.sqrt(2 * 64 * 7)


def test_empty_and_odd_tables(make):
    assert shuffled_shards(make([], SCHEMA)).collect() == []
    one = shuffled_shards(make([(None, None, None, None, None)], SCHEMA)).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
    odd = make([(i, {"k": i}, [i], None) for i in range(20)], "doc_id long, m map<string,int>, a array<int>, x string")
    law_holds(shuffled_shards(odd, 4, 200).collect(), 20, 4)


def test_written_files_hold_slots_in_order(spark, make, tmp_path):
    docs = make([(i, f"text {i}", None, None, None) for i in range(400)], SCHEMA)
    sharded = shuffled_shards(docs, 4, 2000)
    write_shards(sharded, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out"))[-4:] == [f"shard={s}" for s in range(4)]
    back = spark.read.parquet(str(tmp_path / "out"))
    law_holds(back.collect(), 400, 4)
    runs = back.withColumn("file", F.input_file_name()).collect()
    for name in {r.file for r in runs}:
        own = [r.slot for r in runs if r.file == name]
        assert own == sorted(own)
