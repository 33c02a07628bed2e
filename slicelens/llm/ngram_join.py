"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles. Two sets of Jaccard similarity t share a
shingle among the first n - ceil(t n) + 1 of either, in any one order of all
shingles; here those of one document come first and frequent ones last, so a
passage that many hold rarely gets there. Each such shingle has a list of the
documents that hold it there, and the join skips along and between lists:

* Index level. A list is split by the components that stars of near copies
  make, and entries of one component are not paired. It is sorted by block of positions, then by set size. For an entry
  and a block, the sizes that can still reach the needed overlap are one
  interval, so the rest of the block is skipped without being looked at.
* Answer level. Equal sets are one class. Sets found highly similar to a root
  take the root's answers: with the symmetric differences to the roots known,
  |x ^ z| lies within |r ^ s| -+ (|x ^ r| + |z ^ s|), which settles whole groups
  of pairs from the one computed pair of roots.

A parity of each set rules out pairs that differ in more bits than shingles may
differ. Only what that leaves open is compared by itself. Links inside one component
are not looked for again: the result is each document's component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelens.llm.common import contained, one, read, stage
from slicelens.llm.components import components
from slicelens.llm.registry import query
from slicelens.llm.words import mixed, shingle_sets

#: Documents holding a shingle from which it counts as frequent.
FREQUENT = 32
#: Bits of the filters that are sent to all tasks (8 MiB each): fuller ones let more pass, never less.
BITS = 26
#: Entries of one list that one task meets; longer lists are split into tiles.
TILE = 4096
ENTRIES = 200_000
BLOCK = 64
PAIRS = 1 << 20
#: Pairs whose parities are compared at a time.
MET = 1 << 17
#: Bits of a set's parity: each of its shingles flips one. Two sets differ in no more bits than shingles.
PARITY = 256
#: Shingles that a task counts together.
TALLIED = 1 << 21
_SEEN = np.uint8(1) << np.arange(8, dtype=np.uint8)


class Rule:
    """Similarity ``num / den`` or more, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least common shingles of two linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def apart(self, a, b):
        """Most shingles that are in one of two linked sets only."""
        return a + b - 2 * self.overlap(a, b)

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1


# Filters


def id_filter(ids: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap with the bit of each id's hash set; its size does not depend on the data."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits)) + 1
    rows = (
        ids.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] & _SEEN[at & 7]) != 0


def _sets(batches: Iterator[pd.DataFrame], length: int, seen: np.ndarray | None = None):
    """Ids and shingle sets of the rows whose id passes the filter, some rows at a time."""
    for batch in batches:
        if seen is not None:
            batch = batch[_has(seen, batch["at"].to_numpy())]
        for lo in range(0, len(batch), 512):
            part = batch.iloc[lo : lo + 512]
            yield part.id.to_numpy(), shingle_sets(part.text.tolist(), length)


def _prints(batches, length):
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.iloc[lo : lo + 512]
            sets = shingle_sets(part.text.tolist(), length)
            yield pd.DataFrame({
                "id": part.id, "n": [len(s) for s in sets],
                "f1": [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                "f2": [int(np.bitwise_xor.reduce(mixed(s + np.uint64(1)), initial=np.uint64(0)).view(np.int64))
                       for s in sets],
            })


# Shingle frequencies


def _tallied(batches, length, seen, ranges):
    """Shingles of a task by range of hashes: 32 further bits of each, and counts where over one."""
    shift = np.uint64(32 - ranges)
    held, size = [], 0

    def out():
        value, n = np.unique(np.concatenate(held) >> shift, return_counts=True)
        ends = np.searchsorted(value >> np.uint64(32), np.arange(1, 1 << ranges, dtype=np.uint64))
        low = value.astype(np.uint32)
        parts = [(v[c == 1].tobytes(), v[c > 1].tobytes(), c[c > 1].astype(np.uint32).tobytes())
                 for v, c in zip(np.split(low, ends), np.split(n, ends), strict=True)]
        return pd.DataFrame(parts, columns=["once", "more", "n"]).assign(range=np.arange(1 << ranges))

    for _, sets in _sets(batches, length, seen):
        held += sets
        size += sum(len(s) for s in sets)
        if size > TALLIED:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _marked(frame: pd.DataFrame, ranges: int, bits: int, frequent: int) -> pd.DataFrame:
    """The filters' own parts of this range: shingles of two documents or more, and frequent ones."""
    once = np.frombuffer(b"".join(frame.once), np.uint32)
    more = np.frombuffer(b"".join(frame.more), np.uint32)
    weight = np.concatenate((np.ones(len(once), np.int64), np.frombuffer(b"".join(frame.n), np.uint32)))
    value = np.concatenate((once, more))
    order = np.argsort(value, kind="stable")
    value, weight = value[order], weight[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else value
    total = np.add.reduceat(weight, first) if len(first) else weight
    out = []
    for least in (2, frequent):
        at = np.unique(value[first][total >= least] >> np.uint32(32 - bits + ranges))
        marks = np.zeros(1 << (bits - ranges), bool)
        marks[at] = True
        out.append(np.packbits(marks, bitorder="little").tobytes())
    return pd.DataFrame({"range": frame.range.iloc[:1], "shared": out[:1], "frequent": out[1:]})


def shingle_filters(
    texts: DataFrame, length: int, seen: np.ndarray, frequent: int = FREQUENT, bits: int = BITS
) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps over the leading hash bits: shingles in two documents, and in ``frequent``.

    Counted over all documents. A task sends each shingle once, as four bytes in
    the row of its hash range; the number of ranges follows the input's partitions.
    """
    partitions = texts.rdd.getNumPartitions()
    ranges = min(16, max(6, math.ceil(math.log2(8 * partitions))))
    parts = texts.mapInPandas(
        one(_tallied, length=length, seen=seen, ranges=ranges),
        "once binary, more binary, n binary, range int",
    )
    rows = (
        parts.groupBy("range")
        .applyInPandas(one(_marked, ranges=ranges, bits=bits, frequent=frequent),
                       "range int, shared binary, frequent binary")
        .collect()
    )
    size = (1 << (bits - ranges)) // 8
    out = np.zeros((2, (1 << bits) // 8), np.uint8)
    for r in rows:
        here = slice(r.range * size, (r.range + 1) * size)
        out[0, here] = np.frombuffer(r.shared, np.uint8)
        out[1, here] = np.frombuffer(r.frequent, np.uint8)
    return out[0], out[1]


def _parity(s: np.ndarray) -> bytes:
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _entries(batches, length, seen, rule, filters, bits):
    """The list entries of each document: shingle, size, position in the order, shingles of its own, parity."""
    shared, frequent = filters
    for ids, sets in _sets(batches, length, seen):
        found, parities = [], []
        for i, s in zip(ids, sets, strict=True):
            if not len(s):
                continue
            top = (s >> np.uint64(64 - bits)).astype(np.int64)
            rank = _has(shared, top).astype(np.int8) + _has(frequent, top)
            order = np.argsort(rank, kind="stable")[: rule.prefix(len(s))]
            pos = np.flatnonzero(rank[order])
            if len(pos):
                lone = int((rank == 0).sum())
                found.append((np.full(len(pos), i), s[order[pos]].view(np.int64), np.full(len(pos), len(s)), pos,
                              np.full(len(pos), lone)))
                parities += [_parity(s)] * len(pos)
        if found:
            out = {c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("id", "shingle", "n", "pos", "lone"))}
            yield pd.DataFrame({**out, "parity": parities})


# Lists


def _windows(list_no, n, pos, component, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries of one list and two components that may link, each unordered pair once.

    A list's components are numbered. Two numbers differ first in one bit, and
    at that bit's turn the entries on its two sides meet, so entries of one
    component are never paired.
    """
    order = np.lexsort((component, list_no))
    a, c = list_no[order], component[order]
    new_list = np.append(True, a[1:] != a[:-1])[: len(a)]
    number = np.cumsum(new_list | np.append(True, c[1:] != c[:-1])[: len(a)])
    rank = np.empty(len(a), np.int64)
    rank[order] = number - np.maximum.accumulate(np.where(new_list, number, 0))
    for bit in range(int(rank.max(initial=0)).bit_length()):
        part, side = rank >> (bit + 1), (rank >> bit) & 1
        order = np.lexsort((n, pos // BLOCK, side, part, list_no))
        a, c, d = list_no[order], part[order], side[order]
        group = np.cumsum(np.append(False, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        # Only where both sides have entries.
        both = (np.bincount(group, d) > 0)[group]
        order = order[both]
        for i, j in _across(group[both], d[both], n[order], pos[order], rule):
            yield order[i], order[j]


def _across(group, side, n, pos, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries of one group's two sides that may link, each unordered pair once.

    Entries are sorted by group, side, block of positions, size. Every entry looks
    at its own block and the later ones of the other side; of each it takes one
    interval of sizes.
    """
    if not len(n):
        return
    num, den = rule.num, rule.den
    block = pos // BLOCK
    span = int(n.max()) * 2 + 2
    high = int(block.max()) + 2
    half, facing = group * 2 + side, group * 2 + 1 - side
    key = (half * high + block) * span + n
    last = np.zeros(int(group[-1]) * 2 + 2, np.int64)
    np.maximum.at(last, half, block)
    # Two entries of one block meet from the first side.
    live = np.flatnonzero(side == 0)
    step = 0
    while len(live):
        at = block[live] + step
        # An entry y of that block has y.pos >= start: x.pos + 1 + rest(y) must reach the overlap.
        start = np.maximum(at * BLOCK, pos[live]) if step else at * BLOCK
        least = -(-num * n[live] // den)
        if step:
            need = (start - pos[live]) * (den + num) + num * n[live]
            least = np.maximum(least, -(-need // den))
        most = np.minimum(den * n[live] // num, span - 1)
        base = (facing[live] * high + at) * span
        lo = np.searchsorted(key, base + np.minimum(least, span - 1), side="left")
        hi = np.searchsorted(key, base + most, side="right")
        count = np.maximum(hi - lo, 0)
        count[least > most] = 0
        upto = np.cumsum(count)
        a = 0
        while a < len(live):
            done = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
            i = np.repeat(live[a:b], count[a:b])
            j = np.repeat(lo[a:b] - (upto[a:b] - count[a:b] - done), count[a:b]) + np.arange(len(i))
            if len(i):
                reach = 1 + np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
                keep = reach >= rule.overlap(n[i], n[j])
                yield i[keep], j[keep]
            a = b
        step += 1
        live = np.arange(len(n)) if step == 1 else live
        live = live[block[live] + step <= last[facing[live]]]


def _sorted_lists(frame: pd.DataFrame, by: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    frame = frame.sort_values(by, ignore_index=True)
    key = frame["list"].to_numpy()
    return frame, np.cumsum(np.append(0, key[1:] != key[:-1]))


def _alike(frame: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """The documents whose next larger or smaller set in a list is of like size."""
    frame, list_no = _sorted_lists(frame, ["list", "n", "id"])
    n, ids = frame.n.to_numpy(), frame.id.to_numpy()
    k = np.flatnonzero((list_no[1:] == list_no[:-1]) & (n[1:] * rule.num <= n[:-1] * rule.den))
    return pd.DataFrame({"id": np.unique(np.concatenate((ids[k], ids[k + 1])))})


def _met(frame: pd.DataFrame, rule: Rule, emit: Callable) -> pd.DataFrame:
    """``emit`` of all pairs of different components that neither lists nor parities can rule out."""
    frame, list_no = _sorted_lists(frame, ["list", "n", "id"])
    c = {k: frame[k].to_numpy() for k in ("id", "n", "pos", "component", "root", "apart", "half")}
    parity = np.frombuffer(b"".join(frame.pop("parity")), np.uint64).reshape(len(frame), -1)
    out = []
    for some_i, some_j in _windows(list_no, c["n"], c["pos"], c["component"], rule):
        for lo in range(0, len(some_i), MET):
            i, j = some_i[lo : lo + MET], some_j[lo : lo + MET]
            # Both from one half of a tile: another tile has this pair.
            keep = (c["half"][i] == 0) | (c["half"][i] != c["half"][j])
            i, j = i[keep], j[keep]
            odd = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
            keep = odd <= rule.apart(c["n"][i], c["n"][j])
            if keep.any():
                out.append(emit(c, i[keep], j[keep], rule))
    return pd.concat(out) if out else emit(c, np.zeros(0, int), np.zeros(0, int), rule)


def _root_pairs(c: dict, i: np.ndarray, j: np.ndarray, rule: Rule) -> pd.DataFrame:
    r, s = c["root"][i], c["root"][j]
    slack = c["apart"][i] + c["apart"][j] + rule.apart(c["n"][i], c["n"][j])
    # The pair of roots itself needs no second look.
    slack = np.where((c["id"][i] == r) & (c["id"][j] == s), -1, slack)
    pairs = pd.DataFrame({"a": np.minimum(r, s), "b": np.maximum(r, s), "slack": slack})
    return pairs.groupby(["a", "b"], as_index=False).slack.max()


def _member_pairs(c: dict, i: np.ndarray, j: np.ndarray, rule: Rule) -> pd.DataFrame:
    swap = c["root"][i] > c["root"][j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pd.DataFrame({
        "a": c["id"][i], "b": c["id"][j], "r": c["root"][i], "s": c["root"][j],
        "slack": c["apart"][i] + c["apart"][j] + rule.apart(c["n"][i], c["n"][j]),
    }).drop_duplicates()


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = []
        for x, z in zip(batch.x, batch.z, strict=True):
            x, z = np.frombuffer(x, np.uint64), np.frombuffer(z, np.uint64)
            at = np.searchsorted(z, x)
            sizes.append((len(x), len(z), int((z[np.minimum(at, len(z) - 1)] == x).sum())))
        yield pd.concat(
            (batch[["a", "b"]].reset_index(drop=True), pd.DataFrame(sizes, columns=["na", "nb", "common"])), axis=1
        )


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, common`` of the pairs ``a, b``, by their whole sets ``id, members``."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("z"))
    # Always shuffle joins: sets grow with the documents.
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.mapInPandas(_compared, "a long, b long, na long, nb long, common long")


def _linked(found: DataFrame, rule: Rule) -> DataFrame:
    return found.filter(
        F.col("common") * (rule.den + rule.num) >= F.lit(rule.num) * (F.col("na") + F.col("nb"))
    )


def _by_task(lists: DataFrame, entries: int) -> DataFrame:
    groups = max(1, math.ceil(entries / ENTRIES))
    return lists.withColumn("task", F.pmod(F.col("list"), F.lit(groups))).groupBy("task")


def _tiled_rows(entries: DataFrame, tile: int) -> int:
    """Rows of ``_tiled``: an entry has one in every tile of its chunk."""
    return entries.agg(F.sum(F.ceil(F.col("m") / F.lit(tile)))).first()[0] or 0


def _tiled(entries: DataFrame, tile: int) -> DataFrame:
    """Lists beyond ``tile`` entries are cut into chunks by id; every two chunks meet in one tile."""
    chunks = F.ceil(F.col("m") / F.lit(tile)).cast("int")
    return (
        entries.withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("list", F.xxhash64("shingle", F.least("chunk", "other"), F.greatest("chunk", "other")))
        .withColumn("half", F.signum(F.col("other") - F.col("chunk")).cast("int"))
        .drop("chunks", "chunk", "other", "m", "shingle")
    )


@contained
def links(
    texts: DataFrame, prints: DataFrame, length: int, rule: Rule,
    frequent: int = FREQUENT, bits: int = BITS, tile: int = TILE,
) -> DataFrame:
    """Links ``a, b`` that connect all linked documents; within a component not every link is listed.

    ``texts`` has ``id, text, at`` (the id's bit in the filters), ``prints`` one row a document.
    """
    roots = prints.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    copies = prints.filter("n > 0").join(roots, ["n", "f1", "f2"]).filter("id <> rep")
    reps = stage(roots.select(F.col("rep").alias("id")).distinct(), "reps")
    seen = id_filter(reps, bits)
    filters = shingle_filters(texts, length, seen, frequent, bits)
    entries = texts.mapInPandas(
        one(_entries, length=length, seen=seen, rule=rule, filters=filters, bits=bits),
        "id long, shingle long, n long, pos long, lone long, parity binary",
    )
    entries = stage(entries.join(reps, "id", "left_semi"), "entries")
    # The set with the fewest shingles of its own is the likeliest source of the others.
    root = F.struct("lone", "id", "n", "pos")
    shared = entries.groupBy("shingle").agg(F.count("*").alias("m"), F.min(root).alias("hub")).filter("m > 1")
    lists = stage(entries.join(shared, "shingle"), "lists")
    size = lists.count()

    # Stars: most members of a group of near copies meet their root here.
    both = F.col("n") + F.col("hub.n")
    reach = F.least("pos", "hub.pos") + F.least(F.col("n") - F.col("pos"), F.col("hub.n") - F.col("hub.pos"))
    stars = stage(
        lists.filter(
            (F.col("id") != F.col("hub.id")) & (reach * (rule.den + rule.num) >= F.lit(rule.num) * both)
        ).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(),
        "stars",
    )
    # Whole sets are needed of those that have a neighbour of like size in some list.
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / F.lit(tile)))
    chunked = lists.withColumn("list", F.xxhash64("shingle", chunk)).select("id", "n", "list")
    near = _by_task(chunked, size).applyInPandas(one(_alike, rule=rule), "id long")
    met = near.union(lists.filter(F.col("m") > tile).select("id")).union(stars.select("a"))
    partners = id_filter(met.union(stars.select("b")), bits)

    def whole(batches):
        for ids, sets in _sets(batches, length, partners):
            yield pd.DataFrame({"id": ids, "members": [s.tobytes() for s in sets]})

    sets = stage(texts.mapInPandas(whole, "id long, members binary"), "sets")
    found = stage(_linked(overlaps(stars, sets), rule), "star-links")
    edges = copies.select(F.col("id").alias("a"), F.col("rep").alias("b")).union(found.select("a", "b"))

    apart = F.col("na") + F.col("nb") - 2 * F.col("common")
    info = found.groupBy(F.col("b").alias("id")).agg(
        F.min_by("a", F.struct("common", "a")).alias("root"),
        F.min_by(apart, F.struct("common", "a")).alias("apart"),
    )

    # An id with several sets has no one distance to a root: it is its own.
    one_set = F.struct("n", "f1", "f2")
    several = (
        prints.filter("n > 0").groupBy("id").agg(F.min(one_set).alias("lo"), F.max(one_set).alias("hi"))
        .filter("lo <> hi").select("id")
    )
    info = info.join(several, "id", "left_anti")

    # Entries with their root and the distance to it, and the component that the stars make.
    rooted = lists.join(info, "id", "left").join(components(found.select("a", "b")), "id", "left").select(
        "id", "n", "pos", "m", "shingle", "parity", F.coalesce("root", "id").alias("root"),
        F.coalesce("apart", F.lit(0)).alias("apart"), F.coalesce("component", "id").alias("component"),
    )

    # Roots: one computed pair answers for all pairs of their members that it settles.
    joined = stage(rooted, "rooted")
    pairs = stage(
        _by_task(_tiled(joined, tile), _tiled_rows(joined, tile))
        .applyInPandas(one(_met, rule=rule, emit=_root_pairs), "a long, b long, slack long")
        .groupBy("a", "b").agg(F.max("slack").alias("slack")),
        "root-pairs",
    )
    known = stage(overlaps(pairs, sets), "root-overlaps")
    edges = edges.union(_linked(known, rule).select("a", "b"))
    still = pairs.join(known.select("a", "b", apart.alias("apart")), ["a", "b"]).select("a", "b", "slack", "apart")
    still = stage(still.filter("apart <= slack").select("a", "b", "apart"), "open")
    if still.isEmpty():
        return edges

    # Members of the pairs of roots that do not settle them.
    ends = still.select(F.col("a").alias("root")).union(still.select("b")).distinct()
    again = joined.drop("component").join(ends, "root", "left_semi").join(components(edges), "id", "left")
    again = stage(again.withColumn("component", F.coalesce("component", "id")), "open-entries")
    pairs = (
        _by_task(_tiled(again, tile), _tiled_rows(again, tile))
        .applyInPandas(one(_met, rule=rule, emit=_member_pairs),
                       "a long, b long, r long, s long, slack long")
        .join(still.select(F.col("a").alias("r"), F.col("b").alias("s"), "apart"), ["r", "s"])
        .filter("apart <= slack").select("a", "b").distinct()
    )
    last = _linked(overlaps(stage(pairs, "member-pairs"), sets), rule)
    return edges.union(stage(last.select("a", "b"), "member-links"))


@contained
def jaccard_components(
    docs: DataFrame, length: int = 5, num: int = 80, den: int = 100,
    frequent: int = FREQUENT, bits: int = BITS, tile: int = TILE,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Needs ``doc_id, text``. Documents link from similarity ``num / den`` up. A
    null text, or one without words, has the empty set and links with nothing;
    so has a row without id, whose component is null. Rows that share an id are
    one node: it has the links of all its texts. Words are compared by 64-bit
    hashes, equal sets by 128 bits and their size.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = whole.filter("id IS NOT NULL AND text IS NOT NULL").withColumn(
        "at", F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    )
    prints = stage(
        whole.select(F.col("id").cast("string"), "text")
        .mapInPandas(one(_prints, length=length), "id string, n long, f1 long, f2 long")
        .withColumn("id", F.col("id").cast("long")),
        "prints",
    )
    rule = Rule(num, den)
    edges = links(texts, prints.filter("id IS NOT NULL"), length, rule, frequent, bits, tile)
    found = components(edges)
    return prints.join(found, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )


@query("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark, folder):
    """Set size and component of every document, four-word shingles, 0.85 or more."""
    return jaccard_components(read(spark, folder, "documents"), length=4, num=85)
