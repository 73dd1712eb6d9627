"""SimHash near-duplicates: 64-bit fingerprints compared in bit-sliced blocks.

A fingerprint has the majority bits of the XXH64 hashes (seed 42) of a text's shingles of SHINGLE words. Equal
fingerprints are one node. Fingerprints within a radius agree in two of radius + 2 parts of their bits at least, so each
goes into a bucket for each two parts. In a task the fingerprints of its buckets are turned into vertical bit planes of
64 lanes; the distances of one fingerprint to 64 others grow plane by plane in carry-save counters, and a block is
abandoned when all its lanes exceed the radius. Links are merged within the task, and the merged links by components().

A bucket of more than SPLIT fingerprints is cut into chunks, and each two chunks meet in a task of their own, so that no
task gets more than 2 * SPLIT of one bucket.

similar() finds texts by the Jaccard similarity of their sets of WORDS words. For sets that share LEAST of their union a
fingerprint differs in 0.15 of its bits, too many for parts that must agree; so their 128-bit fingerprints go into TABLES
buckets by KEY_BITS bits each, which finds all but about 0.1 % of the pairs at LEAST itself and fewer above it. Bit-sliced
distances of the first half, then of both, link candidates; the texts of each group of candidates meet once, and only
links whose similarity is LEAST or more by count of the sets stay.

Defined cases: a text without words (null, empty) has fingerprint zero and is linked like any other; a text with fewer
words than a shingle is one shingle; an empty table gives an empty result; rows repeated with one doc_id are one node
if their texts agree, and each row is returned; a row whose doc_id is null is returned, and never names a component;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, hot_from, joined_hot, shuffle_partitions, table
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
SPLIT = 4096
#: Words of a shingle and least similarity of similar().
WORDS, LEAST = 5, 0.8
#: Buckets of a 128-bit fingerprint and their bits. At LEAST, 64 bits differ in 10 +- 3 and 128 in 19 +- 4.
TABLES, KEY_BITS, HALF, BOTH = 64, 14, 19, 33
#: Tables whose links name nodes before those of the others are made.
FIRST = 4
#: Texts of a group of candidates that meet in a task are twice as many at most.
MEET = 512
#: Rows compared at once in a task, and shingles whose bits are counted at once.
ROWS, COUNTED = 1 << 17, 1 << 16
_FULL = (1 << 64) - 1


def masks(radius: int) -> list[tuple[int, int]]:
    """Bits of each two of radius + 2 parts: so many differing bits leave two parts alone."""
    parts = np.array_split(np.arange(64), radius + 2)
    return [(sum(1 << int(b) for part in two for b in parts[part]), 0) for two in combinations(range(radius + 2), 2)]


def sampled(tables: int = TABLES, bits: int = KEY_BITS) -> list[tuple[int, int]]:
    """Bits of both halves that make the keys of similar()."""
    rng = np.random.default_rng(SEED)
    chosen = [sum(1 << int(b) for b in rng.choice(128, bits, replace=False)) for _ in range(tables)]
    return [(m & _FULL, m >> 64) for m in chosen]


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z only, and only ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :]
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, COUNTED):
        h = np.array([of(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + COUNTED)].tolist(), last[at : at + COUNTED].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(hashed, "doc_id long, fp long")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near(fps: np.ndarray, start: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), j < i, of fingerprints within the radius, where start[i] <= j; start: where i's bucket begins."""
    n, wide = len(fps), 64
    lanes = np.zeros(-(-n // wide) * wide, np.uint64)
    lanes[:n] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, wide, 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64, -1)  # [bit, block]
    first, last = start // wide, (np.arange(n) - 1) // wide
    blocks = np.where(np.arange(n) > start, last - first + 1, 0)
    ends = np.cumsum(blocks)
    at = 0
    while at < n:  # as many rows at once as have ROWS blocks together, or one row
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, "right")))
        q = np.repeat(np.arange(at, upto), blocks[at:upto])
        k = first[q] + np.arange(len(q)) - np.repeat(ends[at:upto] - blocks[at:upto], blocks[at:upto]) + (ends[at - 1] if at else 0)
        at = upto
        if not len(q):
            continue
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        low = np.clip(start[q] - k * wide, 0, wide - 1).astype(np.uint64)
        high = np.clip(q - k * wide, 1, wide)
        live = (full << low) & (full >> (wide - high).astype(np.uint64))
        ones, twos, fours, over = (np.zeros(len(q), np.uint64) for _ in range(4))
        high = [np.zeros(len(q), np.uint64) for _ in range(3, radius.bit_length())]  # eights and more, where the radius needs them
        own = fps[q]
        for p in range(0, 64, 8):
            d = [planes[p + i, k] ^ (np.uint64(0) - ((own >> np.uint64(p + i)) & np.uint64(1))) for i in range(8)]
            ones, t1 = _add(ones, d[0], d[1])
            ones, t2 = _add(ones, d[2], d[3])
            twos, f1 = _add(twos, t1, t2)
            ones, t1 = _add(ones, d[4], d[5])
            ones, t2 = _add(ones, d[6], d[7])
            twos, f2 = _add(twos, t1, t2)
            fours, carry = _add(fours, f1, f2)
            for c, plane in enumerate(high):
                high[c], carry = plane ^ carry, plane & carry
            over |= carry
            live &= ~(over | _above([ones, twos, fours, *high], radius))
            alive = live != 0
            if not alive.all():  # abandon blocks all of whose lanes exceed the radius
                q, k, own, live, ones, twos, fours, over = (x[alive] for x in (q, k, own, live, ones, twos, fours, over))
                high = [x[alive] for x in high]
            if not len(q):
                break
        if len(q):
            row, lane = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[row], k[row] * wide + lane


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter bits, the lowest first, are over the radius."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for c in range(len(counter) - 1, -1, -1):
        if radius >> c & 1:
            equal = equal & counter[c]
        else:
            above |= equal & counter[c]
            equal = equal & ~counter[c]
    return above


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the groups of u and v: label has the smallest index of each group."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def links(nodes: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """u, v: links between reps of nodes(fp, rep), enough to connect whatever is within the radius."""
    return _linked(nodes.select("fp", F.lit(0).cast("long").alias("fp2"), "rep"), masks(radius), radius, 128, split)


def candidates(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """node, component of the nodes(fp, fp2, rep) that may be similar to another.

    By the first tables each node takes the smallest node it is linked to as its name; the others then give links
    between the few names of a large group alone, not one for each node and table.
    """
    by = sampled()
    begun = cut(_linked(nodes.select("fp", "fp2", "rep"), by[:FIRST], HALF, BOTH, split))
    names = begun.groupBy("u").agg(F.min("v").alias("name"))
    named = nodes.join(names, nodes["rep"] == names["u"], "left").select("fp", "fp2", F.coalesce("name", "rep").alias("rep"))
    return components(begun.unionByName(_linked(named, by[FIRST:], HALF, BOTH, split)))


def _linked(nodes: DataFrame, by: list[tuple[int, int]], radius: int, both: int, split: int) -> DataFrame:
    """u, v: links enough to connect what shares a bucket, with fp within the radius and fp, fp2 within `both` bits."""
    spark = nodes.sparkSession
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    made = F.array(*(F.struct(signed(m).alias("m"), signed(m2).alias("m2")) for m, m2 in by))
    key = F.xxhash64(F.col("fp").bitwiseAND(F.col("mask.m")), F.col("fp2").bitwiseAND(F.col("mask.m2")))
    keyed = nodes.select("fp", "fp2", "rep", F.posexplode(made).alias("part", "mask")).select("fp", "fp2", "rep", "part", key.alias("key"))
    large = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    keyed = keyed.join(large, ["part", "key"])  # a fingerprint alone in its bucket goes no further
    chunks = F.ceil(F.col("n") / split).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keyed = keyed.select("part", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "fp2", "rep")
    cell = ["part", "key", "a", "b"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= ROWS:
                rows = pa.Table.from_batches(held)
                stop = _starts(rows)[-1]  # the last bucket may go on
                if stop:
                    yield from found(rows.slice(0, stop))
                held = rows.slice(stop).combine_chunks().to_batches()
                size = rows.num_rows - stop
        if size:
            yield from found(pa.Table.from_batches(held))

    def _starts(rows: pa.Table) -> np.ndarray:
        columns = [rows.column(c).to_numpy() for c in cell]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.maximum.accumulate(np.where(np.concatenate(([True], new)), np.arange(rows.num_rows), 0))

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        fps, reps = rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()
        more = rows.column("fp2").to_numpy().view(np.uint64)
        starts = _starts(rows)
        first, same = np.unique(np.stack((starts, reps)), axis=1, return_index=True, return_inverse=True)[1:]
        label = first[same.ravel()]  # what has one rep in a bucket is linked
        for i, j in near(fps, starts, radius):
            close = np.bitwise_count(fps[i] ^ fps[j]) + np.bitwise_count(more[i] ^ more[j]) <= both
            merge(label, i[close], j[close])
        least = reps.copy()
        np.minimum.at(least, label, reps)
        v = least[label]
        u, v = np.unique(np.stack((reps, v))[:, v != reps], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = keyed.repartition(shuffle_partitions(spark), *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(linked, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs(doc_id, text)."""
    rows = cut(fingerprints(docs))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    named = components(links(nodes.where("rep is not null"), radius))
    classes = nodes.join(named, nodes["rep"] == named["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return joined_hot(rows, classes, ["fp"], hot_from(nodes)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes | None) -> np.ndarray:
    """The 128-bit hashes of a text's distinct runs of WORDS words, sorted."""
    words = (text or b"").lower().split()
    of = xxhash.xxh128_digest
    found = {of(b" ".join(words[i : i + WORDS]), SEED) for i in range(max(1, len(words) - WORDS + 1))} if words else set()
    return np.frombuffer(b"".join(sorted(found)), "S16")


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """Both halves of a set's fingerprint: the majority bits of its members."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = np.frombuffer(hashes[at : at + COUNTED].tobytes(), np.uint8).reshape(-1, 16)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return tuple(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64).tolist())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fp, fp2 and the hash of the whole set (same, same2) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column("text")]
            made = np.array([sketch(s) for s in sets], np.int64).reshape(-1, 2)
            whole = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for x in (made, whole) for c in x.T)], ["doc_id", "fp", "fp2", "same", "same2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(hashed, "doc_id long, fp long, fp2 long, same long, same2 long")


def alike(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """The smallest index of each set's group: sets whose Jaccard similarity is `least` or more are linked."""
    label, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    members = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    before = ends - sizes
    held = np.zeros(members.max(initial=-1) + 1, np.int64)
    for i in range(len(sets) - 1):
        if (label == label[0]).all():
            break
        own = members[before[i] : ends[i]]
        held[own] = 1
        counts = np.concatenate(([0], np.cumsum(held[members[ends[i] :]])))
        both = counts[ends[i + 1 :] - ends[i]] - counts[before[i + 1 :] - ends[i]]
        held[own] = 0
        j = i + 1 + np.flatnonzero(both >= least * (sizes[i] + sizes[i + 1 :] - both) - 1e-9)
        merge(label, np.full(len(j), i), j)
    return label


def verified(docs: DataFrame, groups: DataFrame, meet: int = MEET) -> DataFrame:
    """u, v: links between the nodes of groups(node, component) whose texts are similar, counted out."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / meet).cast("int")
    placed = joined_hot(groups, sizes, ["component"], hot_from(sizes)).withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    placed = cut(placed.select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))

    def counted(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        text = rows.column("text")
        label = alike([shingles(text[int(i)].as_py()) for i in order])
        nodes = nodes[order]
        apart = label != np.arange(len(nodes))
        return pa.table({"u": nodes[apart], "v": nodes[label[apart]]})

    return texts.join(bounded(placed), "node").groupBy("component", "a", "b").applyInArrow(counted, "u long, v long")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row of docs(doc_id, text): texts are linked whose sets of WORDS words have similarity LEAST."""
    rows = cut(sketches(docs))
    nodes = cut(rows.groupBy("same", "same2").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.count("*").alias("n")))
    groups = cut(candidates(nodes.where("rep is not null")))
    named = components(verified(docs, groups))
    classes = nodes.join(named, nodes["rep"] == named["node"], "left").select("same", "same2", "n", F.coalesce("component", "rep").alias("component_id"))
    return joined_hot(rows, classes, ["same", "same2"], hot_from(nodes)).select("doc_id", "component_id")


def one_of_similar(docs: DataFrame) -> DataFrame:
    """one_of_each() by similar()."""
    return _first_of(docs, similar(docs))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id names their group, with all their columns.

    Of rows repeated with one doc_id one stays; rows without a doc_id stay.
    """
    return _first_of(docs, near_duplicates(docs, radius))


def _first_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    names = F.max(F.col("doc_id") == F.col("component_id"))
    ids = classes.where("doc_id is not null").groupBy("doc_id").agg(names.alias("names"), F.count("*").alias("n"))
    ids = cut(ids.where("not names or n > 1").withColumnRenamed("doc_id", "__payloom_id"))
    gone = bounded(ids.where("not names").select("__payloom_id"))
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("__payloom_id"), "left_anti")
    again = ids.where("names").select("__payloom_id")
    if again.isEmpty():
        return kept
    again = bounded(again)
    same = F.col("doc_id").cast("long") == F.col("__payloom_id")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
