"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted in Spark, merged into removal intervals.

A document's words are hashed, and the windows' polynomial hashes (modulo 2^64, odd base) follow from prefix sums. A
task counts the windows of a chunk of documents first: of equal ones only the first goes on, the others are removed
already, so that a window of very many documents is a row for each chunk. Windows are dealt by their hash's leading bits
into buckets, as packed columns and not row by row; a bucket tells which first window of all chunks comes first, and all
others' words are removed. Removed windows go to groups of documents, where they merge into one row of intervals for each
document; that row is joined with the text, and the words outside the intervals are kept.

There are as many buckets and groups as the texts' bytes ask for (a window takes two bytes of text at least), so that
none has more than BUCKET windows, whatever the table's size, but for chunks that repeat one window; PARTITIONS tasks
at most take them, one after the other. Texts are only ever held in batches.

Two different windows are taken for equal with a chance of 2^-64 a pair.

Defined cases: a null or empty text has no words; a text of fewer words than a window loses none; an empty table gives an
empty result; a row whose doc_id is null is returned, after and compared with nothing; rows repeated with one doc_id must
be equal, and then none is earlier than another and each row is returned; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, shuffle_partitions, table

WINDOW = 20
#: Odd; its inverse modulo 2^64 turns sums from a text's start into sums from a window's start.
BASE = 0xD6E8FEB86659FD93
#: Windows that a task counts together, and windows of a bucket at most.
CHUNK, BUCKET = 1 << 21, 1 << 21
#: Tasks among which buckets are dealt, at most, unless Spark is set to more.
PARTITIONS = 1 << 15
#: Numbers from which packed columns are compressed.
COMPRESSED = 64
INTERVALS = 1


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes: at ASCII spaces only


def window_hashes(words: list[bytes], size: int = WINDOW) -> np.ndarray:
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    power, inverse = _powers(len(words))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(words)], dtype=np.uint64)))
    found = (sums[size:] - sums[:n]) * inverse[:n]
    found ^= found >> np.uint64(32)  # low bits are weaker than high ones
    found *= np.uint64(0x9E3779B97F4A7C15)
    return found ^ (found >> np.uint64(29))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(12, n.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte plane by byte plane and compressed: of sorted and small ones little is left. A few stay as they are."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(n, -1).T).tobytes() for c in columns)
    return n.to_bytes(8, "little") + (zstandard.compress(planes, 1) if n >= COMPRESSED else planes)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, found = int.from_bytes(data[:8], "little"), 0, []
    planes = zstandard.decompress(data[8:]) if n >= COMPRESSED else data[8:]
    for kind in kinds:
        size = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return found


def first_of_each(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows in order of hash, and whether each is the first of its hash, or equal to the first."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    first = np.ones(len(s), bool)
    twice = ~new
    twice[:-1] |= ~new[1:]
    at = np.flatnonzero(twice)
    if len(at):  # put only those that repeat in order
        mine = order[at]
        fine = np.lexsort((start[mine], doc[mine], s[at]))
        order[at] = mine[fine]
        begins = np.flatnonzero(new[at])
        head = order[at][np.repeat(begins, np.diff(np.append(begins, len(at))))]
        first[at] = (doc[order[at]] == doc[head]) & (start[order[at]] == start[head])
    return order, first


def intervals(doc: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals (doc, start, end) of words that the runs beginning at start cover."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = start + (size[order] if isinstance(size, np.ndarray) else size)
    bounds = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    group = np.cumsum(np.concatenate(([False], doc[1:] != doc[:-1])))
    reach = (np.maximum.accumulate(group * (1 << 40) + end) - group * (1 << 40)).astype(end.dtype)  # the farthest end so far in the document
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    new[bounds] = True
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _counted(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """bucket, kind, data: packed first windows of chunks, and packed intervals that chunks remove themselves."""
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def emit(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x for _, x in held])
        doc = np.repeat(np.array([d for d, _ in held], np.int64), [len(x) for _, x in held])
        start = np.concatenate([np.arange(len(x), dtype=np.int64) for _, x in held])
        order, first = first_of_each(h, doc, start)
        again = order[~first]
        rows = []
        if len(again):
            d, s, e = intervals(doc[again], start[again], size)
            rows.append((int(h[again[0]] >> shift) if buckets > 1 else 0, INTERVALS, pack(d, s.astype(np.int32), e.astype(np.int32))))
        order = order[first]
        s = h[order]
        ends = np.searchsorted(s, np.arange(1, buckets, dtype=np.uint64) << shift) if buckets > 1 else []
        for k, part in enumerate(np.split(order, ends)):
            if len(part):
                rows.append((k, 0, pack(h[part], doc[part], start[part].astype(np.int32))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "data"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = window_hashes(words_of(x.as_py()), size)
                if len(found):
                    held.append((d, found))
                    n += len(found)
                if n >= CHUNK:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(counted, "bucket int, kind int, data binary")


def removals(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, data: the packed maximal intervals of words to remove of each document that loses some."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << (max(1, -(-text_bytes // (2 * BUCKET))) - 1).bit_length()
    # a task takes its buckets one after the other, so that their number may be larger than any scheduler's tasks
    partitions = min(buckets, max(shuffle_partitions(docs.sparkSession), PARTITIONS))

    def later(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, start, end = [], [], []
        for x in pdf["data"][pdf["kind"] == INTERVALS]:
            d, s, e = unpack(x, np.int64, np.int32, np.int32)
            doc, start, end = [*doc, d], [*start, s.astype(np.int64)], [*end, e.astype(np.int64)]
        packed = [unpack(x, np.uint64, np.int64, np.int32) for x in pdf["data"][pdf["kind"] == 0]]
        if packed:
            h, d, s = (np.concatenate(c) for c in zip(*packed, strict=True))
            order, first = first_of_each(h, d, s)
            again = order[~first]
            d, s, e = intervals(d[again], s[again].astype(np.int64), size)
            doc, start, end = [*doc, d], [*start, s], [*end, e]
        d, s, e = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (doc, start, end))
        d, s, e = intervals(d, s, e - s)
        group = _group(d, buckets)
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(np.diff(group[order], prepend=-1))
        rows = [(int(group[p[0]]), pack(d[p], s[p].astype(np.int32), e[p].astype(np.int32))) for p in np.split(order, begins[1:]) if len(p)]
        return pd.DataFrame(rows, columns=["group", "data"]).astype({"group": np.int64})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        d, s, e = (np.concatenate(c) for c in zip(*(unpack(x, np.int64, np.int32, np.int32) for x in pdf["data"]), strict=True))
        d, s, e = intervals(d, s.astype(np.int64), (e - s).astype(np.int64))
        begins = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        parts = zip(np.split(s.astype(np.int32), begins[1:]), np.split(e.astype(np.int32), begins[1:]), strict=True)
        return pd.DataFrame({"doc_id": d[begins], "data": [pack(a, b) for a, b in parts]})

    counted = _counted(docs, buckets, size).repartition(partitions, "bucket").groupBy("bucket").applyInPandas(later, "group long, data binary")
    return counted.repartition(partitions, "group").groupBy("group").applyInPandas(merged, "doc_id long, data binary")


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    """The leading bits of a product; groups is a power of two."""
    mixed = (doc.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - groups.bit_length())).astype(np.int64) if groups > 1 else np.zeros(len(doc), np.int64)


def deduplicate(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (text) of every row of docs(doc_id, text)."""
    return _kept(docs, "kept", lambda kept: kept.decode("utf-8", "replace"), size)


def _kept(docs: DataFrame, name: str, last, size: int) -> DataFrame:
    names = ["doc_id", "n_words", "n_removed", name]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, gone in zip(b.column("text"), b.column("data"), strict=True):
                words = words_of(text.as_py())
                keep, removed, at = [], 0, 0
                for s, e in zip(*(x.tolist() for x in unpack(gone.as_py(), np.int32, np.int32)), strict=True) if gone.is_valid else ():
                    keep += words[at:s]
                    removed += e - s
                    at = e
                rows.append((len(words), removed, last(b" ".join(keep + words[at:]))))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    gone = bounded(cut(removals(docs, size)))
    nameless = texts.where("doc_id is null").withColumn("data", F.lit(None).cast("binary"))
    with_gone = texts.where("doc_id is not null").join(gone, "doc_id", "left").unionByName(nameless)
    return with_gone.mapInArrow(cleaned, f"doc_id long, n_words long, n_removed long, {name} string")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(table(spark, sf_dir, "documents"), "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest(), WINDOW)


QUERIES = {"op6_substring": op6_substring}
ORACLE_SQL = {
    "op6_substring": f"""
with docs as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
words as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from docs),
windows as (
  select doc_id, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and {WINDOW - 1} following) as w,
         count(*) over (partition by doc_id order by i rows between current row and {WINDOW - 1} following) as n
  from words),
hashed as (select doc_id, i, hash(w) as h, md5(w) as m from windows where n = {WINDOW}),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by h, m order by doc_id, i) as k from hashed) where k > 1),
marked as (
  select w.doc_id, w.i, w.word, coalesce(max(a.i) over (partition by w.doc_id order by w.i rows between {WINDOW - 1} preceding and current row), -1000) > w.i - {WINDOW} as gone
  from words w left join again a using (doc_id, i)),
kept as (select doc_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept from marked group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from docs d left join kept k using (doc_id)
"""
}
