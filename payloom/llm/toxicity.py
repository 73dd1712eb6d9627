"""Toxicity: a linear classifier on character n-grams whose presence is scaled by naive Bayes log-count ratios.

Training: a bounded sample of labelled rows (SAMPLE rows and CHARACTERS of text, half of each for either class, in the
order of a hash of doc_id, texts of more than LONGEST characters left out) is turned into hashed n-grams; a task counts the ratio of each n-gram, then fits a
logistic regression on the scaled presences, weighted back to the classes' shares among all labelled rows. Rows whose
crc32(doc_id) mod 5 is 0 are held out. Scoring maps whole texts, one by one, and shuffles nothing.

Defined cases: a null text counts as empty and gets the score of the bias alone; a label that is null, or whose doc_id
is null, is ignored; a document labelled more than once has its largest label; without labels of both classes the score
is the smoothed share of label 1; where fewer than FEWEST rows of either class were learnt from, no document is removed; an empty table gives an empty result; repeated rows are scored one by one; columns
besides doc_id and text are never read by a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Most labelled rows used for fitting.
SAMPLE = 4000
#: Most characters of all texts used for fitting, and of one of them: a text has three n-grams a character at most, of four
#: bytes each, so that task holds 12 * CHARACTERS bytes of them.
CHARACTERS, LONGEST = 12_000_000, 50_000
BITS, ORDERS = 19, (3, 4, 5)
#: Rows of either class below which without_toxic() removes nothing.
FEWEST = 10
#: Characters hashed at once, so that memory is bounded for texts of any length.
CHUNK = 1 << 20
#: Rows whose n-grams are counted at once in a round of the fit.
FITTED = 200
SMOOTH, RIDGE, ROUNDS = 1.0, 1e-5, 25


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    #: Rows of the rarer class that it was fitted on.
    rows: int = 0

    def score(self, found: np.ndarray) -> float:
        if not len(found):
            return float(_logistic(self.bias))
        return float(_logistic(self.bias + self.weights[found].sum(dtype=np.float64) / np.sqrt(len(found))))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def ngrams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted buckets of the n-grams of a text in lower case, with a space on either side. seen: false everywhere, before and after."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), np.uint32)
    if not text:
        return np.empty(0, np.int64)
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + max(ORDERS) - 1].astype(np.uint64)
        grams = part
        for n in range(2, max(ORDERS) + 1):
            if len(part) < n:
                break
            grams = grams[:-1] * np.uint64(1_000_003) + part[n - 1 :]
            if n in ORDERS:
                seen[((grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may be learnt from."""
    rows = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Model:
    rows = labelled(labels)
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    known = docs.select("doc_id", F.length("text").alias("n")).where(F.col("n") <= LONGEST).join(rows, "doc_id")
    known = known.groupBy("doc_id", "toxic").agg(F.sum("n").alias("n")).where(F.col("n") <= LONGEST)
    first = [known.where(F.col("toxic") == y).orderBy(*order).limit(sample // 2) for y in (1, 0)]
    upto = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # of `sample` rows
    chosen = cut(first[0].unionByName(first[1]).withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= characters // 2).select("doc_id", "toxic"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            found = [packed(ngrams(x.as_py(), seen)) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(found, pa.binary())], ["toxic", "found"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, f) for b in batches for y, f in zip(b.column("toxic").to_pylist(), b.column("found").to_pylist(), strict=True)]
        y = np.array([r[0] for r in rows], float)
        model = fit((unpacked(f) for _, f in _drained(rows)), y, counts)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.rows], pa.int32())], ["weights", "bias", "rows"])

    # at most `sample` rows of two numbers are broadcast; what is fitted on is bounded, so one task does it, and not the driver
    sampled = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(hashed, "toxic int, found binary"))
    got = sampled.coalesce(1).mapInArrow(fitted, "weights binary, bias double, rows int").first()
    if got is None:  # not even an empty partition
        return fit([], np.empty(0), counts)
    return Model(np.frombuffer(got["weights"], np.float32), got["bias"], got["rows"])


def _drained(rows: list) -> Iterator:
    """The rows in order, each forgotten when the next is asked for."""
    rows.reverse()
    while rows:
        yield rows.pop()


def packed(found: np.ndarray) -> bytes:
    """Sorted numbers as compressed steps, byte plane by byte plane."""
    steps = np.diff(found, prepend=0).astype(np.uint32)
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.int64).astype(np.int32)


def fit(found: Iterable[np.ndarray], y: np.ndarray, counts: dict[int, int]) -> Model:
    """found: the n-grams of each row."""
    total = counts.get(0, 0) + counts.get(1, 0)
    share = (counts.get(1, 0) + 1) / (total + 2)
    bias = float(np.log(share / (1 - share)))
    size = 1 << BITS
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(np.zeros(size, np.float32), bias)
    blocks = [slice(i, i + FITTED) for i in range(0, len(y), FITTED)]  # of so few rows that their numbers need little memory
    at, sizes, rows = [], np.zeros(len(y), np.int64), iter(found)
    for b in blocks:
        some = list(islice(rows, FITTED))
        sizes[b] = [len(f) for f in some]
        at.append(np.concatenate(some))
    p, q = np.full(size, SMOOTH), np.full(size, SMOOTH)
    for a, b in zip(at, blocks, strict=True):
        p += np.bincount(a, np.repeat(y[b], sizes[b]), size)
        q += np.bincount(a, np.repeat(1 - y[b], sizes[b]), size)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    length = 1 / np.sqrt(np.maximum(1, sizes))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, g, total = w[:-1] * ratio, np.zeros(size + 1), 0.0
        for a, b in zip(at, blocks, strict=True):
            n = sizes[b]
            s = w[-1] + _sums(scaled[a], n) * length[b]
            e = (_logistic(s) - y[b]) * weight[b]
            total += float((weight[b] * np.logaddexp(0, np.where(y[b] == 1, -s, s))).sum())
            g[:-1] += np.bincount(a, np.repeat(e * length[b], n), size)
            g[-1] += e.sum()
        g[:-1] = g[:-1] * ratio + RIDGE * w[:-1]
        return total + RIDGE / 2 * float(w[:-1] @ w[:-1]), g

    w = minimised(loss, np.append(np.zeros(size), bias))
    return Model((w[:-1] * ratio).astype(np.float32), float(w[-1]), int(min(y.sum(), len(y) - y.sum())))


def minimised(loss, w: np.ndarray, rounds: int | None = None, memory: int = 3) -> np.ndarray:
    """Where a convex function is least, by L-BFGS with backtracking; loss gives value and gradient."""
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds or ROUNDS):
        d, kept = -g, []
        for s, t, r in reversed(past):
            kept.append(r * float(s @ d))
            d = d - kept[-1] * t
        if past:
            s, t, _ = past[-1]
            d = d * (float(s @ t) / float(t @ t))
        for (s, t, r), k in zip(past, reversed(kept), strict=True):
            d = d + (k - r * float(t @ d)) * s
        slope, step = float(g @ d), 1.0 if past else 1 / max(1e-12, float(np.abs(g).sum()))
        if slope > -1e-9:
            break
        for _ in range(20):
            new, new_g = loss(w + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = step * d, new_g - g
        w, value, g = w + s, new, new_g
        if (st := float(s @ t)) > 1e-12:
            past = [*past, (s, t, 1 / st)][-memory:]
    return w


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of the given sizes."""
    return np.where(sizes > 0, np.add.reduceat(np.append(values, 0.0), np.cumsum(sizes) - sizes), 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            scores = np.array([shared.value.score(ngrams(x.as_py(), seen)) for x in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; all of them where too little was learnt."""
    if model.rows < FEWEST:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            yield b.filter(pa.array([shared.value.score(ngrams(x.as_py(), seen)) < 0.5 for x in b.column("text")], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
