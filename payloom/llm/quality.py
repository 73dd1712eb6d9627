"""Quality: a factorisation machine over hashed words, statistics of a text's structure and its metadata.

A text has three fields of features: its distinct words, hashed; what share of it is capitals, signs, digits, repeated lines
and the like, each cut into steps; and the declared number of characters against the real one. The score is
w0 + sum(w x) + 1/2 sum over the factors of (sum(v x))^2 - sum((v x)^2): all pairs of features in time linear in their number.

Training: a bounded sample of labelled rows, half of either class, in the order of a hash of doc_id, turned into features by the
tasks that read them; one task fits the weights by adaptive gradient steps, weighted back to the classes' shares among all labelled
rows. Rows whose crc32(doc_id) mod 5 is 0 are held out. Scoring maps whole texts, one by one, and shuffles nothing.

Defined cases: a null or empty text has no words and the statistics of an empty one; a null n_chars is a feature of its own; a label
that is null, or whose doc_id is null, is ignored; a document labelled more than once has its largest label; without labels of both
classes the score is the smoothed share of label 1, which keeps all where there are none; repeated rows are scored one by one; an
empty table gives an empty result; lang, source, doc_id and columns besides text and n_chars are never read by a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Most labelled rows used for fitting, and characters after which no more rows of a class are taken.
SAMPLE, CHARACTERS = 4000, 12_000_000
#: From this score on a document is predicted to be good.
GOOD = 0.3
#: Hashed words are so many bits; each statistic has so many steps.
BITS, STEPS = 17, 16
FACTORS = 6
ROUNDS, ROWS, RATE, RIDGE, PAIRS = 12, 100, 0.1, 2e-4, 2e-3
#: What a field weighs: words share 1, statistics have 1 each.
STATISTICS = ("chars", "words", "word_length", "capitals", "signs", "digits", "spaces", "distinct", "commonest", "lines", "repeated_lines", "bare_words", "sentences", "shouted", "stutters", "declared")
SIZE = (1 << BITS) + len(STATISTICS) * STEPS
#: Kinds of characters; those beyond the table count as small letters.
_SMALL, _CAPITAL, _DIGIT, _BLANK, _SIGN = range(5)
_KINDS = np.array([_BLANK if chr(c).isspace() else _DIGIT if chr(c).isdigit() else _CAPITAL if chr(c).isupper() else _SMALL if chr(c).isalpha() else _SIGN for c in range(0x250)], np.uint8)


def statistics(text: str, n_chars: int | None) -> list[float]:
    """The step of each statistic, before it is cut to 0 ... STEPS - 1."""
    words, lines = text.split(), [x for x in text.splitlines() if x.strip()]
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(codes, len(_KINDS) - 1)], minlength=5)
    n, n_words = max(1, len(codes)), max(1, len(words))
    share = lambda k: _step(k / n)
    counted = Counter(words)
    return [
        np.log2(1 + len(codes)),
        np.log2(1 + len(words)),
        (n - kinds[_BLANK]) / n_words,
        share(kinds[_CAPITAL]),
        share(kinds[_SIGN]),
        share(kinds[_DIGIT]),
        share(kinds[_BLANK]),
        15 * len(counted) / n_words,
        _step(max(counted.values(), default=0) / n_words),
        np.log2(1 + n_words / max(1, len(lines))),
        _step(1 - len(set(lines)) / max(1, len(lines))),
        _step(sum(c for w, c in counted.items() if not any(map(str.isalnum, w))) / n_words),
        _step(sum(c for w, c in counted.items() if w[-1] in ".!?") / n_words),
        _step(sum(c for w, c in counted.items() if w.isupper() and len(w) > 1) / n_words),
        _step(sum(map(str.__eq__, words, words[1:])) / n_words),
        0 if n_chars is None else 1 if n_chars == len(text) else 2,
    ]


def _step(share: float) -> float:
    """Shares in steps that are finer where they are small."""
    return 15 * share**0.5


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features, and their values."""
    text = text or ""
    steps = np.clip(np.array(statistics(text, n_chars)), 0, STEPS - 1).astype(np.int64)
    stats = (1 << BITS) + np.arange(len(steps)) * STEPS + steps
    words = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in set(text.lower().split())), np.int64) & ((1 << BITS) - 1))
    return np.concatenate([words, stats]).astype(np.int32), np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), np.ones(len(stats))]).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        pairs = ((vx.sum(0, dtype=np.float64) ** 2) - (vx.astype(np.float64) ** 2).sum(0)).sum() / 2
        return float(_logistic(self.bias + float(self.weights[at] @ x) + pairs))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the rows that may be learnt from."""
    rows = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return rows.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Machine:
    rows = labelled(labels)
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    known = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(rows, "doc_id").groupBy("doc_id", "quality").agg(F.sum("n").alias("n"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    first = [known.where(F.col("quality") == y).orderBy(*order).limit(sample // 2) for y in (1, 0)]
    before = Window.partitionBy("quality").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # of `sample` rows
    chosen = cut(first[0].unionByName(first[1]).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") <= characters // 2).select("doc_id", "quality"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py(), n) for t, n in zip(b.column("text"), b.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("quality"), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], ["quality", "at", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for b in batches for y, a, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        made = fit(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes())), counts)  # in whichever order they came
        yield pa.RecordBatch.from_arrays([pa.array([made.bias]), *(pa.array([a.astype(np.float32).tobytes()], pa.binary()) for a in (made.weights, made.factors))], ["bias", "weights", "factors"])

    # at most `sample` rows of two numbers are broadcast; what is fitted on is bounded, so one task does it
    sampled = cut(docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").select("quality", "text", "n_chars").mapInArrow(hashed, "quality int, at binary, x binary"))
    got = sampled.coalesce(1).mapInArrow(fitted, "bias double, weights binary, factors binary").first()
    if got is None:  # not even an empty partition
        return fit([], counts)
    return Machine(got["bias"], np.frombuffer(got["weights"], np.float32), np.frombuffer(got["factors"], np.float32).reshape(SIZE, FACTORS))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], counts: dict[int, int]) -> Machine:
    """rows: label, features and values of each."""
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    bias = float(np.log(share / (1 - share)))
    weights, factors = np.zeros(SIZE), np.zeros((SIZE, FACTORS))
    y = np.array([r[0] for r in rows], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Machine(bias, weights.astype(np.float32), factors.astype(np.float32))
    chance = np.random.default_rng(0)
    factors = chance.normal(0, 0.02, factors.shape)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    seen, seen_bias = np.full((SIZE, 1 + FACTORS), 1e-8), 1e-8
    for _ in range(ROUNDS):
        mixed = chance.permutation(len(rows))
        for some in (mixed[i : i + ROWS] for i in range(0, len(mixed), ROWS)):
            sizes = np.array([len(rows[i][1]) for i in some])
            at, here = np.unique(np.concatenate([rows[i][1] for i in some]), return_inverse=True)
            x, row = np.concatenate([rows[i][2] for i in some]).astype(float), np.repeat(np.arange(len(some)), sizes)
            both = np.column_stack([weights[at], factors[at]])
            vx = both[here] * x[:, None]
            sums = np.column_stack([np.bincount(row, vx[:, k], len(some)) for k in range(1 + FACTORS)])
            pairs = (sums[:, 1:] ** 2 - np.column_stack([np.bincount(row, vx[:, k] ** 2, len(some)) for k in range(1, 1 + FACTORS)])).sum(1) / 2
            e = (_logistic(bias + sums[:, 0] + pairs) - y[some]) * weight[some]
            g = np.column_stack([np.ones(len(x)), sums[row, 1:] - vx[:, 1:]]) * (e[row] * x)[:, None]
            g = np.column_stack([np.bincount(here, g[:, k], len(at)) for k in range(1 + FACTORS)]) / len(some)
            g += both * np.array([RIDGE, *[PAIRS] * FACTORS])
            seen[at] += g**2
            both -= RATE * g / np.sqrt(seen[at])
            weights[at], factors[at] = both[:, 0], both[:, 1:]
            seen_bias += e.mean() ** 2
            bias -= RATE * float(e.mean()) / seen_bias**0.5
    return Machine(float(bias), weights.astype(np.float32), factors.astype(np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (1 + FACTORS) numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([shared.value.score(*features(t.as_py(), n)) for t, n in zip(b.column("text"), b.column("n_chars").to_pylist(), strict=True)], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text", "n_chars").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op13_quality": op13_quality}
ORACLE_SQL: dict[str, str] = {}
