"""Nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking, and bounds that leave nothing out.

Coarse centroids and the residuals' codebooks are fitted on a bounded sample (SAMPLE vectors, chosen by a hash of their
ids); every vector is indexed. Lists grow with the square root of the number of vectors. What a query finds in the sample
gives the least score that its k nearest have. A list is probed unless its centroid and the farthest of its vectors show that none
in it reaches that. In a list a query looks up the inner products of its parts with all codewords once, adds them up by the
vectors' codes, and scores those exactly, from the original vectors, that may be among the k best by the length of what
their codes leave out. So results are those of brute force, whatever the rows; how much is scored depends on how well codes
fit. Equal vectors are one there, with the smallest ids that may be in a result.

A list that holds more than VECTORS vectors, or is probed by more than ASKED queries, is cut into a grid of cells of
that size at most, so that no task holds more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose
length is not the commonest one of the sample, nor rows without vec_id; with fewer candidates than asked for, all are
returned; an empty table gives an empty result; rows repeated with one vec_id are candidates each, but one query; a
query's own id is no candidate; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Vectors used for fitting at most, and lists at most: the square root of the number of vectors, if that is less.
SAMPLE, LISTS = 20_000, 1024
#: Vectors of the sample that try shares of the lists, and how many of their neighbours the lists must hold (Index.share).
TRIED, WANTED = 200, 0.96
ROUNDS, PARTS, CODES = 12, 16, 256
VECTORS, ASKED, AT_ONCE = 20_000, 4_000, 128
#: Candidates scored exactly at once; where more than one vector in DENSE is one, a product of matrices narrows them first.
SCORED, DENSE = 1 << 16, 16
SEED = 7


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        if (~full).any():
            centres[~full] = x[rng.choice(len(x), (~full).sum())]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, 1) for i in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


def _unit(q: np.ndarray) -> np.ndarray:
    """Rows of length 1 in the same directions."""
    q = q.astype(np.float64)
    q = q / np.abs(q).max(1, keepdims=True)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


class Index:
    """Centroids and codebooks, of vectors divided by 2^exponent, and ids and vectors of the sample."""

    def __init__(self, sample: np.ndarray, lists: int, exponent: int = 0, ids: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        self.exponent = exponent
        sample = self.small(sample).astype(np.float32)
        self.centres = kmeans(sample, lists, rng)
        self.cuts = [p for p in np.array_split(np.arange(sample.shape[1]), PARTS) if len(p)]
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.books = [kmeans(rest[:, p], CODES, rng, ROUNDS // 2) for p in self.cuts]
        self.known_ids, row = np.unique(np.arange(len(sample)) if ids is None else ids, return_index=True)
        self.known = sample[row]
        #: What sums of single precision may be off by, as a share of the lengths multiplied.
        self.rounding = (sample.shape[1] + 32) * 2.4e-7

    def small(self, x: np.ndarray) -> np.ndarray:
        return np.ldexp(x.astype(np.float64), -self.exponent)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        x = self.small(x).astype(np.float32)
        at = nearest(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([nearest(rest[:, p], book) for p, book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def far(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How far each row is from the centroid of its list."""
        return np.linalg.norm(self.small(x) - self.centres[at], axis=1)

    def bounded(self, q: np.ndarray) -> np.ndarray:
        """Whether scores of a query stay within doubles; bounds say nothing of others."""
        return np.abs(np.log2(np.abs(q.astype(np.float64)).max(1)) + self.exponent) < 960

    def least(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """What the k nearest of each query reach, by its unit vector: the k-th best of the sample, less rounding."""
        if len(self.known) <= k:
            return np.full(len(q), -np.inf)
        scores = _unit(q).astype(np.float32) @ self.known.T
        scores[ids[:, None] == self.known_ids] = -np.inf
        slack = 2 * self.rounding * float(np.linalg.norm(self.known.astype(np.float64), axis=1).max())
        return np.where(self.bounded(q), np.partition(scores, len(self.known) - k, 1)[:, len(self.known) - k].astype(np.float64) - slack, -np.inf)

    def reached(self, q: np.ndarray, least: np.ndarray, sizes: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """Lists of each query that may hold what scores `least`."""
        full = np.flatnonzero(sizes)
        centres = self.centres[full].astype(np.float64)
        most = _unit(q) @ centres.T + far[full] + self.rounding * (np.linalg.norm(centres, axis=1) + far[full])
        return [full[m >= t] for m, t in zip(most, least, strict=True)]

    def share(self, sample: np.ndarray, k: int) -> float:
        """The smallest share of the lists that holds WANTED of the k nearest of TRIED vectors of the sample."""
        sample = self.small(sample).astype(np.float32)
        at, tried = nearest(sample, self.centres), np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
        scores = sample[tried] @ sample.T
        scores[np.arange(len(tried)), tried] = -np.inf
        best = np.argsort(-scores, 1, kind="stable")[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort(-(sample[tried] @ self.centres.T), 1, kind="stable"), 1)  # of each list in a query's order
        needed = np.sort(place[np.arange(len(tried))[:, None], at[best]].ravel()) + 1
        return float(needed[min(len(needed) - 1, int(np.ceil(WANTED * len(needed))))]) / len(self.centres) if len(needed) else 1.0

    def probe(self, q: np.ndarray, sizes: np.ndarray, k: int, probes: float) -> list[np.ndarray]:
        """Lists of each query: the best ones, until there is the share `probes` of those that are not empty, and 2k + 1 candidates."""
        full, q = np.flatnonzero(sizes), _unit(q).astype(np.float32)
        order = full[np.argsort(-(q @ self.centres[full].T), 1, kind="stable")]
        upto = np.maximum(int(np.ceil(probes * len(full))), 1 + (np.cumsum(sizes[order], 1) < 2 * k + 1).sum(1))
        return [o[:n] for o, n in zip(order, upto, strict=True)]

    def search(self, ids: np.ndarray, q: np.ndarray, centre: int, vec_ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, vector ids and scores of the k best of one list for each query, as far as they score `least`."""
        row, ids_of, first, count = _different(vec_ids, vectors, k)
        codes, vectors = codes[row], vectors[row].astype(np.float64)
        small, middle = self.small(vectors), self.centres[centre].astype(np.float64)
        rest = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1).astype(np.float64)
        left_out = np.linalg.norm(small - middle - rest, axis=1)
        left_out += self.rounding * (np.linalg.norm(middle) + np.linalg.norm(rest, axis=1) + left_out)
        longest = float(np.linalg.norm(small, axis=1).max())
        most = min(k + 1, len(row))  # one may be the query itself
        nth = lambda x: np.partition(x, len(row) - most, 1)[:, len(row) - most]
        for at in range(0, len(q), AT_ONCE):
            some, asked = q[at : at + AT_ONCE], ids[at : at + AT_ONCE]
            unit = _unit(some)
            single = unit.astype(np.float32)
            near = np.repeat((single @ self.centres[centre])[:, None], len(row), 1)
            for j, (p, book) in enumerate(zip(self.cuts, self.books, strict=True)):
                near += (single[:, p] @ book.T)[:, codes[:, j]]
            bar = nth(near - left_out)
            bar = np.where(self.bounded(some), bar if least is None else np.maximum(bar, least[at : at + AT_ONCE]), -np.inf)
            of, best = np.nonzero(near + left_out >= bar[:, None])
            if len(of) * DENSE > near.size:
                product = unit @ small.T
                bar = np.where(bar > -np.inf, np.maximum(bar, nth(product)), bar) - 1e-12 * longest
                of, best = np.nonzero(product >= bar[:, None])
            if not len(of):
                continue
            wide = some.astype(np.float64)
            # summed alike for each row, so equal vectors tie
            exact = np.concatenate([(vectors[best[i : i + SCORED]] * wide[of[i : i + SCORED]]).sum(1) for i in range(0, len(best), SCORED)])
            times = count[best]
            found = ids_of[np.repeat(first[best] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            of, exact = np.repeat(of, times), np.repeat(exact, times)
            other = found != asked[of]
            of, exact, found = of[other], exact[other], found[other]
            order = np.lexsort((found, -exact, of))
            of = of[order]
            order = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
            yield asked[of[np.arange(len(of)) - np.searchsorted(of, of) < k]], found[order], exact[order]


def _different(vec_ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of each different vector; all their ids, as far as the k + 1 smallest go, vector by vector; first one and number of each vector's."""
    flat = np.ascontiguousarray(vectors)
    group = np.unique(flat.view(np.dtype((np.void, flat.dtype.itemsize * flat.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((vec_ids, group))
    group, ids = group[order], vec_ids[order]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    nth = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]))))
    kept = nth - nth[starts][group] <= k  # repeated ids count once, and the query's own is left out later
    count = np.bincount(group[kept])
    return order[starts], ids[kept], np.cumsum(count) - count, count


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))


def neighbours(vectors: DataFrame, is_query: F.Column, k: int, column: str = "embedding", probes: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query; probes: a share of lists to look in, in place of all that may hold one."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    single = "array<float>" in vectors.select(column).dtypes[0][1]
    kind = np.float32 if single else np.float64
    valid = usable(vectors, column)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows at most
    if not sample:
        return spark.createDataFrame([], schema)
    width = Counter(len(r["v"]) for r in sample).most_common(1)[0][0]
    valid = valid.where(F.size("v") == width)
    n, largest = valid.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    lists = max(1, min(LISTS, len(sample), round(n**0.5)))
    learnt = [r for r in sample if len(r["v"]) == width]
    made = Index(np.array([r["v"] for r in learnt], np.float64), lists, int(np.frexp(largest)[1]), np.array([r["vec_id"] for r in learnt]))
    index = spark.sparkContext.broadcast(made)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").values.to_numpy(zero_copy_only=False)
            x = x[b.column("v").offsets[0].as_py() : b.column("v").offsets[-1].as_py()].reshape(-1, width)
            at, codes = index.value.encode(x)
            rows = [b.column("vec_id"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(index.value.far(x, at))]
            yield pa.RecordBatch.from_arrays(rows, ["vec_id", "list", "codes", "v", "far"])

    rows = cut(valid.mapInArrow(encoded, "vec_id long, list int, codes binary, v binary, far double"))
    sizes, far = np.zeros(lists, np.int64), np.zeros(lists)
    for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each list
        sizes[r["list"]], far[r["list"]] = r["n"], r["far"]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                ids, q = part.column("vec_id").to_numpy(), np.frombuffer(b"".join(part.column("v").to_pylist()), kind).reshape(-1, width)
                least = index.value.least(ids, q, k)
                found = index.value.reached(q, least, sizes, far) if probes is None else index.value.probe(q, sizes, k, probes)
                again = pa.array(np.repeat(np.arange(len(q)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(again), pa.array(np.concatenate(found).astype(np.int32)), part.column("v").take(again), pa.array(least).take(again)], ["vec_id", "list", "v", "least"])

    asked = cut(rows.where(is_query).select("vec_id", "v").dropDuplicates(["vec_id"]).mapInArrow(probed, "vec_id long, list int, v binary, least double"))
    probes_of = np.zeros(lists, np.int64)
    for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect():
        probes_of[r["list"]] = r["n"]
    high, wide = (np.maximum(1, -(-n // most)) for n, most in ((sizes, VECTORS), (probes_of, ASKED)))
    first = np.concatenate(([0], np.cumsum(high * wide)))
    grid = spark.createDataFrame([(i, int(f), int(h), int(w)) for i, (f, h, w) in enumerate(zip(first[:-1], high, wide, strict=True))], "list int, first long, high int, wide int")
    grid = F.broadcast(grid)  # LISTS rows
    row = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("high"))
    column_ = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("wide"))
    held = rows.join(grid, "list").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    held = held.select((F.col("first") + row * F.col("wide") + F.col("other")).alias("cell"), "list", "vec_id", "codes", "v")
    wanted = asked.join(grid, "list").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("high") - 1)))
    wanted = wanted.select((F.col("first") + F.col("other") * F.col("wide") + column_).alias("cell"), "vec_id", "v", "least")

    def searched(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        matrix = lambda c, t, n: np.frombuffer(b"".join(c), t).reshape(-1, n)
        found = []
        if len(vs) and len(qs):
            found = list(index.value.search(qs["vec_id"].to_numpy(), matrix(qs["v"], kind, width), int(vs["list"].iloc[0]), vs["vec_id"].to_numpy(), matrix(vs["codes"], np.uint8, len(index.value.cuts)), matrix(vs["v"], kind, width), k, qs["least"].to_numpy()))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": np.int64, "vec_id": np.int64})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    found = held.groupBy("cell").cogroup(wanted.groupBy("cell")).applyInPandas(searched, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op5_ivfpq": op5_ivfpq}
ORACLE_SQL: dict[str, str] = {}
