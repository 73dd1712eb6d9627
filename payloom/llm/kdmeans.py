"""Lloyd's clustering by kd-tree filtering: vectors are put into trees once, and whole nodes are assigned where one centroid is left.

Vectors are cut into blocks of at most BLOCK, and each block becomes a kd-tree whose nodes hold count, sums and bounding box
in whole numbers. In every round a node keeps those centroids that are not strictly farther than another one from every point of
its box; a node with a single one is assigned whole, by its count and sums, and a leaf with several is resolved exactly. What a
round sends on is, for each task and centroid, a count and 64 sums.

Trees are written to the shared checkpoint folder and read again in each round, so a lost executor costs its blocks only.
The driver holds the CENTROIDS centroids and, in a round, their sums.

Defined cases: vectors of another length than WIDTH, and such that are null or hold null, NaN or infinite components, take
no part; nor do vectors with a component of LARGEST or more, whose squared distances need not fit a long. Rows without a vec_id
are clustered, but do not become a first centroid. Of repeated vec_ids each row counts, ties go by components. With fewer
vectors than CENTROIDS each is a first centroid; equal ones share the smaller number. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Squared distances of smaller whole components fit a long.
LARGEST = 1 << 27
#: Vectors in a tree and in a leaf.
BLOCK, LEAF = 4096, 64


def whole(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and x, the components as whole numbers, of the vectors that take part."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    # NaN is larger than every number here
    sound = (F.size("embedding") == width) & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False)))
    return vectors.where("embedding is not null").where(sound).select(F.col("vec_id").cast("long"), x.cast("array<int>").alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").orderBy(order, "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


# Trees. A tree is four arrays over its nodes, in the order in which they are visited, and the vectors in the order of leaves.


def tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order of the vectors; start, end and the number of nodes of each node's subtree; sums; boxes."""
    order, spans, sums, boxes = np.arange(len(x)), [], [], []

    def grow(start: int, end: int) -> int:
        here, rows = len(spans), x[order[start:end]]
        low, high = rows.min(0), rows.max(0)
        spans.append([start, end, 1])
        sums.append(rows.sum(0, dtype=np.int64))
        boxes.append((low, high))
        axis = int(np.argmax(high.astype(np.int64) - low))
        if end - start > leaf and high[axis] > low[axis]:
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows[:, axis], half)]
            spans[here][2] += grow(start, start + half) + grow(start + half, end)
        return spans[here][2]

    grow(0, len(x))
    return order, np.array(spans, np.int32), np.array(sums), np.array(boxes, np.int32)


def filtered(box: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of the centroids that are left, those that may be nearest to a point of the box, ties included."""
    low, high = box.astype(np.int64)
    near = left[np.argmin(((2 * centroids[left] - (low + high)) ** 2).sum(1))]
    towards = centroids[left] > centroids[near]
    corner = np.where(towards, high, low)  # the point of the box that speaks most for the other one
    farther = ((centroids[left] - corner) ** 2).sum(1) > ((centroids[near] - corner) ** 2).sum(1)
    return left[~farther]


def assigned(x: np.ndarray, spans: np.ndarray, boxes: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, slice, int | np.ndarray]]:
    """node, vectors and their centroid: a number for a whole node, an array for a leaf."""
    at, pending = 0, [(len(spans), np.arange(len(centroids)))]  # up to which node these centroids are left
    while at < len(spans):
        while at >= pending[-1][0]:
            pending.pop()
        start, end, size = (int(n) for n in spans[at])
        left = filtered(boxes[at], centroids, pending[-1][1])
        if len(left) == 1:
            yield at, slice(start, end), int(left[0])
            at += size
        elif size == 1:
            rows = x[start:end].astype(np.int64)
            far = np.stack([((rows - centroids[c]) ** 2).sum(1) for c in left])
            yield at, slice(start, end), left[np.argmin(far, 0)]
            at += 1
        else:
            pending.append((at + size, left))
            at += 1


_TREE = "vec_id array<long>, x binary, spans binary, sums binary, boxes binary"


def trees(vectors: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """One row for each block of vectors."""

    def grown(ids: list, x: np.ndarray) -> pa.RecordBatch:
        order, *arrays = tree(x, leaf)
        data = [x[order].astype(np.int32), *arrays]
        ids = pa.array([ids], pa.list_(pa.int64())).flatten().take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in data)], ["vec_id", "x", "spans", "sums", "boxes"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            parts.append(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            n += b.num_rows
            while n >= block:
                x = np.concatenate(parts)
                yield grown(ids[:block], x[:block])
                ids, parts, n = ids[block:], [x[block:]], n - block
        if n:
            yield grown(ids, np.concatenate(parts))

    return cut(vectors.mapInArrow(built, _TREE))


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for b in batches:
        for k in range(b.num_rows):
            raw = [b.column(i)[k].as_buffer() for i in range(1, 5)]
            x, spans, sums, boxes = (np.frombuffer(r, t) for r, t in zip(raw, (np.int32, np.int32, np.int64, np.int32), strict=True))
            yield b.column(0)[k].values, x.reshape(-1, width), spans.reshape(-1, 3), sums.reshape(-1, width), boxes.reshape(-1, 2, width)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means; those without vectors stay."""
    k, width = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, x, spans, sums, boxes in _read(batches, width):
            for node, rows, of in assigned(x, spans, boxes, centroids):
                if isinstance(of, int):
                    n[of] += rows.stop - rows.start
                    total[of] += sums[node]
                else:
                    for c in np.unique(of):
                        n[c] += (of == c).sum()
                        total[c] += x[rows][of == c].sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array([[int(n[c]), *map(int, total[c])] for c in range(k)], pa.list_(pa.int64()))], ["cluster", "sums"])

    found = forest.mapInArrow(summed, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "s"))
    whole_sums = {(r["cluster"], r["at"]): int(r["s"]) for r in found.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    out = centroids.copy()
    for c in range(k):
        if n := whole_sums.get((c, 0), 0):
            out[c] = [whole_sums[c, i + 1] // n for i in range(width)]
    return out


def assignment(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    width = centroids.shape[1]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, spans, _, boxes in _read(batches, width):
            cluster = np.zeros(len(x), np.int32)
            for _, rows, of in assigned(x, spans, boxes, centroids):
                cluster[rows] = of
            far = ((x.astype(np.int64) - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(far)], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(told, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, width: int = WIDTH, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """The assignment of every vector that takes part, and the centroids."""
    sound = whole(vectors, width)
    centroids = first_centroids(sound, k, seed)
    forest = trees(sound, block, leaf)
    if not len(centroids):  # no vectors, or none with a vec_id
        return sound.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    for _ in range(rounds):
        new = moved(forest, centroids)
        if (new == centroids).all():  # all further rounds would change nothing
            break
        centroids = new
    return assignment(forest, centroids), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _by_cluster(values: list, kind: str) -> Column:
    return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))


def op12_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    inertia = [sums.get(c, 0) for c in range(len(centroids))]
    return found.withColumns({"cluster_inertia": _by_cluster(inertia, "long"), "inertia": F.lit(sum(inertia)).cast("long"), "centroid_sha256": _by_cluster([digest(c) for c in centroids], "string")})


def _sql() -> str:
    """Plain Lloyd rounds, one after the other."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = "select v.vec_id, v.x, unnest(list_sort(list({'far': %s, 'c': c.c}))[1:1]) as best from v cross join %s c group by v.row, v.vec_id, v.x"
    floored = "(s - ((s %% n) + n) %% n) // n".replace("%%", "%")
    parts = [
        f"v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as x from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {WIDTH})",
        f"c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c, x from v qualify c < {CENTROIDS})",
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} as materialized (select best.c as c, x from ({near % (far, f'c{i}')}))")
        parts.append(f"s{i} as (select c, i, sum(x[i])::hugeint as s, count(*) as n from a{i}, range(1, {WIDTH + 1}) r(i) group by all)")
        parts.append(f"m{i} as (select c, list({floored} order by i)::bigint[] as x from s{i} group by c)")
        parts.append(f"c{i + 1} as materialized (select c, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (c))")
    parts.append(f"f as materialized (select vec_id, best.c::int as cluster, best.far::bigint as distance from ({near % (far, f'c{ROUNDS}')}))")
    return (
        "with " + ",\n".join(parts) + "\nselect vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,"
        f" sha256(array_to_string(x, ',')) as centroid_sha256 from f join c{ROUNDS} on c = cluster"
    )


QUERIES = {"op12_kdtree_clusters": op12_kdtree_clusters}
ORACLE_SQL = {"op12_kdtree_clusters": _sql()}
