from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from payloom.llm import kdmeans as km

ROWS = "vec_id bigint, embedding array<float>, label int"


def lloyd(vectors: dict[int, list[float]], k=8, rounds=10):
    """Plain rounds in Python's whole numbers."""
    x = {i: [math.floor(1024 * float(np.float32(c))) for c in v] for i, v in vectors.items()}
    centroids = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for v in x.values():
            groups[near(v)].append(v)
        centroids = [[sum(p) // len(g) for p in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = {i: (near(v), far(v, centroids[near(v)])) for i, v in x.items()}
    inertia = [sum(d for c, d in found.values() if c == k) for k in range(len(centroids))]
    return {i: (c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, (c, d) in found.items()}


@pytest.fixture
def query(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, ROWS).withColumns({"cluster": F.lit("x"), "x": F.lit(1), "distance": F.lit("y")}).write.parquet(f"{tmp_path}/embeddings.parquet")
        return km.op12_kdtree_clusters(spark, str(tmp_path))

    return run


def clouds(n, spread=0.05, centres=12):
    chance = np.random.default_rng(5)
    middle = chance.normal(0, 0.5, (centres, 64))
    return {i: (middle[i % centres] + chance.normal(0, spread, 64)).astype(np.float32).tolist() for i in range(n)}


@pytest.mark.parametrize("spread", [0.02, 0.4])
def test_as_plain_rounds(query, spread):
    vectors = clouds(900, spread)
    got = query([(i, v, 0) for i, v in vectors.items()])
    assert {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got.collect()} == lloyd(vectors)


def test_odd_vectors_take_no_part_and_copies_tie(query):
    vectors = {i: [float(i % 3)] * 64 for i in range(40)}
    odd = [(100, None, 0), (101, [], 0), (102, [0.5] * 63, 0), (103, [None] + [0.5] * 63, 0), (104, [float("nan")] + [0.5] * 63, 0), (105, [float("inf")] * 64, 0), (106, [3e38] * 64, 0)]
    got = {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in query([(i, v, 0) for i, v in vectors.items()] + odd).collect()}
    assert got == lloyd(vectors)


def test_few_vectors_no_ids_and_none(spark):
    rows = [(1, [0.25] * 64, 0), (1, [0.25] * 64, 0), (2, [-0.5] * 64, 0), (None, [-0.4] * 64, 0)]
    found, centroids = km.clustered(spark.createDataFrame(rows, ROWS))
    assert len(centroids) == 3 and found.count() == 4
    assert {r["cluster"] for r in found.where("vec_id = 1").collect()} == {r["cluster"] for r in found.where("vec_id = 1").limit(1).collect()}
    found, centroids = km.clustered(spark.createDataFrame([], ROWS))
    assert found.collect() == [] and len(centroids) == 0
    found, _ = km.clustered(spark.createDataFrame([(None, [0.5] * 64, 0)], ROWS))
    assert found.columns == ["vec_id", "cluster", "distance"]


def test_nodes_are_pruned_and_assigned_whole():
    x = (np.array(list(clouds(4096, 0.01, 8).values())) * 1024).astype(np.int64)
    centroids = x[[0, 1, 2, 3, 4, 5, 6, 7]]
    order, spans, sums, boxes = km.tree(x)
    found = list(km.assigned(x[order], spans, boxes, centroids))
    whole = [n for n, rows, of in found if isinstance(of, int)]
    assert sum(rows.stop - rows.start for _, rows, _ in found) == len(x)
    assert sum(spans[n][1] - spans[n][0] for n in whole) > 0.9 * len(x)
    assert all((sums[n] == x[order][spans[n][0] : spans[n][1]].sum(0)).all() for n in whole)


def test_ties_at_the_border_of_a_box_stay():
    box = np.array([[0, 0], [4, 4]])
    centroids = np.array([[-2, 2], [6, 2], [2, 2], [2, 30]])
    left = km.filtered(box, centroids, np.arange(4))
    assert left.tolist() == [0, 1, 2]  # the first two are as near as the third on a side, the last is farther everywhere


def test_small_blocks_and_leaves_as_sql(spark):
    vectors = clouds(300, 0.3)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], ROWS)
    found, centroids = km.clustered(df, block=37, leaf=5)
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    want = {r[0]: (r[1], r[2], r[5]) for r in con.sql(km.ORACLE_SQL["op12_kdtree_clusters"]).fetchall()}
    assert {r["vec_id"]: (r["cluster"], r["distance"], km.digest(centroids[r["cluster"]])) for r in found.collect()} == want
