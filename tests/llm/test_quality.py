from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from payloom.llm import quality as q

WORDS = "the of a window river stone light under green harbour quiet letter morning paper silver garden answer winter".split()


def prose(chance, n):
    return " ".join(chance.choice(WORDS) + ("." if k % 9 == 8 else "") for k in range(n))


def poor(chance, n):
    kind = chance.randrange(3)
    words = [chance.choice(WORDS) for _ in range(n)]
    return " ".join([words[0]] * n) if kind == 0 else " | ".join(words) if kind == 1 else " ".join(w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def corpus(spark):
    chance = random.Random(4)
    rows = [(i, (poor if i % 4 == 0 else prose)(chance, 30 + i % 60)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_pairs_in_linear_time_as_one_by_one():
    chance = np.random.default_rng(2)
    m = q.Machine(0.3, chance.normal(size=40), chance.normal(size=(40, 5)))
    at, x = np.array([3, 8, 21, 30]), np.array([0.5, 1.0, -0.2, 0.7])
    plain = 0.3 + sum(m.weights[i] * v for i, v in zip(at, x, strict=True)) + sum(float(m.factors[at[i]] @ m.factors[at[j]]) * x[i] * x[j] for i, j in combinations(range(4), 2))
    assert m.score(at, x) == pytest.approx(1 / (1 + np.exp(-plain)))


def test_held_out_documents(corpus):
    docs, labels = corpus
    rows = q.score(docs, q.train(docs, labels)).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_pairs_are_learnt():
    """Which words go together decides; no word alone does."""
    chance = random.Random(3)
    rows, y = [], []
    for _ in range(800):
        a, b = chance.choice("pq"), chance.choice("rs")
        at, x = q.features(f"{a} {b}", 3)
        rows.append((int((a == "p") == (b == "r")), at, x))
        y.append(rows[-1][0])
    m = q.fit(rows * 6, {0: 400, 1: 400})
    assert np.mean([(m.score(a, x) >= 0.5) == t for t, a, x in rows]) > 0.95


def test_labels_and_columns_that_do_not_count(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    noise = spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema)
    clashing = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "quality": F.lit(1), "score": F.lit("y"), "n": F.lit(0), "held_out": F.lit(False), "at": F.lit(1)})
    want = {r["doc_id"]: r["score"] for r in q.score(docs, q.train(docs, labels)).collect()}
    got = {r["doc_id"]: r["score"] for r in q.score(clashing, q.train(clashing, flipped.unionByName(noise))).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_odd_texts_and_tables(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\n ", "en", "s", 4), (None, "Good words here.", None, None, 7), (5, "x" * 300_000 + " y" * 100_000, "en", "s", 5)], docs.schema)
    rows = q.score(odd, q.train(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    none = q.train(docs, labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in q.score(odd, none).collect()} == {(0.5, 1)}
    good = q.train(docs, labels.where("quality = 1"))
    assert all(r["predicted"] == 1 and r["score"] > 0.9 for r in q.score(odd, good).collect())
    assert q.score(docs.limit(0), none).collect() == [] and q.score(docs.limit(0), q.train(docs.limit(0), labels)).collect() == []


def test_a_long_text_ends_the_sample_and_is_kept(corpus):
    docs, labels = corpus
    m = q.train(docs, labels, characters=10)
    assert np.abs(m.weights).sum() > 0  # one row of each class at least
