from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from payloom.llm import mixing, simhash
from payloom.llm.queries import MODULES, oracle_sql, queries

WORDS = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("ar", "el", "in", "os", "um", "eth", "ing")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def made(spark, folder):
    """Documents with planted cases: toxic ones, copies, near copies, benchmark passages, personal data; the rest is clean."""
    rng = random.Random(11)
    item = text(rng, 30)
    rows, toxic = [], []
    for i in range(400):
        t = text(rng, rng.randint(40, 120))
        if i % 8 == 0:
            t, bad = f"{t} zwurble quonk xyzzyk {text(rng, 5)}", 1
        else:
            bad = 0
        rows.append((i, t))
        toxic.append((i, 1, bad))
    rows += [(401, rows[1][1]), (402, rows[1][1].upper()), (403, f"{text(rng, 20)} {item} {text(rng, 20)}"), (404, f"{text(rng, 60)} mail bob@corp.example now {text(rng, 60)}"), (405, None), (406, "")]
    frame = spark.createDataFrame([(i, t, "en" if i % 3 else "de", f"src{i % 5}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t in rows}


def test_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    texts = made(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert name == "mixture" or docs.columns == columns
    planted = {i for i in range(0, 400, 8)}
    assert len(planted - set(kept["toxicity"])) >= 0.9 * len(planted) and len(kept["toxicity"]) >= len(texts) - len(planted) - 4
    dup = kept["near_duplicates"]
    assert 1 in dup and 401 not in dup and 402 not in dup and 405 in dup and 406 not in dup
    assert set(kept["decontamination"]) == set(dup) - {403}
    clean = kept["sanitisation"]
    assert "[EMAIL]" in clean[404] and all(clean[i] == texts[i] for i in clean if i != 404)
    assert 0 < len(kept["mixture"]) < len(clean) + 1 and set(mixing.DOMAINS) >= {r.mix_domain for r in docs.collect()}
    run = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert run == sorted(map(str, docs.collect()))


def test_nothing_goes_where_nothing_was_learnt(spark, tmp_path):
    folder = str(tmp_path)
    made(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, few in (("none", labels.limit(0)), ("one", labels.where("doc_id in (1, 8)"))):
        few.write.parquet(f"{folder}/{name}/labels.parquet")
        assert corpus_pipeline.toxicity(spark, docs, f"{folder}/{name}").count() == docs.count()


def test_stages_with_columns_of_all_names_and_very_long_texts(spark, tmp_path):
    folder = str(tmp_path)
    texts = made(spark, folder)
    rng = random.Random(2)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 8 <> 0 or doc_id > 399")
    long = spark.createDataFrame([(900, text(rng, 60_000), "en", "src1", 0), (901, "x" * 400_000, None, None, None)], docs.schema)
    docs = docs.unionByName(long).withColumns({k: F.lit(k) for k in ("toxic", "n", "node", "component", "hash", "mask", "u", "v", "part", "term", "score", "item_id", "start")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}-wide")
        docs = spark.read.parquet(f"{folder}/{name}-wide")
        assert docs.columns == columns and {900, 901} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.where("doc_id < 400").count() >= 0.97 * sum(1 for i in texts if i < 400 and i % 8)


def test_copies_stay_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words in this text here", "en", "s", 1) for i in range(50)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in simhash.one_of_each(docs).collect()] == [0]


def test_registered():
    names = queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x.partition("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(oracle_sql()) <= set(names) and len(MODULES) == 13 and len(corpus_pipeline.STAGES) == 5
