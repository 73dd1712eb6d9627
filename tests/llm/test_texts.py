"""Near-duplicates, substring dedup, neighbours, secrets, licenses, toxicity: against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from payloom.llm import graph, ivfpq, license_scan, secret_scan, simhash, substring, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = {"fp": "x", "component_id": 1, "score": 2, "labels": "l", "group": 1}


def small_texts(seed, n=150):
    """Words from a small vocabulary: copies, near copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ÀB", "Ab"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \t\n", "one", "one two three", "one two three"]
    while len(texts) < n:
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 30) : rng.randint(31, 60)]
        if rng.random() < 0.3 and len(texts) > 8:
            w = (texts[rng.randrange(6, len(texts))] or "").split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
        texts.append(rng.choice((" ", "\n", "\x0b")).join(w))
    return texts + ["rep " * 500, " ".join(passage) * 40]


# Near-duplicates.


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps, radius=4):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in fps}


def test_near_duplicates_against_brute_force(docs):
    texts = small_texts(1)
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    want = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(*texts, extra=CLASH)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps} and len(set(want.values())) < len(want)


@pytest.mark.parametrize("rows", [7, 1 << 17])
def test_bit_sliced_distances(monkeypatch, rows):
    monkeypatch.setattr(simhash, "ROWS", rows)
    rng = np.random.default_rng(2)
    fps = []
    for b in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(rng.integers(1, 30)):
            x = int(b)
            for p in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(p)
            fps.append(x)
    fps = np.array(fps, np.uint64)
    for start in (np.zeros(len(fps), int), np.arange(len(fps)) // 70 * 70, np.arange(len(fps))):
        for radius in (0, 4, 6):
            got = {p for i, j in simhash.near(fps, start, radius) for p in zip(i.tolist(), j.tolist(), strict=True)}
            assert got == {(i, j) for i in range(len(fps)) for j in range(start[i], i) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_split_buckets_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for _ in range(300)})
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = components(dict(enumerate(fps)))
    for split in (16, 4096):
        named = {r.node: r.component for r in graph.components(simhash.links(nodes, split=split)).collect()}
        assert {i: named.get(i, i) for i in want} == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 120)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 1000, 2000} and got[120] == 0 and got[1299] == 1000 and len(got) == 121 + 300 + 2
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_edges(docs):
    assert simhash.near_duplicates(docs()).count() == 0
    rows = docs((3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "alone here"), (1, ""), (2, None), extra=CLASH)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (None, None)]
    kept = simhash.one_of_each(rows)
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "3", "None", "None"] and kept.columns == rows.columns
    assert simhash.one_of_each(docs()).count() == 0


# Substrings.


def deduplicated(texts, size):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words):
        for s in range(len(words[i]) - size + 1):
            w = tuple(words[i][s : s + size])
            if w in seen:
                gone[i] |= set(range(s, s + size))
            seen.add(w)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in words.items()}


@pytest.mark.parametrize(("chunk", "size"), [(1 << 21, 20), (50, 20), (300, 5), (1, 1)])
def test_substrings_against_brute_force(docs, monkeypatch, chunk, size):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "BUCKET", max(chunk, 200))
    texts = list(enumerate(small_texts(chunk, 80)))
    random.Random(1).shuffle(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(docs(*texts, extra=CLASH), size).collect()}
    assert got == deduplicated(texts, size)


def test_substring_parts():
    rng = np.random.default_rng(4)
    words = [bytes([97 + x]) for x in rng.integers(0, 2, 3000)]
    h = substring.window_hashes(words, 8)
    assert len(set(h.tolist())) == len({tuple(words[i : i + 8]) for i in range(len(h))})
    a, b = rng.integers(-(2**62), 2**62, 1000), rng.integers(0, 9, 1000).astype(np.int32)
    assert all((x == y).all() for x, y in zip(substring.unpack(substring.pack(a, b), np.int64, np.int32), (a, b), strict=True))
    doc, start, end = substring.intervals(np.array([2, 1, 1, 1]), np.array([0, 30, 5, 0]), 20)
    assert list(zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)) == [(1, 0, 25), (1, 30, 50), (2, 0, 20)]


def test_groups_of_documents_are_even():
    ids = np.arange(-5000, 5000)
    assert set(substring._group(ids, 1)) == {0}
    n = np.bincount(substring._group(ids, 64), minlength=64)
    assert len(n) == 64 and n.min() > 100 and n.max() < 220


def test_substring_edges(docs):
    assert substring.deduplicate(docs()).count() == 0
    same = " ".join(f"w{i}" for i in range(30))
    rows = substring.deduplicate(docs((4, same), (4, same), (None, same), (None, None), (9, same))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in rows) == [("4", 30, 0), ("4", 30, 0), ("9", 30, 30), ("None", 0, 0), ("None", 30, 0)]


# Neighbours.

VECTORS = "vec_id long, embedding array<float>, score int, list string"


def test_neighbours_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "VECTORS", 40)
    monkeypatch.setattr(ivfpq, "ASKED", 5)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:140] = x[99]  # ties
    frame = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)], VECTORS)
    got = {}
    for r in ivfpq.neighbours(frame, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wide, found = x.astype(float), 0
    for q in range(0, 1500, 20):
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s - wide[v] @ wide[q]) < 1e-9 for _, v, s in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1])) and q not in {v for _, v, _ in mine}
        scores = wide @ wide[q]
        scores[q] = -np.inf
        found += len({v for _, v, _ in mine} & set(np.lexsort((np.arange(1500), -scores))[:20].tolist()))
    assert found / (75 * 20) >= 0.9


def test_neighbours_edges(spark):
    assert ivfpq.neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0, 20).count() == 0
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (0, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in odd], VECTORS)
    got = [tuple(r) for r in ivfpq.neighbours(frame, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 4.0), (0, 2, 7, 3.0), (0, 3, 7, 3.0)]
    assert ivfpq.neighbours(spark.createDataFrame([(20, [1.0], 1, "x")], VECTORS), F.col("vec_id") % 20 == 0, 20).count() == 0


# Secrets.


def secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_against_brute_force(docs):
    rng = random.Random(6)
    bits = ["password", "TOKEN", "apiKey", "api_key", "ſecret", "toKen", "secret", '"', "'", " ", "   ", ":", "=", "abc12", "abcdef", "AKIA", "AKIA" + "Z9" * 8, "AKIAAKIA", "f" * 23, "f" * 24, "0a" * 20, "é", "\n", "x/y+z="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(500)] + [None, "", "f" * 100000, "token " * 20000, "secret" + " " * 100000]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs(*texts, extra={"spans": F.lit(1)})).collect()}
    for i, t in enumerate(texts):
        want = secrets(t or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for *_, k in want) for kind in ("assign", "access", "hex")), t
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(got[i].spans.split(",")), t
    assert secret_scan.scan_secrets(docs()).count() == 0


def test_novelty_tells_random_strings_from_names():
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(20):
        key = "".join(rng.choice(letters) for _ in range(32))
        text = f"authorization header: bearer  {key} in this request"
        assert ("novel", text.index(key), text.index(key) + 32) in secret_scan.novel_spans(text)
    for plain in ("auth: configuration_manager_default_value", "signature: abcdefghijklmnopqrstuvwxyz0123456789", "credential = the_database_connection_string_1", "nothing here but words and words"):
        assert not secret_scan.novel_spans(plain), plain
    assert secret_scan.novelty("x" * 100000, "token: ") < 0.1


# Licenses.


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    places = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_against_brute_force(docs):
    rng = random.Random(8)
    bits = ["CC", "by", "-BY", "general", "Public", "LICENSE", "all", "rights", "reserved", ".", " ", "\n", "é", "GNU", "v3", "MIT License", "x", "1", "İ", "\x7f"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(400)] + [None, "", "all rights reserved " * 5000]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(*texts, extra=CLASH)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan.scan_licenses(docs()).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("GNU Lesser General Public License v2.1 or later", "gpl,lgpl-2.1"),  # the phrase in it is always told
        ("This work is CC BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa-4.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Mozilla Public License 2.0", "mpl-2.0"),
        ("he came mit Hut, and the license plate", ""),
    ],
)
def test_license_rules(text, labels):
    assert license_scan.scan(text)[5] == labels


def test_license_rules_are_many_and_contained_ones_go():
    assert len(license_scan.rules()) > 300
    kept = license_scan.detect(" licensed under the apache license version 2 0 ")
    assert [k[2] for k in kept] == ["apache-2.0"]


# Toxicity.


def labelled_texts(n, seed=9):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["zwurble", "xyzzyk", "quonk"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, docs):
    rows = labelled_texts(700)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    found = docs(*[(i, t) for i, t, _ in rows], (9000, None), (9001, ""), (None, "quonk"), (5, "twice"), extra={"score": F.lit(3), "held_out": F.lit(1)})
    model = toxicity.train(found, labels)
    got = toxicity.score(found, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    import zlib

    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    kept = toxicity.without_toxic(found, model)
    assert kept.columns == found.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_toxicity_without_labels(spark, docs):
    model = toxicity.train(docs("a", "b"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.predicted for r in toxicity.score(docs("a", None), model).collect()] in ([0, 0], [1, 1])
    assert toxicity.score(docs(), model).count() == 0


def test_toxicity_chunks_and_packing(monkeypatch):
    seen = np.zeros(1 << toxicity.BITS, bool)
    text = "".join(random.Random(1).choice("abcde fé") for _ in range(5000))
    whole = toxicity.ngrams(text, seen)
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert (toxicity.ngrams(text, seen) == whole).all() and not seen.any()
    assert (toxicity.unpacked(toxicity.packed(whole.astype(np.int32))) == whole).all() and len(toxicity.unpacked(toxicity.packed(whole[:0].astype(np.int32)))) == 0


def test_toxicity_against_brute_force(monkeypatch):
    """Ratios, the loss, its gradient and the minimum, from sets of n-grams written out."""
    monkeypatch.setattr(toxicity, "BITS", 6)
    rng = np.random.default_rng(12)
    y = np.array([1.0] * 7 + [0.0] * 9)
    found = [np.unique(rng.integers(0, 64, rng.integers(1, 12))).astype(np.int32) for _ in y]
    counts = {1: 30, 0: 170}
    held = {}
    monkeypatch.setattr(toxicity, "minimised", lambda loss, w: held.setdefault("loss", loss) and w)
    toxicity.fit(iter(found), y, counts)
    loss = held["loss"]
    p = {k: 1.0 + sum(k in f for f, t in zip(found, y, strict=True) if t == 1) for k in range(64)}
    q = {k: 1.0 + sum(k in f for f, t in zip(found, y, strict=True) if t == 0) for k in range(64)}
    ratio = {k: math.log((p[k] / sum(p.values())) / (q[k] / sum(q.values()))) for k in range(64)}
    share = 31 / 202

    def plain(w):
        total = toxicity.RIDGE / 2 * sum(x * x for x in w[:-1])
        for f, t in zip(found, y, strict=True):
            s = w[-1] + sum(w[k] * ratio[k] for k in f.tolist()) / math.sqrt(len(f))
            weight = (share / (7 / 16) if t else (1 - share) / (9 / 16)) / 16
            total += weight * math.log1p(math.exp(-s if t else s))
        return total

    w = rng.normal(size=65)
    value, gradient = loss(w)
    assert abs(value - plain(w)) < 1e-9
    for k in range(65):
        step = np.zeros(65)
        step[k] = 1e-5
        assert abs((plain(w + step) - plain(w - step)) / 2e-5 - gradient[k]) < 1e-6
    monkeypatch.undo()
    best = toxicity.minimised(loss, np.zeros(65), 200)
    assert np.abs(loss(best)[1]).max() < 1e-3 and plain(best) <= plain(w)


def test_toxicity_sample_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST", 400)
    rows = labelled_texts(300)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "cut", lambda df: seen.append(df.collect()) or df)
    toxicity.train(docs(*[(i, t if i % 10 else t * 100) for i, t, _ in rows]), labels, sample=100, characters=4000)
    chosen, sampled = seen
    assert 10 < len(chosen) == len(sampled) < 60 and 0 < sum(r.toxic for r in sampled) < len(sampled)
    assert sum(len(toxicity.unpacked(r.found)) for r in sampled) <= 3 * 4200 and all(r.doc_id % 10 for r in chosen)
