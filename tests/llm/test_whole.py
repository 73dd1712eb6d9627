"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from payloom.llm import common, decontam, graph, ivfpq, license_scan, pii, secret_scan, simhash
from payloom.operators import capabilities
from pyspark.sql import functions as F


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


# pipeline, near_duplicates.


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_go_by_similarity(spark, docs):
    rng, texts, least, pairs = random.Random(21), [], [], 0
    for _ in range(60):
        a = words(rng, rng.randint(60, 200))
        b = a[:]
        for at in rng.sample(range(len(b)), rng.choice((1, 2, 3))):
            b[at] = "changed"
        texts += [" ".join(a), " ".join(b)]
    sets = [shingles(t) for t in texts]
    for i in range(len(sets)):
        alike = [j for j in range(len(sets)) if jaccard(sets[i], sets[j]) >= 0.8]
        least.append(min(alike))
        pairs += len(alike) - 1
    assert 40 < pairs < 120
    found = docs(*texts, None, "")
    kept = corpus_pipeline.near_duplicates(spark, found, "")
    assert kept.columns == found.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(sets)) if least[i] == i} | {120}


def test_a_large_group_of_near_copies_is_split(docs):
    rng = random.Random(22)
    base, texts = words(rng, 100), []
    for i in range(60):
        w = base[:]
        w[rng.randrange(100)] = f"x{i}"
        texts.append(" ".join(w))
    found = docs(*texts)
    groups = found.sparkSession.createDataFrame([(i, 0) for i in range(60)], "node long, component long")
    for meet in (7, 512):
        named = graph.components(simhash.verified(found, groups, meet)).collect()
        assert {r.node for r in named} == set(range(60)) and {r.component for r in named} == {0}


def test_alike_counts_sets():
    rng = random.Random(23)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None]
    sets = [simhash.shingles(None if t is None else t.encode()) for t in texts]
    label, plain = simhash.alike(sets), [set(s.tolist()) for s in sets]
    want = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]):
                simhash.merge(want, np.array([i]), np.array([j]))
    assert label.tolist() == want.tolist() and len(set(label.tolist())) < len(sets)


# op5_ivfpq.


def test_smallest_ids_of_thousands_of_copies(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(3200, 16)).astype(np.float32)
    copies = sorted(rng.choice(3200, 3000, replace=False).tolist())
    x[copies] = 3 * x[copies[0]]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    asked = [copies[5], copies[2000]]
    got = {q: [] for q in asked}
    for r in ivfpq.neighbours(frame, F.col("vec_id").isin(asked), 20).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for i in copies if i != q][:20] for q in asked}


def test_vectors_with_the_same_codes_are_all_scored():
    rng = np.random.default_rng(32)
    index = ivfpq.Index(rng.normal(size=(300, 16)).astype(np.float32), 1)
    near = rng.normal(size=16)
    x = (near + rng.normal(size=(500, 16)) * 1e-5).astype(np.float32)
    x[100:400] = x[99]
    ids, q = rng.permutation(500), near[None, :].astype(np.float32)
    codes = np.repeat(index.encode(x[:1])[1], 500, 0)
    _, found, score = next(index.search(np.array([-1]), q, 0, ids, codes, x, 20))
    exact = (x.astype(float) * q.astype(float)).sum(1)
    want = np.lexsort((ids, -exact))[:20]
    assert found.tolist() == ids[want].tolist() and np.allclose(score, exact[want])


def test_the_share_of_lists_follows_the_data():
    rng = np.random.default_rng(33)
    even = rng.normal(size=(3000, 16)).astype(np.float32)
    centres = rng.normal(size=(50, 16)) * 10
    clusters = (centres[rng.integers(0, 50, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    shares = [ivfpq.Index(x, 50).share(x, 20) for x in (even, clusters)]
    assert shares[0] > 0.3 > shares[1] and 0 < shares[1] <= 1


def odd_vectors(kind, rng, n=3000, width=16):
    if kind == "scales":  # half of them close to each other, far from the rest; codes tell these apart only roughly
        x = rng.normal(size=(n, width)) * 10
        x[::2] = 30 * np.eye(width)[0] + rng.normal(size=(n // 2, width)) * 1e-3
    elif kind == "lengths":  # few long ones, which are near to all
        x = rng.normal(size=(n, width)) * np.exp(rng.normal(size=(n, 1)) * 3)
    elif kind == "asked":  # queries unlike other rows
        x = rng.normal(size=(n, width))
        x[::20] = x[::20] * 0.01 - 5
    else:  # one direction for all
        x = rng.normal(size=(n, width)) + 1000
    return x


@pytest.mark.parametrize("kind", ["scales", "lengths", "asked", "shifted"])
def test_nothing_near_is_missed_whatever_the_rows(spark, kind, monkeypatch):
    monkeypatch.setattr(ivfpq, "SAMPLE", 600)
    x = odd_vectors(kind, np.random.default_rng(34))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {q: [] for q in range(0, len(x), 20)}
    for r in ivfpq.neighbours(frame, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q, found in got.items():
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        assert found == np.lexsort((np.arange(len(x)), -scores))[:20].tolist()


# op7_secret_scan.


def test_every_run_after_a_sensitive_word_is_measured():
    rng = random.Random(41)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(10):
        a, b = ("".join(rng.choice(letters) for _ in range(32)) for _ in "ab")
        for text, keys in (
            (f'client_secret_production_value = "{a}"', [a]),
            (f"credential: {a}, {b}", [a, b]),
            (f"signature{' ' * 47}{a}", [a]),
            (f"signature{' ' * 48}{a} {b}", [a]),
            (f"signature{' ' * 49}{a}", []),
        ):
            assert secret_scan.novel_spans(text) == [("novel", text.index(k), text.index(k) + 32) for k in keys], text


# op2_pii.


def test_terms_beyond_another_match_reveal(docs):
    about = "wilhelmina, age 42, card 4111 1111 1111 1111 is here"
    mails = "zanzibar of some@corp.example and then bob@corp.example is here"
    texts = [about] * 5 + [mails] * 5 + [f"plain words of {w} only, age 42, card and then some" for w in "abcdefghijklmnopqrstuvwxyz"]
    got = {r.doc_id: r.spans for r in pii.find(docs(*texts)).collect()}
    assert got[0] == "removed:0:10,card:25:44" and got[9].startswith("removed:0:8,email:12:29")
    assert pii.sanitise(docs(*texts)).where("doc_id = 0").first().text == ", age 42, card [CARD] is here"


def disclosed(texts):
    """By brute force: doc -> term -> what it becomes ("" if removed)."""
    spans = {i: list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "")) for i, t in enumerate(texts)}
    outside = {i: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "\n", t or "") for i, t in enumerate(texts)}
    of = {i: {m[0].lower() for m in found} for i, found in spans.items()}
    words = {i: set(re.findall(r"[a-z]{4,}", (t or "").lower())) for i, t in enumerate(texts)}
    apart = {i: set(re.findall(r"[a-z]{4,}", t.lower())) for i, t in outside.items()}
    with_term = Counter(w for some in words.values() for w in some)
    result = {i: {} for i in words}
    for e in {x for some in of.values() for x in some}:
        mine = [i for i in of if e in of[i]]
        if not 3 <= len(mine) < len(texts):
            continue
        content = math.log(len(texts) / len(mine))
        for t in {w for i in mine for w in apart[i]}:
            both = sum(t in apart[i] for i in mine)
            if both < 3 or 1 + math.log(both / with_term[t]) / content < pii.DISCLOSED:
                continue
            starts = [t[:n] for n in range(3, min(8, len(t) - 1) + 1)]
            common = lambda s: max(n for w, n in with_term.items() if w.startswith(s))
            less = [s for s in starts if 1 + math.log(min(1, len(mine) / common(s))) / content < pii.DISCLOSED]
            new = f"[{less[-1]}*]" if less else ""
            for i in mine:
                if t in apart[i]:
                    result[i][t] = min(result[i].get(t, new), new, key=len)
    return result


def test_terms_of_the_whole_text_against_brute_force(docs):
    rng = random.Random(42)
    vocabulary = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 7))) for _ in range(300)]
    mails = [f"{rng.choice(vocabulary)}{i}@corp{i % 3}.example" for i in range(12)]
    told = {m: rng.sample(vocabulary, 4) for m in mails}
    texts = [None, ""]
    for _ in range(150):
        w = [rng.choice(vocabulary[:120]) for _ in range(rng.randint(5, 60))]
        for m in rng.sample(mails, rng.choice((0, 0, 1, 2))):
            w = [*told[m][: rng.randint(2, 4)], *w, m]
            rng.shuffle(w)
        texts.append(" ".join(w))
    want = disclosed(texts)
    out = {r.doc_id: r.text for r in pii.sanitise(docs(*texts)).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        clean = None if t is None else " ".join("[EMAIL]" if "@" in w else want[i].get(w, w) for w in t.split(" "))
        assert out[i] == clean, (t, out[i], clean)
        kinds |= {bool(x) for x in want[i].values()}
    assert kinds == {True, False}
    for r in pii.find(docs(*texts)).collect():
        text = texts[r.doc_id] or ""
        marked = [x.split(":") for x in r.spans.split(",") if x.startswith(("general", "removed"))]
        assert {text[int(a) : int(b)] for _, a, b in marked} == set(want[r.doc_id])


def test_a_text_of_many_addresses(docs):
    many = " ".join(f"name{i}@corp.example wrote to +1 234 567 {i:04d} of zürich" for i in range(50_000))
    texts = [many] * 3 + [f"plain {w}" for w in "abcdefgh"]
    started = time.time()
    out = {r.doc_id: r for r in pii.sanitise(docs(*texts, extra={"h": F.lit(1), "class": F.lit("x")})).collect()}
    assert out[0].text.count("[EMAIL]") == 50_000 and "@" not in out[0].text and "zürich" not in out[0].text and out[5].text == texts[5]
    found = {r.doc_id: r for r in pii.find(docs(*texts)).collect()}
    assert found[1].n_email == 50_000 and found[1].spans.count("removed") == 3 * 50_000 - 50_000 and time.time() - started < 120


# op3_decontamination.


def test_passages_of_items_are_found(spark, docs):
    rng = random.Random(51)
    item, short = words(rng, 60), words(rng, 5)
    texts, want = [], set()
    for n in range(12, 24):
        for at in (0, 20, 60 - n):
            want.add((len(texts), 0))
            texts.append(" ".join([*words(rng, 10), *item[at : at + n], *words(rng, 10)]))
    for places in ((3, 7), (3, 7, 13)):  # 12 words with two changed, 15 with three
        w = item[20 : 20 + (12 if len(places) == 2 else 15)]
        for p in places:
            w[p] = "other"
        texts.append(" ".join([*words(rng, 10), *w, *words(rng, 10)]))
    changed = {(len(texts) - 2, 0), (len(texts) - 1, 0)}
    want |= {(len(texts), 1), (len(texts) + 1, 1)}
    texts += [" ".join([*words(rng, 9), *short, *words(rng, 9)]), " ".join(short).upper()]
    texts += [" ".join([*words(rng, 9), *short[:4], *words(rng, 9)]), " ".join([*words(rng, 9), *item[20:29], *words(rng, 9)]), " ".join(short[:3]), "", None]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short)), (2, ""), (3, None), (None, "w1")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(*texts), bench, stretches=True).collect()}
    assert want <= set(got) <= want | changed and all(decontam.AGREE <= r.agreement <= 1 for r in got.values())
    shards = decontam.contaminated(docs(*texts), bench, stretches=True, max_bits=600)  # several
    assert {tuple(r) for r in shards.collect()} == {tuple(r) for r in got.values()}
    assert {r.doc_id for r in decontam.decontaminate(docs(*texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in got}


# op8_license_scan.


def spelled(tree):
    """All texts of a parsed expression in which nothing repeats without end."""
    made = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = [chr(c) for kind, x in arg for c in ([x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1))][:2]
        elif op == "SUBPATTERN":
            some = spelled(arg[3])
        elif op == "BRANCH":
            some = [x for branch in arg[1] for x in spelled(branch)]
        elif op == "ANY":
            some = ["x"]
        elif op == "MAX_REPEAT" and arg[0] == 1 and arg[1] > 1:
            some = ["x "]
        elif op == "MAX_REPEAT":
            inner = spelled(arg[2])
            some = [x * n for n in range(arg[0], arg[1] + 1) for x in inner] if arg[1] == 1 else [x * arg[0] for x in inner]
        else:
            raise AssertionError(op)
        made = [a + b for a in made for b in some]
    return made


def test_every_name_passes_its_prefilter():
    parse = re._parser.parse
    named = [(label, names, keywords) for label, names, keywords, _ in license_scan.FAMILIES] + [(label, text, keywords) for label, text, keywords, _ in license_scan.TEXTS]
    for label, names, keywords in named:
        for text in spelled(parse(names)):
            assert any(k in text for k in keywords.split("|")), (label, text)


def test_every_text_is_told_and_not_without_a_word():
    parse = re._parser.parse
    for label, text, _, priority in license_scan.TEXTS:
        whole = spelled(parse(text.replace(".{0,", ".{1,")))[0]
        at = [k for k in license_scan.detect(f" {whole} ") if k[2] == label and k[3] == priority]
        outer = license_scan.detect(f" {whole} ")
        assert at or any(k[3] > priority for k in outer), (label, whole, outer)
        if len(whole.split()) > 3:
            for other in (whole.rpartition(" ")[0], whole.partition(" ")[2], whole[::-1]):
                assert not any(k[3] == priority and k[2] == label and k[1] - k[0] == len(whole) for k in license_scan.detect(f" {other} ")), (label, other)
    assert 150 < len(license_scan.TEXTS) < 200


def test_containment_against_brute_force():
    rng = random.Random(81)
    parts = ["licensed under the apache license version 2 0", "mit license", "the", "under the terms of the gnu general public license v2", "gnu lesser general public license", "all rights reserved", "cc by sa 4 0", "copyright 2020", "released under the mit license", "bsd 3 clause license"]
    for _ in range(100):
        words = " " + " ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) + " "
        hits = sorted(((m.start(), m.end(), r.label, r.priority) for r in license_scan.rules() if any(k in words for k in r.keywords) for m in r.expression.finditer(words)), key=lambda h: (-h[3], h[0] - h[1], h[0], h[2]))
        kept = []
        for h in hits:
            if not any(k[0] <= h[0] and h[1] <= k[1] for k in kept):
                kept.append(h)
        assert license_scan.detect(words) == sorted(kept)


def test_a_long_text_of_notices_is_scanned_within_seconds():
    text = "Licensed under the Apache License, Version 2.0. Released under the MIT License. All rights reserved. " * 50_000
    started = time.time()
    found = license_scan.scan(text)
    assert found[5] == "apache-2.0,mit,reserved" and found[1] == 50_000 and time.time() - started < 60


@pytest.mark.parametrize(
    ("text", "labels"),
    [("CC Attribution-ShareAlike 4.0", "cc-by-sa-4.0"), ("CC-NC-SA 3.0", "cc-by-nc-sa-3.0"), ("under CC-ND", "cc-by-nd"), ("CC NonCommercial", "cc-by-nc"), ("CC No Derivatives 2.0", "cc-by-nd-2.0"), ("CC Attribution", "cc-by")],
)
def test_creative_commons_without_by(text, labels):
    assert license_scan.scan(text)[5] == labels


# op4_simhash.


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k long, i long")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("m"))
    least = common.hot_from(keyed)
    assert least == 1000 and common.hot_from(keyed.where("k <> 0")) is None
    want = sorted(map(tuple, rows.join(keyed, "k").collect()))
    for small in (0, 1 << 20):
        monkeypatch.setattr(common, "SMALL_BYTES", small)
        assert sorted(map(tuple, common.joined_hot(rows, keyed, ["k"], least).collect())) == want


@pytest.mark.parametrize("radius", [0, 4, 6, 9])
def test_links_lose_nothing_at_any_radius(spark, radius):
    rng, fps = random.Random(61), set()
    for _ in range(40):
        base = rng.getrandbits(63)
        fps |= {base, base ^ sum(1 << b for b in rng.sample(range(63), radius)), base ^ sum(1 << b for b in rng.sample(range(63), radius + 1))}
    fps = sorted(fps)
    named = {r.node: r.component for r in graph.components(simhash.links(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long"), radius)).collect()}
    want = np.arange(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                simhash.merge(want, np.array([i]), np.array([j]))
    assert [named.get(i, i) for i in range(len(fps))] == want.tolist()


# graph_reaches_root.


def test_long_ways_to_the_root(spark, monkeypatch):
    monkeypatch.setattr(capabilities, "MAX_DEPTH", 3, raising=False)
    rows = [(1, "c0", None)] + [(1, f"c{i}", [f"c{i - 1}"]) for i in range(1, 9)] + [(1, "x", ["y"]), (1, "y", ["x"]), (2, "c1", ["c0"])]
    caps = spark.createDataFrame(rows, "key int, name string, extends array<string>")
    assert {tuple(r) for r in capabilities.orphans(caps, "key").collect()} == {(1, "x"), (1, "y"), (2, "c1")}
