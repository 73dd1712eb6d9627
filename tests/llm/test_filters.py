"""URL filters, personal data, decontamination and mixing: the operators that are all SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from payloom.llm import decontam, mixing, pii, url_filter

PAGES = "page_id bigint, url string, host string"


def pages(spark, *urls):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], PAGES)


def listed(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_url_rules_and_blocklist(spark):
    urls = ["http://x.NET/a", "https://net/", "https://example.net/en/1", "https://a.example.net/en", "http://example.com/de/x?y", "http://example.com", "https://w.org/fr/", "https://www.spam-farm.example.org/en/", "http://notspam-farm.example.org/", "no url", None, "", "x://spam-farm.example.org:80/", "http://a.net?u=http://b/", "http://bad.example.com/\n/x"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, *urls), listed(spark, "spam-farm.example.org")).collect()}
    assert got == {
        0: ("x.net", "/a", "net/", "block"), 1: ("net", "/", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("a.example.net", "/en", "net/", "block"),
        4: ("example.com", "/de/x", "example.com/de/", "block"), 5: ("example.com", "", None, "allow"), 6: ("w.org", "/fr/", "org/fr/", "allow"), 7: ("www.spam-farm.example.org", "/en/", None, "block"),
        8: ("notspam-farm.example.org", "/", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("spam-farm.example.org:80", "/", None, "allow"), 13: ("a.net", "", None, "allow"), 14: ("bad.example.com", "/\n/x", None, "allow"),
    }


def test_url_empty_table_and_repeated_rows(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES), url_filter.blocklist(spark.createDataFrame([], PAGES))).count() == 0
    twice = pages(spark, "http://a.org/").union(pages(spark, "http://a.org/"))
    assert url_filter.judge(twice, url_filter.blocklist(twice)).count() == 2
    assert url_filter.judge(twice, spark.createDataFrame([], "key string")).count() == 2


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys if int(k[1:]) % 7 == 0] + [("elsewhere",), (None,)], "key string")
    universe = spark.createDataFrame([(k,) for k in keys] * 2, "key string")
    levels = url_filter.cascade(listed, universe)
    assert len(levels) > 1 and [x.number for x in levels] == list(range(len(levels)))
    got = {r.key: r.hit for r in universe.select("key", url_filter.contains(levels, F.col("key")).alias("hit")).collect()}
    assert got == {k: int(k[1:]) % 7 == 0 for k in keys}


def test_picked_blocklist_has_levels(spark):
    found = pages(spark, *(f"https://h{i}.part{i % 300}.example.{d}/de/" for i in range(1500) for d in ("com", "org")))
    keys = url_filter.blocklist(found)
    universe = found.select(F.explode(url_filter.suffixes(url_filter.url_host(F.col("url")))).alias("key")).distinct()
    want = {r.key for r in keys.collect()}
    assert len(url_filter.cascade(keys, universe)) >= 4 and 300 < len(want) < 700
    got = {r.host: r.listed for r in url_filter.judge(found, keys).collect()}
    assert all(hit == any(h == k or h.endswith("." + k) for k in want) for h, hit in got.items())


def test_url_beyond_the_bound_gives_the_same(spark):
    urls = [f"https://h{i % 9}.example.org/en/{i}" for i in range(60)] + [None, "https://www.spam-farm.example.org/"]
    bad = spark.createDataFrame([("h3.example.org",), ("SPAM-farm.example.org",)], "key string")
    one, other = (sorted(map(tuple, url_filter.judge(pages(spark, *urls), bad, max_bits=b).collect()), key=str) for b in (url_filter.MAX_BITS, 4))
    assert one == other and sum(r[4] == "block" for r in one) == 8


# Personal data.


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, kind, pattern, ok in ((2, "card", r"[0-9]([\x20-]?[0-9])+", lambda d: 14 <= len(d) <= 19 and luhn(d)), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 10 <= len(d) <= 15)):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if ok(re.sub("[^0-9]", "", m[0]))]
    return sorted(found)


def spell(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)


def test_pii_base_against_brute_force(spark, docs):
    rng = random.Random(3)
    bits = ["a@b.c", "x.y@z", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (234) 567-8901", "+12", "+1((((2", "é😀", " ", "\n", "word", "12345678901234567890", ".", "-", "A"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "a@b.c " * 3000, "1" * 50000, "a" * 50000, "+1" * 4000, "a." * 20000 + "@b" + ".c" * 20000]
    got = {r.doc_id: r for r in pii.find(docs(*texts, extra={"spans": F.lit(1), "kind": F.lit("k")})).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t or "")
        n = Counter(k for *_, k in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone")), t
        assert got[i].base_sha256 == hashlib.sha256(spell(want).encode()).hexdigest()
        assert set(filter(None, spell(want).split(","))) <= set(got[i].spans.split(","))


def test_pii_revealing_terms(docs):
    about = "the zanzibar office of bob@corp.example is here"
    texts = [about] * 5 + [f"the plain office number {w} is here" for w in "abcdefghijklmnopqrstuvwxyz"] + ["office " * 3, None, ""]
    got = {r.doc_id: r.spans for r in pii.find(docs(*texts)).collect()}
    assert got[0] == "removed:4:12,email:23:39" and got[7] == "" and got[len(texts) - 1] == ""
    out = {r.doc_id: r for r in pii.sanitise(docs(*texts)).collect()}
    assert out[0].text == "the  office of [EMAIL] is here" and out[0].n_chars == len(out[0].text)
    assert [out[i].text for i in range(5, len(texts))] == texts[5:]


def test_pii_terms_need_support(docs):
    texts = ["the zanzibar office of bob@corp.example is here"] * 2 + ["plain words only"] * 20
    assert {r.spans for r in pii.find(docs(*texts)).collect()} == {"email:23:39", ""}


def test_pii_overlaps_and_columns(spark, docs):
    text = "x +4111 1111 1111 1111 y 8.8.8.8"
    found = docs(text, None, extra={"spans": F.lit("mine"), "start": F.lit(5)})
    rows = {r.doc_id: r for r in pii.sanitise(found).collect()}
    assert rows[0].text.count("[") == len(set(re.findall(r"\[[A-Z]+\]", rows[0].text))) and "1111" not in rows[0].text and "8.8" not in rows[0].text
    assert rows[0].spans == "mine" and rows[1].text is None and pii.sanitise(found).columns == found.columns
    assert pii.find(docs()).count() == 0 and pii.sanitise(docs()).count() == 0
    nameless = docs((None, "a@b.c"), (None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"))
    assert sorted(r.spans for r in pii.find(nameless).collect()) == ["email:0:5"] * 4 and pii.sanitise(nameless).count() == 4


# Decontamination.


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_decontamination_against_brute_force(spark, docs):
    rng = random.Random(4)
    items = [words(rng, n) for n in (40, 12, 15, 5, 0, 60)]
    texts = []
    for i in range(120):
        w = words(rng, rng.randint(0, 60))
        if i % 3:
            item = rng.choice(items)[:]
            for _ in range(rng.randint(0, 8) if item else 0):
                item[rng.randrange(len(item))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = item[rng.choice((0, 0, 3)) :]
        texts.append((" " if i % 2 else ", ").join(x.upper() if i % 5 == 0 else x for x in w))
    texts += [None, "", "w1 " * 30000]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, "x"), (9, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_hits, round(r.agreement, 9)) for r in decontam.contaminated(docs(*texts, extra={"h": F.lit(1), "item_id": F.lit(2)}), bench).collect()}
    index = defaultdict(list)
    for b, item in enumerate(items):
        for o in range(len(item) - decontam.SPAN + 1):
            for m, mask in enumerate(decontam.MASKS):
                index[m, tuple(item[o + p] for p, on in enumerate(mask) if on == "1")].append((b, o))
    want = defaultdict(list)
    for d, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for i in range(len(w) - decontam.SPAN + 1):
            for m, mask in enumerate(decontam.MASKS):
                for b, o in index.get((m, tuple(w[i + p] for p, on in enumerate(mask) if on == "1")), ()):
                    lo, hi = max(0, o - decontam.MARGIN), min(len(items[b]), o + decontam.SPAN + decontam.MARGIN)
                    same = sum(0 <= i - o + j < len(w) and w[i - o + j] == items[b][j] for j in range(lo, hi)) / (hi - lo)
                    if same >= decontam.AGREE:
                        want[d, b].append(same)
    assert got == {k: (len(v), round(max(v), 9)) for k, v in want.items()} and len(got) > 20


def test_decontamination_keeps_clean_rows_whole(spark, docs):
    rng = random.Random(5)
    item, clean = " ".join(words(rng, 30)), " ".join(words(rng, 50))
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id bigint, text string")
    found = docs(f"x {item} y", clean, None, "", (None, item), (7, clean), (7, clean), extra={"item_id": F.lit("mine")})
    kept = decontam.decontaminate(found, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "7", "7", "None"] and kept.columns == found.columns
    assert decontam.decontaminate(found, bench.where("false")).count() == 7 and decontam.decontaminate(docs(), bench).count() == 0


# Mixing.


def share_out(budget, children):
    """children: name -> (weight, capacity); what each gets when shares that do not fit are passed on, by brute force."""
    got, open_, left = dict.fromkeys(children, 0.0), {c for c, (w, _) in children.items() if w > 0}, budget
    while open_ and left > 1e-9:
        level = left / sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] <= got[c] + level * children[c][0] + 1e-12}
        if not full:
            for c in open_:
                got[c] += level * children[c][0]
            return got
        for c in full:
            left -= children[c][1] - got[c]
            got[c] = children[c][1]
        # what is left is dealt anew among those that are open, from nothing
        open_ -= full
    return got


def test_budgets_against_brute_force(spark):
    rng = random.Random(6)
    leaves = [(d, g, f"s{i}", rng.randint(1, 9), rng.choice((0, 5, 50, 500, 5000))) for d in ("web", "code", "books") for g in ("en", "de") for i in range(4)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, n_docs bigint, n_tokens bigint")
    weights = {"domain_weights": {"web": 0.6, "code": 0.1}, "lang_weights": {"en": 0.8, "de": 0.2}, "source_weights": {"s1": 3.0, "s2": 0.0}}
    for part in (0.1, 0.7, 3.0):
        got = {(r.domain, r.lang, r.source): r.share for r in mixing.budgets(frame, F.col("all_tokens") * part, 2, **weights).collect()}
        cap = {(d, g, s): 2 * n for d, g, s, _, n in leaves}
        total = lambda *k: sum(c for key, c in cap.items() if key[: len(k)] == k)
        want = {}
        domains = share_out(part * sum(cap.values()) / 2, {d: (weights["domain_weights"].get(d, 1.0), total(d)) for d in ("web", "code", "books")})
        for d, b in domains.items():
            for g, c in share_out(b, {g: (weights["lang_weights"][g], total(d, g)) for g in ("en", "de")}).items():
                for s, x in share_out(c, {s: (weights["source_weights"].get(s, 1.0), cap[d, g, s]) for s in ("s0", "s1", "s2", "s3")}).items():
                    want[d, g, s] = x
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), part


def test_mixture_takes_prefixes_of_epochs(docs):
    rng = random.Random(7)
    texts = [(i, " ".join("w" for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(401, None), (None, "a b"), (5, "x y z")]
    found = docs(*texts)
    uses = mixing.mix(found, budget_share=1.2, epochs=3).collect()
    shares = {(r.domain, r.lang, r.source): int(r.share) for r in mixing.budgets(found.select(mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.token_count(F.col("text")).alias("n")).groupBy("domain", "lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens")), F.col("all_tokens") * 1.2, 3, mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS).collect()}
    want = []
    for (domain, lang, source), share in shares.items():
        mine = [(i, len((t or "").split())) for i, t in texts if f"src{(i or 0) % 3}" == source]
        upto = 0
        for epoch in range(3):
            for i, n in sorted(mine, key=lambda x: (hashlib.md5(f"{mixing.SEED}:{epoch}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0, x[1])):
                upto += n
                if upto <= share:
                    want.append((i, domain, lang, source, epoch, n))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in uses)


def test_mixture_buckets_do_not_change_it(docs, monkeypatch):
    texts = [(i, "w " * (i % 17)) for i in range(300)]
    whole = sorted(map(tuple, mixing.mix(docs(*texts)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert sorted(map(tuple, mixing.mix(docs(*texts)).collect())) == whole


def test_mixture_carries_rows(docs):
    """Rows without a doc_id, or that share one, are taken by themselves; those of mixture() are those of mix()."""
    rng = random.Random(17)
    texts = [(None, " ".join("w" for _ in range(rng.randint(0, 9)))) for _ in range(40)] + [(7, f"{'v ' * rng.randint(0, 9)}{i}") for i in range(40)] + [(i, "a b c") for i in range(10, 60)] * 2
    found = docs(*texts, extra={"order": F.lit(1), "bucket": F.lit("b"), "whole": F.lit(2)})
    for share in (0.3, 0.8, 3.0):
        rows = mixing.mixture(found, budget_share=share).collect()
        uses = mixing.mix(found, budget_share=share).collect()
        assert Counter((r.doc_id, r.mix_epoch, r.mix_tokens) for r in rows) == Counter((r.doc_id, r.epoch, r.n_tokens) for r in uses)
        have = Counter((i, t) for i, t in texts)
        assert all(n <= have[i, t] for (i, t, _), n in Counter((r.doc_id, r.text, r.mix_epoch) for r in rows).items())
        assert all(r.mix_tokens == len(r.text.split()) and r.order == 1 and r.bucket == "b" for r in rows)
    assert len(rows) == 2 * len(texts)


def test_mixture_edges(docs):
    assert mixing.mix(docs()).count() == 0 and mixing.mixture(docs()).count() == 0
    found = docs(*[(i, "a b c") for i in range(20)], extra={"mix_epoch": F.lit("x"), "epoch": F.lit(1)}).withColumn("lang", F.lit(None).cast("string"))
    rows = mixing.mixture(found).collect()
    assert 0 < len(rows) <= 20 and {r.mix_domain for r in rows} <= set(mixing.DOMAINS) and rows[0].epoch == 1
