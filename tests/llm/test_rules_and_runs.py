"""License identifiers, joined versions and denials; keys within long runs; the picked blocklist."""

from __future__ import annotations

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from payloom.llm import license_scan, secret_scan, substring, url_filter


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: ISC", "isc"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
        ("/* SPDX-License-Identifier: BSD-3-Clause AND Zlib */", "bsd-3-clause,zlib"),
        ("GPLv3+", "gpl-3.0"),
        ("Licensed under the GPLv2.", "gpl-2.0"),
        ("LGPLv2.1 or later", "lgpl-2.1"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache-2.0"),
        ("Licensed under MIT", "mit"),
        ("This is not licensed under the GPL.", ""),
        ("It was never released under the Apache License, Version 2.0, but sold.", ""),
        ("not distributed under the terms of the MIT license; licensed under the ISC license", "isc"),
        ("MIT is a university, ISC a company", ""),
        ("the identifier mit or isc of a licence", ""),
    ],
)
def test_headers_and_identifiers(text, labels):
    found = license_scan.scan(text)
    assert found[5] == labels and (found[6] > 0) == bool(labels)


def test_base_labels_stay_where_a_license_is_denied():
    found = license_scan.scan("not licensed under the GNU General Public License")
    assert found[1] == 1 and found[4] == found[5] == "gpl"


def test_a_key_within_a_long_run():
    rng = random.Random(3)
    words = [w for w in secret_scan.DICTIONARY.decode().split() if w.isalpha()]
    path = "/".join(rng.choice(words) for _ in range(90))
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    for before in (0, 120, 300, 540):
        text = f'auth: "{path[:before]}{key}{path[before:600]}" end'
        at = text.index(key)
        spans = secret_scan.novel_spans(text)
        assert any(s <= at + 12 and e >= at + 36 for _, s, e in spans) and sum(e - s for _, s, e in spans) < 140, before
    assert secret_scan.novel_spans(f'auth: "{path[:580]}"') == []
    assert secret_scan.novel_spans(f'auth: "{key}"') == [("novel", 7, 47)]


def test_the_picked_list_is_of_the_corpus(spark):
    urls = [f"http://h{i}.site{i % 40}.example.org/x" for i in range(200)] + [None, "none", "http://localhost/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    keys = {"org", "example.org"} | {f"site{i}.example.org" for i in range(40)} | {f"h{i}.site{i % 40}.example.org" for i in range(200)}
    picked = {k for k in keys if "." in k and hashlib.sha256(f"blocked:{k}".encode()).hexdigest()[0] in "01"}
    assert {r.key for r in url_filter.blocklist(pages).collect()} == picked and 10 < len(picked) < 80
    judged = url_filter.judge(pages, url_filter.blocklist(pages), rules=()).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == {i for i, u in enumerate(urls) if u and any(u.split("/")[2] == k or u.split("/")[2].endswith("." + k) for k in picked if "://" in u)}


def test_more_buckets_than_tasks(spark, monkeypatch):
    rng = random.Random(6)
    shared = " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(80)) + (f" {shared}" if i % 5 == 0 else "")) for i in range(120)], "doc_id long, text string")
    want = {r.doc_id: r.data for r in substring.removals(docs).collect()}
    monkeypatch.setattr(substring, "BUCKET", 64)
    monkeypatch.setattr(substring, "PARTITIONS", 3)
    got = {r.doc_id: r.data for r in substring.removals(docs.withColumn("bucket", F.lit(1))).collect()}
    assert got == want and len(got) == 23
