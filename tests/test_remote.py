"""Documents of a local server as rows: some are there, some are missing, late or no text."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from payloom.operators.bundle import bundle_corpus
from payloom.sources.remote import Urls, _Reader, fetch_table, read_remote


class Server(BaseHTTPRequestHandler):
    now, most, lock = 0, 0, threading.Lock()

    def do_GET(self):  # noqa: N802
        with Server.lock:
            Server.now += 1
            Server.most = max(Server.most, Server.now)
        try:
            name = self.path.rpartition("/")[2].removesuffix(".json")
            n = int(name)
            if n % 10 == 3:
                self.send_error(404)
            elif n == 7:
                time.sleep(4)
            else:
                body = b"\xff\xfe" if n % 50 == 9 else json.dumps({"n": n, "next": {"$ref": f"{n + 1}.json#/n"}} if n % 10 == 0 else {"n": n}).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)
        finally:
            with Server.lock:
                Server.now -= 1

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_two_hundred_documents_some_failing(spark, base):
    urls = [f"{base}{n}.json" for n in range(200)]
    got = {int(r.uri.rpartition("/")[2][:-5]): r for r in read_remote(spark, [*urls, urls[0]], per_host=3, timeout=1).collect()}
    failing = {n for n in range(200) if n % 10 == 3 or n == 7 or n % 50 == 9}
    assert {n for n, r in got.items() if r.fault} == failing and len(got) == 200 and Server.most <= 4  # one may be left behind by its time-out
    assert all(json.loads(r.content)["n"] == n for n, r in got.items() if not r.fault) and all(r.content is None for r in got.values() if r.fault)
    table = spark.createDataFrame([(u, 1) for u in urls[:60] + urls[:5]] + [(None, 1), ("ftp://x/y", 1)], "link string, fault int")
    rows = fetch_table(table, "link", 4, timeout=1).collect()
    assert {r.uri for r in rows if not r.fault} == {f"{base}{n}.json" for n in range(60) if n not in failing} and len(rows) == 61


def test_fetched_documents_are_bundled(spark, base):
    corpus = read_remote(spark, [f"{base}{n}.json" for n in range(20, 32)]).where("fault is null")
    got = {r.uri.rpartition("/")[2]: r for r in bundle_corpus(corpus).collect()}
    assert len(got) == 11 and got["20.json"].content and got["21.json"].fault is None


def test_partitions_by_host():
    urls = [f"https://a.example/{i}" for i in range(10)] + ["https://B.example/1", "https://b.example/2", "http://[bad", "https://a.example/0"]
    parts = _Reader(urls, 4, 1).partitions()
    assert sorted(len(p.urls) for p in parts) == [1, 1, 1, 2, 2, 3, 3] and all(isinstance(p, Urls) for p in parts)
    assert [p.urls for p in _Reader([], 4, 1).partitions()] == [[]]
