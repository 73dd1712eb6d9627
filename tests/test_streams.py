"""Streams of payloads that describe themselves."""

from __future__ import annotations

import json

from payloom.model import ResolveError
from payloom.sources.documents import Documents
from payloom.streaming.validate import validate_stream_by_capabilities

ROWS = "i int, payload string"


def test_sets_of_capabilities_are_kept_and_new_ones_composed(spark, tmp_path):
    files = {"first": {"properties": {"k": {"maximum": 3}}}, "second": {"required": ["z"]}}
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(url):  # in a task; what was asked for is told by a file
        name = url.rpartition("/")[2]
        (asked / f"{name}-{len(list(asked.iterdir()))}").write_text("")
        if name == "late" and not (tmp_path / "late").exists():
            raise ResolveError("NetworkError", "down")
        return json.dumps(files.get(name, {}))

    docs = Documents(fetch=fetch)
    of = lambda name, **more: json.dumps({"about": {"capabilities": {"com.example.root": [{"version": "2026-01-01", "schema": f"https://example.com/{name}"}]}}, **more})

    def put(name, *rows):
        spark.createDataFrame(list(rows), ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
        validate_stream_by_capabilities(stream, docs, "read", str(tmp_path / "registry"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return {r.i: (r.exit_code, [e.keyword for e in r.errors]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put("a", (1, of("first", k=2)), (2, of("first", k=4)), (3, of("late")), (4, "{"), (5, "{}"))
    got = run()
    assert got == {1: (0, []), 2: (1, ["maximum"]), 3: (3, ["SchemaFetch"]), 4: (2, ["InvalidJson"]), 5: (2, ["NotSelfDescribing"])}
    firsts = sum(p.name.startswith("first") for p in asked.iterdir())
    (tmp_path / "late").write_text("")
    put("b", (6, of("second")), (7, of("second", z=1)), (8, of("first", k=9)), (9, of("late")))
    got = run()
    assert {i: got[i] for i in (6, 7, 8, 9)} == {6: (1, ["required"]), 7: (0, []), 8: (1, ["maximum"]), 9: (0, [])} and got[2] == (1, ["maximum"])
    assert sum(p.name.startswith("first") for p in asked.iterdir()) == firsts  # read from the registry
    assert {p.name for p in (tmp_path / "registry").iterdir() if p.is_dir()} == {"batch=0", "batch=1"}
