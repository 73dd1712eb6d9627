"""References and composition over tables of documents, against what the driver's own functions give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from payloom.model import PayloomError, ResolveError
from payloom.operators.bundle import bundle_corpus, compose_from_tables
from payloom.operators.validate import Tables, validate_by_capabilities
from payloom.sources.documents import Documents

AT = "https://s.example.com/"  # which names that begin with com.example.s belong to
FILES = {
    "a": {"properties": {"x": {"$ref": "b.json#/$defs/m~1n", "title": "mine"}, "y": {"$ref": "#/$defs/z"}}, "$defs": {"z": {"allOf": [{"$ref": "c.json"}, {"$ref": "#"}]}}},
    "b": {"$defs": {"m/n": {"title": "theirs", "items": {"$ref": "c.json"}}}},
    "c": {"type": "string", "more": {"$ref": "d.json"}},
    "d": {"type": "number"},
    "p": {"$ref": "q.json"},
    "q": {"anyOf": [{"$ref": "p.json"}]},
    "r": {"$ref": "q.json"},
    "s": {"$ref": "gone.json"},
    "t": {"$ref": "d.json#/none"},
    "u": {"$ref": "s.json"},
    "v": True,
    "w": {"$ref": "v.json", "k": 1},
    "own": {"$ref": "#/$defs/own", "$defs": {"own": {"$ref": "#/$defs/own"}}},
}


def corpus(spark, files):
    return spark.createDataFrame([(f"{AT}{n}.json", v if isinstance(v, str) else json.dumps(v)) for n, v in files.items()], "uri string, content string")


def test_bundled_as_one_by_one(spark):
    def fetch(url):
        name = url.removeprefix(AT).removesuffix(".json")
        if name not in FILES:
            raise ResolveError("NetworkError", "gone")
        return json.dumps(FILES[name])

    got = {r.uri: r for r in bundle_corpus(corpus(spark, FILES).withColumns({"fragment": F.lit("x"), "fault": F.lit(1)})).collect()}
    assert len(got) == len(FILES)
    for name, schema in FILES.items():
        r = got[f"{AT}{name}.json"]
        try:
            want = Documents(fetch=fetch).bundle_remote(schema, f"{AT}{name}.json")
        except PayloomError:
            assert r.content is None and r.fault
        else:
            assert r.fault is None and json.loads(r.content) == want, name
    assert "circular" in got[f"{AT}r.json"].fault and "gone.json" in got[f"{AT}u.json"].fault and "nowhere" in got[f"{AT}t.json"].fault


def test_broken_documents_and_none(spark):
    got = {r.uri: (r.content, bool(r.fault)) for r in bundle_corpus(corpus(spark, {"x": "{", "y": {"$ref": "x.json"}, "z": []})).collect()}
    assert got == {f"{AT}x.json": (None, True), f"{AT}y.json": (None, True), f"{AT}z.json": ("[]", False)}
    assert bundle_corpus(corpus(spark, {"x": {}}).limit(0)).collect() == []


def test_composed_from_tables(spark):
    root, ext = "com.example.s.thing", "com.example.s.extra"
    of = lambda name, **more: [{"version": "2026-01-01", "schema": f"{AT}{name}.json", **more}]
    schemas = corpus(spark, {"thing": {"type": "object"}, "extra": {"$defs": {root: {"required": ["k"]}}}, "bare": {"$defs": {}}})
    profiles = corpus(spark, {"good": {"about": {"capabilities": {"com.example.s.thing": of("thing")}}}, "bad": {"about": {}}})
    sets = [("1", {root: of("thing")}, None), ("2", {root: of("thing"), ext: of("extra", extends=root)}, None), ("3", {root: of("none")}, None), ("4", {root: of("thing"), ext: of("bare", extends=root)}, None), ("5", None, "good"), ("6", None, "bad"), ("7", None, "none"), ("8", {}, None), ("9", {root: []}, None)]
    rows = spark.createDataFrame([(k, None if c is None else json.dumps(c), p and f"{AT}{p}.json") for k, c, p in sets], "key string, capabilities string, profile string")
    got = {r.key: (r.content and json.loads(r.content), r.kind) for r in compose_from_tables(rows, schemas, profiles).collect()}
    assert got["1"] == ({"type": "object"}, None) and got["2"] == ({"allOf": [{"required": ["k"]}]}, None) and got["5"] == ({"type": "object"}, None)
    assert {k: got[k][1] for k in "346789"} == {"3": "SchemaFetch", "4": "MissingDefEntry", "6": "ProfileFetch", "7": "ProfileFetch", "8": "EmptyCapabilities", "9": "InvalidCapability"}


def test_payloads_by_tables_as_by_documents(spark):
    root = "com.example.s.thing"
    files = {"thing": {"properties": {"n": {"$ref": "most.json#/$defs/m"}}}, "most": {"$defs": {"m": {"maximum": 3}}}, "prof": {"about": {"capabilities": {root: [{"version": "2026-01-01", "schema": f"{AT}thing.json"}]}}}}
    payloads = [{"about": files["prof"]["about"], "n": 4}, {"about": files["prof"]["about"], "n": 1}, {"meta": {"profile": f"{AT}prof.json"}, "thing": {"n": 9}}, {"meta": {"profile": f"{AT}x.json"}}, {"about": {"capabilities": {root: [{"version": "1"}]}}}]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "i int, payload string")
    def fetch(url):
        if url.removeprefix(AT).removesuffix(".json") not in files:
            raise ResolveError("NetworkError", "gone")
        return json.dumps(files[url.removeprefix(AT).removesuffix(".json")])

    told = lambda source: {r.i: (r.direction, r.exit_code, [e.keyword for e in r.errors]) for r in validate_by_capabilities(rows, source, "read").collect()}
    every = corpus(spark, files)
    assert told(Tables(every, every)) == told(Documents(fetch=fetch))
