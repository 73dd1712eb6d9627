from __future__ import annotations

import json

import pytest

from payloom import samples
from payloom.functions.names import check_binding, join_url, map_prefix, reverse_labels, url_path
from payloom.model import BindingError, Capability, ComposeError, Requires, ResolveError, SchemaBase, VersionRange, is_version
from payloom.plans.compose import compose, compose_payload, detect_direction, envelope_body, graph_root, inline_own, parse_capabilities, violations
from payloom.sources.documents import Documents, navigate, schema_files

A = "com.example.a"


def cap(name, extends=None, version="2026-01-01"):
    return Capability(name, version, f"{name}.json", tuple(extends) if extends is not None else None)


def held(tmp_path, **documents):
    for name, value in documents.items():
        (tmp_path / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value))
    return Documents()


def test_direction():
    assert detect_direction({"about": {"capabilities": None}, "meta": {"profile": "x"}}) == "response"
    assert detect_direction({"meta": {"profile": None}}) == "request"
    assert detect_direction({"about": {"meta": {"profile": "x"}}}) is None and detect_direction([1]) is None


def test_capabilities_take_the_first_version():
    found = parse_capabilities({A: [{"version": "1", "schema": "s"}, {"version": "2", "schema": "t"}], "b": [{"version": "1", "schema": "s", "extends": A}]})
    assert found == [Capability(A, "1", "s"), Capability("b", "1", "s", (A,))]


@pytest.mark.parametrize("value", [[], 3, [{"schema": "s"}], [{"version": "1"}], [{"version": "1", "schema": "s", "extends": None}], [{"version": "1", "schema": "s", "extends": [1]}]])
def test_bad_capabilities(value):
    with pytest.raises(ComposeError) as e:
        parse_capabilities({A: value})
    assert e.value.kind == "InvalidCapability"


@pytest.mark.parametrize(
    ("caps", "kind"),
    [([cap("a", ["b"]), cap("b", ["a"])], "NoRootCapability"), ([cap("a"), cap("b")], "MultipleRootCapabilities"), ([cap("a"), cap("b", ["x"])], "UnknownParent"), ([cap("a"), cap("b", ["c"]), cap("c", ["b"])], "OrphanExtension"), ([cap("a"), cap("b", [])], "OrphanExtension")],
)
def test_unsound_graphs(caps, kind):
    with pytest.raises(ComposeError) as e:
        graph_root(caps)
    assert e.value.kind == kind


def test_diamonds_are_sound():
    assert graph_root([cap("a"), cap("b", ["a"]), cap("c", ["a"]), cap("d", ["b", "c"])]).name == "a"


def test_composition_of_samples():
    docs = samples.documents()
    root = compose(parse_capabilities(samples.capabilities("2026-02-01")), docs)
    assert root["properties"]["lines"]["items"]["required"] == ["units", "part"]
    both = compose(parse_capabilities(samples.capabilities("2026-02-01", samples.DISCOUNT, samples.POINTS)), docs)
    assert list(both) == ["allOf"] and len(both["allOf"]) == 2 and both["allOf"][1]["properties"]["points"]["required"] == ["earned"]
    with pytest.raises(ComposeError) as e:
        compose(parse_capabilities(samples.capabilities("2027-02-01", samples.DISCOUNT)), docs)
    assert e.value.kind == "VersionConstraintViolation" and e.value.details["actual"] == "2027-02-01"


def test_containers_merge_what_extensions_say():
    base = {"$id": "c", "$defs": {"search_request": {"type": "object"}, "helper": {}}}
    ext = lambda n: {"$defs": {A: {"$defs": {"search_request": {"minProperties": n}}}}}
    texts = {"a": base, "b": ext(1), "c": ext(2), "d": {"$defs": {A: {"type": "object"}}}}
    docs = Documents()
    docs.file = lambda path: texts[str(path).partition(".")[0].rpartition("/")[2]]
    one = compose([Capability(A, "1", "a.json"), Capability("b", "1", "b.json", (A,))], docs)
    assert one["$defs"] == {"search_request": {"minProperties": 1}, "helper": {}} and one["$id"] == "c"
    two = compose([Capability(A, "1", "a.json"), Capability("b", "1", "b.json", (A,)), Capability("c", "1", "c.json", (A,))], docs)
    assert two["$defs"]["search_request"] == {"allOf": [{"minProperties": 1}, {"minProperties": 2}]}
    with pytest.raises(ComposeError) as e:
        compose([Capability(A, "1", "a.json"), Capability("d", "1", "d.json", (A,))], docs)
    assert e.value.kind == "ContainerExtensionShape"


def test_failures_before_and_at_reading():
    with pytest.raises(ComposeError) as e:
        compose([], Documents())
    assert e.value.kind == "EmptyCapabilities" and "empty" in e.value.message
    with pytest.raises(ComposeError) as e:
        compose([Capability("com.other.a", "1", "https://example.com/s.json")], Documents())
    assert e.value.kind == "NamespaceBindingViolation"
    with pytest.raises(ComposeError) as e:
        compose([cap("nowhere")], Documents())
    assert e.value.kind == "SchemaFetch" and e.value.exit_code == 3 and "cannot be had" in e.value.message
    with pytest.raises(ComposeError, match="nothing in the payload says"):
        compose_payload({}, Documents())


def test_missing_definition(tmp_path):
    docs = held(tmp_path, a={}, b={"$defs": {}})
    with pytest.raises(ComposeError) as e:
        compose([Capability("a", "1", str(tmp_path / "a.json")), Capability("b", "1", str(tmp_path / "b.json"), ("a",))], docs)
    assert e.value.kind == "MissingDefEntry"


def test_envelopes():
    caps = [cap("com.example.order"), cap("b", ["com.example.order"])]
    assert envelope_body({"order": 1}, caps) == (1, "order")
    with pytest.raises(ComposeError) as e:
        envelope_body({"x": 1}, caps)
    assert e.value.kind == "InvalidEnvelope"


def test_inlining_stops_at_cycles_and_keeps_unknown_references():
    defs = {"a": {"p": {"$ref": "#/$defs/a"}}, "b": {"$ref": "#/$defs/c"}}
    assert inline_own({"$ref": "#/$defs/a", "p2": 1}, defs) == {"p2": 1, "p": {"$ref": "#/$defs/a"}}
    assert inline_own(defs["b"], defs) == {"$ref": "#/$defs/c"}


def test_bundling(tmp_path):
    docs = held(tmp_path, a={"x": {"$ref": "b.json#/$defs/q", "title": "mine"}, "self": {"$ref": "#"}, "own": {"$ref": "#/$defs/d"}, "$defs": {"d": {"type": "string"}}}, b={"$defs": {"q": {"title": "theirs", "$ref": "#/$defs/r"}, "r": {"type": "number"}}})
    found = docs.bundle(docs.file(tmp_path / "a.json"), tmp_path)
    assert found["x"] == {"title": "mine", "type": "number"} and found["self"] == {"$ref": "#"} and found["own"] == {"type": "string"}


def test_bundling_failures(tmp_path):
    docs = held(tmp_path, a={"$ref": "b.json"}, b={"x": {"$ref": "a.json"}}, c={"$ref": "#/none"}, d={"$ref": "gone.json"}, e={"$defs": {"e": {"p": {"$ref": "#/$defs/e"}}}})
    for name, says in (("a", "circular"), ("c", "points nowhere"), ("d", "file not found"), ("e", "circular")):
        with pytest.raises(ResolveError, match=says) as e:
            docs.bundle(docs.file(tmp_path / f"{name}.json"), tmp_path)
        assert e.value.kind == "BundleError"


def test_remote_prefixes_map_to_files(tmp_path):
    held(tmp_path, a={"$ref": "https://x.example/s/b.json"}, b={"type": "null"})
    docs = Documents(SchemaBase(str(tmp_path), "https://x.example/s/"))
    assert docs.bundle(docs.file(tmp_path / "a.json"), tmp_path) == {"type": "null"}
    assert docs.capability_schema("https://x.example/s/b.json") == {"type": "null"}
    assert Documents(SchemaBase(str(tmp_path))).capability_schema("https://other.example/b.json") == {"type": "null"}
    remote = Documents(fetch=lambda url: json.dumps({"https://x.example/s/a.json": {"$ref": "c.json#/k"}, "https://x.example/s/c.json": {"k": {"type": "array"}}}[url]))
    assert remote.capability_schema("https://x.example/s/a.json") == {"type": "array"}


def test_files(tmp_path):
    held(tmp_path, bad="{", b={}, a={})
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text("{}")
    (tmp_path / "t.txt").write_text("")
    assert [f.name for f in schema_files(tmp_path)] == ["a.json", "b.json", "bad.json", "c.json"] and schema_files(tmp_path / "t.txt") == []
    for name, kind, code in (("bad.json", "InvalidJson", 2), ("none.json", "FileNotFound", 3), ("sub", "ReadError", 3)):
        with pytest.raises(ResolveError) as e:
            Documents().file(tmp_path / name)
        assert (e.value.kind, e.value.exit_code) == (kind, code)


def test_pointers():
    assert navigate({"a/b": {"~": 1}}, "/a~1b/~0") == 1 and navigate({"a": [1]}, "/a/0") is None and navigate(3, "") == 3


def test_versions():
    assert is_version("2026-02-31") and not is_version("2026-13-01") and not is_version("2026-01-01x") and not is_version(None)
    r = VersionRange.parse({"min": "2026-01-01", "max": "2026-06-01"})
    assert r.holds("2026-01-01") and r.holds("2026-06-01") and not r.holds("2026-06-02") and str(r) == "[2026-01-01, 2026-06-01]"
    assert VersionRange.parse({"max": "2026-01-01"}) is None and VersionRange.parse({"min": "2026-01-01", "max": None}) is None
    assert Requires.parse({"capabilities": {"a": {"min": "x"}}}) is None
    wants = {"requires": {"protocol": {"min": "2026-02-01"}, "capabilities": {"b": {"min": "2026-02-01"}, "none": {"min": "2030-01-01"}}}}
    assert [v[1] for v in violations("e", wants, "2026-01-01", {"b": "2026-01-01"})] == ["protocol", "b"]
    assert violations("e", {"requires": {"protocol": 3}}, "2026-01-01", {}) == []


@pytest.mark.parametrize(
    ("name", "url", "kind"),
    [
        ("com.example.a", "https://example.com/x", None),
        ("com.example.shop.a", "https://SHOP.example.com./x", None),
        ("com.example.a", "https://shop.example.com/x", "AuthorityMismatch"),
        ("com.example", "https://example.com/x", "AuthorityMismatch"),
        ("com.examplepay.a", "https://example.com/x", "AuthorityMismatch"),
        ("com.example.a", "http://example.com/x", "NonHttpsScheme"),
        ("com.example.a", "https://example.com@evil.com/x", "Userinfo"),
        ("a.a", "https://127.0.0.1/x", "NonDomainHost"),
        ("a.a", "https://[::1]/x", "NonDomainHost"),
        ("localhost.a", "https://localhost/x", "NonDomainHost"),
        ("a", "no url", "Unparsable"),
        ("a", "https:///", "Unparsable"),
        ("com.example.a", "https://example.com:65535/x", None),
        ("com.example.a", "https://example.com:/x", None),
        ("com.example.a", "https://example.com:99999/x", "Unparsable"),
        ("com.example.a", "https://example.com:8o/x", "Unparsable"),
        ("com.example.a", "https://exa%6Dple.com/x", None),
        ("com.example.a", "https://exam ple.com/x", "Unparsable"),
        ("com.example.a", "https://exam<ple.com/x", "Unparsable"),
        ("com.example.a", "https://exam%2Fple.com/x", "Unparsable"),
        ("example.xn--bcher-kva.a", "https://bücher.example/x", None),
        ("example.bücher.a", "https://bücher.example/x", "AuthorityMismatch"),
        ("de.xn--fa-hia.a", "https://faß.de/x", None),
        ("de.fass.a", "https://FAẞ.de/x", "AuthorityMismatch"),
        ("com.xn--nxasmm1c.a", "https://βόλος.com/x", None),
        ("com.xn--nxasmq6b.a", "https://ΒΌΛΟΣ.com/x", None),
        ("jp.xn--wgv71a119e.a", "https://日本語。jp/x", None),
        ("com.xn--10cl1a0b660p.a", "https://ශ්‍රී.com/x", None),
        ("com.ab.a", "https://a‍b.com/x", "Unparsable"),
        ("com.ab.a", "https://a%C2%ADb.com/x", None),
    ],
)
def test_binding(spark, name, url, kind):
    from pyspark.sql import functions as F

    from payloom.functions.names import binding_status_col

    if kind is None:
        check_binding(name, url)
    else:
        with pytest.raises(BindingError) as e:
            check_binding(name, url)
        assert e.value.kind == kind
    assert spark.range(1).select(binding_status_col(F.lit(name), F.lit(url))).first()[0] == (kind or "ok")


def test_international_hosts(spark):
    import random

    from pyspark.sql import functions as F

    from payloom.functions.hosts import to_ascii, to_ascii_col

    rng = random.Random(1)
    hosts = ["BÜCHER.Example", "münchen-ö-ñandú.org", "правда.рф", "مثال.إختبار", "é" * 60 + ".de", "żółć.pl", "straße-außen.de", "ﬁx.de", "你好你好.中国", "ἀρχή.gr", "..é", "a\u2028.é", "\u0301a.de", "क्\u200dष.in", "नी\u200cx.de", "x.Y", ""]
    hosts += ["".join(rng.choice("abz-09äöüßéñçждя中文日αβς") for _ in range(rng.randint(1, 14))) + ".com" for _ in range(80)]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", to_ascii_col(F.col("h")).alias("a")).collect()
    assert {r.h: r.a for r in rows} == {h: to_ascii(h) for h in hosts}
    assert to_ascii("bücher.de") == "xn--bcher-kva.de" and to_ascii("правда.рф") == "xn--80aafi6cg.xn--p1ai"


def test_url_helpers():
    assert reverse_labels("a.b.c.") == "c.b.a" and url_path("https://x.y/a?b#c") == "/a?b#c" and url_path("https://x.y") is None and url_path("a/b") == "a/b"
    assert map_prefix("https://x/a/b", "/l", "https://x/") == "/l/a/b" and join_url("c", "https://x/a/b") == "https://x/a/c" and join_url("http://z", "q/r") == "http://z"


def test_fetching():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path == "/s.json"
            self.send_response(200 if found else 404)
            self.end_headers()
            self.wfile.write(b'{"type": "null"}' if found else b"gone")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert Documents().any(f"{base}/s.json") == {"type": "null"}
        with pytest.raises(ResolveError) as e:
            Documents().any(f"{base}/none.json")
        assert e.value.kind == "NetworkError" and e.value.exit_code == 3
        with pytest.raises(ComposeError) as e:
            Documents().profile(f"{base}/none.json")
        assert e.value.kind == "ProfileFetch"
    finally:
        server.shutdown()
