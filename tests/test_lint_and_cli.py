from __future__ import annotations

import json

import pytest

from payloom import samples
from payloom.cli import main
from payloom.operators import lint


def codes(spark, **documents):
    rows = [(f"{k}.json", v if isinstance(v, str) else json.dumps(v)) for k, v in documents.items()]
    found = lint.diagnostics(spark.createDataFrame(rows, "uri string, content string"))
    return sorted((r.code, r.path) for r in found.collect())


def test_lint_rules(spark):
    everything = codes(spark, **{k.removesuffix(".json"): v for k, v in samples.CORPUS.items()}, broken="{")
    assert everything == [
        ("E001", "/"), ("E002", "/properties/b"), ("E003", "/properties/a"), ("E003", "/properties/d"),
        ("E004", "/properties/a/on_request"), ("E004", "/properties/c/on_request/transition"), ("E004", "/properties/c/on_request/transition"),
        ("E005", "/properties/b/on_request/update"), ("E005", "/properties/d/on_request"), ("E006", "/requires/capabilities/y"), ("E006", "/requires/protocol/min"),
        ("E007", "/requires/capabilities/y"), ("E008", "/$defs/x/examples/1"), ("W002", "/"), ("W003", "/properties/b/on_request/search"), ("W004", "/requires/capabilities/x"), ("W005", "/requires/more"),
    ]


def test_lint_of_odd_documents(spark):
    assert codes(spark, a="[]", b='"x"', c="null") == [("W002", "/")] * 3
    assert codes(spark, a={"$id": "a", "requires": []}) == [("E006", "/requires")]
    assert codes(spark, a={"$id": "a", "requires": {"capabilities": 3, "protocol": {"min": "2026-01-01", "max": 4}}}) == [("E006", "/requires/capabilities"), ("E006", "/requires/protocol/max")]
    assert codes(spark, a={"$id": "a", "$ref": "#", "x": {"$ref": "https://elsewhere.example/x"}, "examples": [1], "y": [{"on_request": 1}]}) == [("E005", "/y/0/on_request")]
    assert codes(spark, a={"$id": "a", "p": {"on_request": {"create": {"x": 1}, "update": {"transition": 3}}}}) == [("E005", "/p/on_request/create"), ("E005", "/p/on_request/update")]


@pytest.fixture
def folder(tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    put("schema.json", samples.ORDER)
    put("create.json", {"lines": [{"part": "s", "units": 6}]})
    put("bad.json", {"id": "x"})
    put("payload.json", {"about": {"capabilities": {"com.example.order": [{"version": "2026-01-01", "schema": "https://example.com/schema.json"}]}}, "number": "1234", "state": "P", "lines": [{"part": "s", "units": 6}]})
    put("broken.json", "{")
    put("external.json", {"$id": "e", "properties": {"l": {"$ref": "schema.json#/$defs/line"}}})
    return tmp_path


def run(capsys, *args):
    code = main([str(a) for a in args])
    return (code, *capsys.readouterr())


def test_cli_resolve(folder, capsys):
    code, out, _ = run(capsys, "resolve", folder / "schema.json", "--request", "--op", "create")
    assert code == 0 and list(json.loads(out)["properties"]) == ["urgency", "amount", "lines"]
    code, out, _ = run(capsys, "resolve", folder / "external.json", "--response", "--op", "read", "--bundle", "--output", folder / "out.json", "--pretty")
    assert code == 0 and out == "" and json.loads((folder / "out.json").read_text())["properties"]["l"]["required"] == ["units", "part"]
    assert "does not tell its direction" in run(capsys, "resolve", folder / "schema.json", "--op", "read")[2]
    code, _, err = run(capsys, "resolve", folder / "payload.json", "--op", "read", "--bundle", "--schema-local-base", folder)
    assert code == 2 and "--bundle is for schemas" in err
    assert run(capsys, "resolve", folder / "payload.json", "--op", "read", "--schema-local-base", folder)[0] == 0
    assert run(capsys, "resolve", folder / "none.json", "--request", "--op", "read")[0] == 3
    assert run(capsys, "resolve", folder / "schema.json", "--request", "--op", "read", "--output", folder / "no" / "x")[0] == 3
    assert json.loads(run(capsys, "resolve", folder / "schema.json", "--request", "--op", "read", "--def", "line")[1])["$ref"] == "#/$defs/line"


def test_cli_validate(folder, capsys):
    assert run(capsys, "validate", folder / "create.json", "--schema", folder / "schema.json", "--op", "create")[:2] == (0, "Valid\n")
    code, out, err = run(capsys, "validate", folder / "bad.json", "--schema", folder / "schema.json", "--op", "create")
    assert code == 1 and "Validation failed" in err
    code, out, _ = run(capsys, "validate", folder / "bad.json", "--schema", folder / "schema.json", "--op", "create", "--json")
    assert code == 1 and '"valid":false' in out
    assert run(capsys, "validate", folder / "payload.json", "--op", "complete", "--schema-local-base", folder, "--json")[0] == 1  # the closed schema knows no envelope
    code, out, _ = run(capsys, "validate", folder / "broken.json", "--op", "read", "--json")
    assert code == 2 and json.loads(out)["errors"][0]["path"] == ""
    assert run(capsys, "validate", folder / "bad.json", "--op", "read")[0] == 2
    assert run(capsys, "validate", folder / "bad.json", "--profile", folder / "none.json", "--op", "read")[0] == 3
    with pytest.raises(SystemExit):
        main(["validate", "x", "--op", "read", "--schema-remote-base", "y"])


def test_cli_compose_and_lint(spark, folder, capsys):
    assert json.loads(run(capsys, "compose", folder / "payload.json", "--schema-local-base", folder)[1])["$id"] == samples.ORDER["$id"]
    assert "nothing in the payload says" in run(capsys, "compose", folder / "bad.json")[2]
    code, out, _ = run(capsys, "lint", folder, "--format", "json")
    report = json.loads(out)
    assert code == 1 and report["files_checked"] == 6 and report["failed"] == 1
    code, out, _ = run(capsys, "lint", folder / "external.json", "-q")
    assert code == 0 and "1 files checked: 1 passed" in out
    assert run(capsys, "lint", folder / "none")[0] == 2
    assert run(capsys, "lint", folder / "bad.json", "--strict")[0] == 1


def test_nothing_of_a_corpus_is_broadcast(spark):
    corpus = samples.corpus(spark)
    found = lint.diagnostics(corpus)
    for frame in (found, lint.file_results(corpus, found)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
