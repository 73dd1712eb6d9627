"""Schemas as rules: resources by URI, faults of schemas, dynamic scope, the machine, values that are equal however they are written."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payloom.functions.columns import canonical_text, member, parsed, starts, with_variant
from payloom.model import Invalid, ResolveError, ResolveOptions
from payloom.operators.validate import validate, validate_by_capabilities, validate_payload, with_verdict
from payloom.plans import machine
from payloom.plans.compiler import Compiled
from payloom.plans.interpreter import violations
from payloom.plans.registry import rules
from payloom.sources.documents import Documents, parse_json

from test_validate import SCHEMA, payloads, random_value, schemas

READ = ResolveOptions("response", "read")


def told(errors):
    return sorted((e.path, e.keyword, e.message) for e in errors)


def by_machine(spark, schema, texts):
    found = rules(schema)
    rows = with_variant(spark.createDataFrame(list(enumerate(texts)), "i int, payload string"), "v", parsed(F.col("payload")))
    return {r.i: told(r.errors) for r in rows.select("i", machine.errors(F.col("v"), machine.constant(found), found.steps, found.annotated).alias("errors")).collect()}


def agree(spark, schema, values):
    """Compiler (where there is a finite expression), machine and interpreter say the same."""
    texts = [v if isinstance(v, str) and v[:1] == "\0" else json.dumps(v) for v in values]
    want = {i: told(violations(schema, v)) for i, v in enumerate(values)}
    assert by_machine(spark, schema, texts) == want
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    assert {r.i: told(r.errors) for r in with_verdict(rows, parsed(F.col("payload")), schema).collect()} == want
    return [bool(want[i]) for i in range(len(values))]


def test_machine_agrees_on_all_keywords(spark):
    rng = random.Random(8)
    values = [3, None, "x", []] + [{k: random_value(rng, 0 if rng.random() < 0.9 else 3) for k in rng.sample([*SCHEMA["properties"], "other"], rng.randint(0, 8))} for _ in range(150)]
    agree(spark, SCHEMA, values)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(schemas, st.lists(payloads, min_size=3, max_size=6))
def test_machine_agrees_on_random_schemas(spark, schema, values):
    assert by_machine(spark, schema, [json.dumps(v) for v in values]) == {i: told(violations(schema, v)) for i, v in enumerate(values)}


# Resources.

ITEM = {"$id": "item.json", "type": "object", "properties": {"code": {"$ref": "#/$defs/a%20b"}, "parent": {"$ref": "list.json#top"}}, "$defs": {"a b": {"type": "string"}, "c%d": {"type": "null"}}}
SHOP = {
    "$id": "https://shop.example/schemas/list.json",
    "$anchor": "top",
    "properties": {
        "items": {"items": {"$ref": "item.json"}},
        "mark": {"$ref": "item.json#/$defs/c%25d"},
        "own": {"$ref": "https://shop.example/schemas/list.json#/$defs/x~1y/oneOf/1"},
        "deep": {"$ref": "https://other.example/far.json#z"},
    },
    "$defs": {"i": ITEM, "x/y": {"oneOf": [False, {"const": 7}]}, "far": {"$id": "https://other.example/far.json", "$defs": {"q": {"$anchor": "z", "enum": ["far"]}}}},
}


def test_resources_in_a_document(spark):
    values = [{"items": [{"code": "x"}, {"code": 1}]}, {"items": [{"parent": {"items": [{"code": None}]}}]}, {"mark": None}, {"mark": 1}, {"own": 7}, {"own": 8}, {"deep": "far"}, {"deep": "near"}]
    assert agree(spark, SHOP, values) == [True, True, False, True, False, True, False, True]


def test_other_documents_by_their_uris():
    found = rules({"$ref": "https://lib.example/b.json#/properties/k"}, {"https://lib.example/b.json": {"properties": {"k": {"$ref": "c.json"}}}, "https://lib.example/c.json": {"type": "string"}})
    assert found.nodes[0] == {"type": "string"}


@pytest.mark.parametrize(
    "schema, said",
    [
        ({"$ref": "gone.json"}, "gone.json"),
        ({"$ref": "#/$defs/none"}, "points nowhere"),
        ({"$ref": "#none"}, "points nowhere"),
        ({"$defs": {"a": {"$id": "x.json"}, "b": {"$id": "x.json"}}}, "two resources"),
        ({"allOf": [{"$ref": "#"}]}, "without going into the value"),
        ({"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}}, "each other"),
    ],
)
def test_references_that_lead_nowhere(schema, said):
    with pytest.raises(ResolveError, match=said) as e:
        rules(schema)
    assert e.value.kind == "InvalidSchema" and e.value.exit_code == 2


def test_dynamic_scope(spark):
    """A tree whose nodes are whatever extends it: the outermost anchor on the way counts."""
    tree = {"$id": "tree.json", "$dynamicAnchor": "node", "type": "object", "properties": {"data": True, "children": {"items": {"$dynamicRef": "#node"}}}}
    strict = {"$id": "strict.json", "$dynamicAnchor": "node", "$ref": "tree.json", "unevaluatedProperties": False, "$defs": {"t": tree}}
    values = [{"children": [{"data": 1}]}, {"children": [{"daat": 1}]}, {"children": [{"children": [{"x": 1}]}]}, {"more": 1}]
    assert agree(spark, strict, values) == [False, True, True, True]
    plain = {"$ref": "tree.json", "$defs": {"t": tree}}
    assert agree(spark, plain, values) == [False, False, False, False]
    # where the reference first leads to a plain anchor, it is a plain one
    fixed = {"$id": "root.json", "$ref": "leaf.json", "$defs": {"o": {"$dynamicAnchor": "n", "type": "string"}, "l": {"$id": "leaf.json", "properties": {"a": {"$dynamicRef": "#n"}}, "$defs": {"n": {"$anchor": "n", "type": "integer"}}}}}
    assert agree(spark, fixed, [{"a": 1}, {"a": "x"}]) == [False, True]


# Faults of schemas.


@pytest.mark.parametrize(
    "schema, place",
    [
        ({"type": 5}, "/type"), ({"type": "text"}, "/type"), ({"type": []}, "/type"), ({"minimum": "a"}, "/minimum"), ({"minimum": True}, "/minimum"), ({"required": "id"}, "/required"), ({"required": ["a", "a"]}, "/required"),
        ({"pattern": "["}, "/pattern"), ({"pattern": "(?P<x>a)"}, "/pattern"), ({"patternProperties": {"(": True}}, "/patternProperties"), ({"properties": []}, "/properties"), ({"properties": {"a": 3}}, "/properties/a"), ({"items": "x"}, "/items"),
        ({"allOf": {}}, "/allOf"), ({"anyOf": []}, "/anyOf"), ({"enum": "a"}, "/enum"), ({"minLength": -1}, "/minLength"), ({"maxItems": 1.5}, "/maxItems"), ({"multipleOf": 0}, "/multipleOf"), ({"uniqueItems": 1}, "/uniqueItems"),
        ({"dependentRequired": {"a": "b"}}, "/dependentRequired"), ({"$defs": {"unused": {"not": 4}}}, "/$defs/unused/not"), ({"$ref": 3}, "/$ref"), ([], "the root"),
    ],
)
def test_what_is_no_schema(spark, schema, place):
    with pytest.raises(ResolveError) as e:
        rules(schema)
    assert e.value.kind == "InvalidSchema" and place in e.value.message


def test_what_is_a_schema():
    for schema in (True, {}, {"minLength": 2.0}, {"type": ["string", "null"]}, {"required": []}, {"unknown": {"type": 5}}, {"default": {"type": 5}}, {"const": {"pattern": "["}}, {"prefixItems": []}, {"enum": []}):
        rules(schema)


def test_a_bad_schema_is_the_fault_of_its_own_payloads(spark):
    files = {
        "good": {"properties": {"a": {"type": "string"}}},
        "bad": {"properties": {"a": {"pattern": "["}}},
        "java": {"properties": {"a": {"pattern": "(?P<x>a)b"}}},  # which one engine reads and the other does not
        "type": {"type": 5},
    }
    docs = Documents(fetch=lambda url: json.dumps(files[url.rpartition("/")[2]]))
    entry = lambda name: {"about": {"capabilities": {"com.example.root": [{"version": "2026-01-01", "schema": f"https://example.com/{name}"}]}}}
    rows = [(name, a, json.dumps({**entry(name), "a": a})) for name in files for a in ("x", 1)] + [("profile", "", '{"meta": {"profile": 3}}')]
    got = {(r.name, r.a): (r.exit_code, tuple(e.keyword for e in r.errors)) for r in validate_by_capabilities(spark.createDataFrame([(n, str(a), p) for n, a, p in rows], "name string, a string, payload string"), docs, "read").collect()}
    assert got["good", "x"] == (0, ()) and got["good", "1"] == (1, ("type",))
    assert {v for k, v in got.items() if k[0] in ("bad", "java", "type")} == {(2, ("InvalidSchema",))}
    assert got["profile", ""] == (2, ("InvalidEnvelope",))


# Recursion and size.


def test_recursion_needs_no_python(spark):
    tree = {"type": "object", "properties": {"v": {"type": "integer"}, "name": {"pattern": r"^\p{L}+$"}, "kids": {"items": {"$ref": "#"}}}, "unevaluatedProperties": False}
    deep: dict = {"v": "deep"}
    for _ in range(60):
        deep = {"v": 1, "kids": [{"v": 2}, deep]}
    values = [{"v": 1, "kids": [{"v": 2}, {"v": "x", "odd": 1}]}, {"name": "été"}, {"name": "a1"}, deep, {}, {"kids": [{"kids": [{"kids": [3]}]}]}]
    assert agree(spark, tree, values) == [True, False, True, True, False, True]
    rows = spark.createDataFrame([('{"v": 1e400}',), ('{"v": 1}',), ('{"name": "1e400"}',)], "payload string")
    checked = validate(rows, tree, READ)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert [r.exit_code for r in checked.collect()] == [2, 0, 1]


def test_wide_payloads_by_the_machine(spark):
    tree = {"type": "object", "properties": {"kids": {"items": {"$ref": "#"}}, "v": {"maximum": 3}}}
    value = {"kids": [{"v": i % 5, "kids": [{"v": i % 7}]} for i in range(3000)]}
    got = by_machine(spark, tree, [json.dumps(value)])[0]
    assert len(got) == sum((i % 5 > 3) + (i % 7 > 3) for i in range(3000))


def test_unevaluated_grows_with_the_schema(spark):
    def nested(n):
        schema = {"properties": {"p0": {"type": "string"}}}
        for i in range(1, n + 1):
            schema = {"allOf": [schema, {"properties": {f"p{i}": {"type": "string"}}}], "unevaluatedProperties": False}
        return schema

    def size(n):
        begun = time.time()
        plan = spark.range(1).select(F.parse_json(F.lit("{}")).alias("v")).select(Compiled(nested(n)).errors(F.col("v")).alias("e"))
        return len(plan._jdf.queryExecution().analyzed().toString()), time.time() - begun

    (five, _), (ten, seconds) = size(5), size(10)
    assert ten < 2.5 * five and seconds < 10
    inner = {"allOf": [{"properties": {"a": True}}, {"anyOf": [{"properties": {"b": {"type": "string"}}}, {"patternProperties": {"^c": True}}]}, {"if": {"required": ["d"]}, "then": {"properties": {"d": True}}, "else": {"properties": {"e": True}}}], "unevaluatedProperties": False}
    agree(spark, inner, [{"a": 1, "b": "x", "c1": 2, "e": 1}, {"b": 2, "c": 1}, {"d": 1, "e": 1}, {"z": 1}])
    wrapped = {"$ref": "#/$defs/n", "unevaluatedProperties": {"type": "null"}, "dependentSchemas": {"q": {"properties": {"r": True}}}, "$defs": {"n": inner}}
    agree(spark, wrapped, [{"a": 1}, {"q": None, "r": 1}, {"b": "x", "x": 3}])


# Values.


def test_equal_values_are_equal_however_written(spark):
    pairs = [("10000000000", "1e10"), ("1e-7", "0.0000001"), ("100", "1.00E+2"), ("0", "-0.0"), ("-12.50", "-1.25e1"), ('{"a":[1.0,{"b":2e0}]}', '{"a":[1,{"b":2}]}'), ("123456789012345678901234567890", "123456789012345678901234567890.0")]
    other = [("1", "10"), ("1", "-1"), ('"1.0"', '"1"'), ('"1e1"', '"10"'), ("9007199254740993", "9007199254740992"), ('{"1.0":1}', '{"1":1}')]
    rows = spark.createDataFrame([(a, b) for a, b in pairs + other], "a string, b string")
    got = [r.e for r in rows.select((canonical_text(F.col("a")) == canonical_text(F.col("b"))).alias("e")).collect()]
    assert got == [True] * len(pairs) + [False] * len(other)
    agree(spark, {"uniqueItems": True}, [[10**10, 1e10], [1e-7, 0.0000001], [[1e3], [1000]], [{"a": 5e-1}, {"a": 0.5}], [1, True], [2**53, 2**53 + 1]])
    agree(spark, {"enum": [[1e3], {"a": 0.5}, 7, "x"]}, [[1000], {"a": 5e-1}, 7.0, "x", "7", [1001]])
    agree(spark, {"const": {"k": [1e10]}}, [{"k": [10000000000]}, {"k": [1]}])


def test_names_of_all_kinds(spark):
    names = ["customer's", 'say "x"', "a\\b", "a.b", "", "it's \"both\"", "a/b~c", "[0]", "$", "é", "q?", "*"]
    schema = {"properties": {n: {"type": "integer"} for n in names}, "required": names, "dependentRequired": {n: ["z"] for n in names}, "additionalProperties": False}
    agree(spark, schema, [{n: 1 for n in names}, {n: "x" for n in names}, {}, {names[0]: None, "'": 1, "b": 2}])
    v = F.parse_json(F.lit(json.dumps({n: i for i, n in enumerate(names)})))
    row = spark.range(1).select(*(member(v, n).cast("int").alias(f"c{i}") for i, n in enumerate(names))).first()
    assert list(row) == list(range(len(names)))


def test_last_of_repeated_keys_and_numbers_beyond_all(spark):
    rows = spark.createDataFrame([('{"a": "x", "a": 1}',), ('{"a": 1, "a": "x"}',), ('{"a": -1e999}',), ('{"a": ' + "9" * 400 + "}",), ('{"b": "1e400"}',), ('{"a": 1e308}',), ('{"a": 1e-400}',)], "payload string")
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys", None)
    got = validate(rows, {"properties": {"a": {"type": "number"}}}, READ).collect()
    assert [r.exit_code for r in got] == [0, 1, 2, 2, 0, 0, 0]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", None) == before
    for text in ('{"a": 1e400}', "[-1e999]"):
        with pytest.raises(ResolveError):
            parse_json(text)
    with pytest.raises(Invalid):
        validate_payload({"a": "x"}, {"properties": {"a": {"type": "number"}}}, READ)


def test_starts(spark):
    rng = random.Random(1)
    arrays = [[], [3], [rng.randint(0, 5) for _ in range(64)], [rng.randint(0, 5) for _ in range(65)], [rng.randint(0, 9) for _ in range(1000)]]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    got = {r.i: r.s for r in rows.select("i", starts(F.col("a")).alias("s")).collect()}
    assert got == {i: [sum(a[:k]) for k in range(len(a))] for i, a in enumerate(arrays)}


def test_many_sets_of_capabilities_in_one_plan(spark):
    """Signatures are data: the plan is as long for three hundred sets as for three."""

    def run(n):
        docs = Documents(fetch=lambda url: json.dumps({"required": ["k"], "properties": {"k": {"maximum": int(url.rpartition("/")[2]) % 5}}, "title": url}))
        rows = spark.range(n).select("id", F.concat(F.lit('{"about": {"capabilities": {"com.example.root": [{"version": "2026-01-01", "schema": "https://example.com/'), F.col("id").cast("string"), F.lit('"}]}}, "k": 2}')).alias("payload"))
        return validate_by_capabilities(rows, docs, "read")

    some, few, many = run(12), run(30), run(300)
    assert {r.id: r.exit_code for r in some.select("id", "exit_code").collect()} == {i: int(2 > i % 5) for i in range(12)}
    plan = lambda df: re.sub(r"[0-9]+", "", df._jdf.queryExecution().optimizedPlan().toString())
    assert len(plan(few)) == len(plan(many))
    assert {r.id: r.exit_code for r in many.select("id", "exit_code").collect()} == {i: int(2 > i % 5) for i in range(300)}


def test_shallow_values_go_by_written_out_rules(spark):
    from payloom.model import ResolveOptions
    from payloom.operators.validate import error_rows, validate
    from payloom.plans.interpreter import violations
    from payloom.plans.registry import DEEP, rules

    schema = {"type": "object", "properties": {"n": {"maximum": 3}, "next": {"$ref": "#"}, "all": {"items": {"anyOf": [{"$ref": "#"}, {"const": 1}]}}}, "unevaluatedProperties": False}
    flat, depth = rules(schema).written_out()
    assert not flat.large and 1 < depth <= DEEP
    values = [{"n": 5, "all": [1, 2, {"n": 4}, {"all": [3]}]}]
    for i in range(DEEP + 2):
        values.append({"n": i, "next": values[-1], **({"odd": 1} if i % 3 == 0 else {})})
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, payload string")
    found = sorted((r.id, r.path, r.keyword) for r in error_rows(validate(frame, schema, ResolveOptions("response", "read")), "id").collect())
    assert found == sorted((i, e.path, e.keyword) for i, v in enumerate(values) for e in violations(schema, v))


def test_loops_that_only_add_errors_go_by_rounds(spark):
    """Deep values are held against the rules round by round; where a loop does more than add errors, rounds are not used."""
    node = {
        "type": "object",
        "properties": {"n": {"maximum": 3}, "a'b\"c": {"$ref": "#"}, "list": {"type": "array", "minItems": 1, "prefixItems": [{"const": 0}, {"$ref": "#"}], "items": {"$ref": "#/$defs/other"}}},
        "patternProperties": {"^p": {"allOf": [{"$ref": "#"}, {"required": ["n"]}]}},
        "unevaluatedProperties": False,
        "$defs": {"other": {"properties": {"n": {"minimum": 2}}, "additionalProperties": {"items": {"$ref": "#"}}}},
    }
    assert rules(node).in_rounds() is not None
    for odd in ({"anyOf": [{"items": {"$ref": "#"}}, True]}, {"not": {"items": {"$ref": "#"}}}, {"contains": {"$ref": "#"}}, {"allOf": [{"properties": {"a": {"$ref": "#"}}}], "unevaluatedProperties": False}):
        assert rules(odd).in_rounds() is None
    rng = random.Random(5)

    def value(depth):
        if depth == 0 or rng.random() < 0.1:
            return rng.choice([1, 5, "x", None, [], {}, {"n": 4}, {"odd": 1}])
        inner = {"n": rng.randint(0, 5)} if rng.random() < 0.7 else {}
        for name in ("a'b\"c", "p/~1", "q"):
            if rng.random() < 0.4:
                inner[name] = value(depth - 1)
        if rng.random() < 0.6:
            inner["list"] = [rng.choice([0, 1]), value(depth - 1), {"n": rng.randint(0, 3), "more": [value(depth - 1)]}][: rng.randint(0, 3)]
        return inner

    values = [value(rng.randint(0, 9)) for _ in range(150)]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, payload string")
    got = {r.i: told(r.errors) for r in validate(frame, node, READ).collect()}
    assert got == {i: told(violations(node, v)) for i, v in enumerate(values)}
    deep: dict = {"n": 9}
    for _ in range(60):
        deep = {"list": [0, deep]}
    row = validate(spark.createDataFrame([(json.dumps(deep),)], "payload string"), node, READ).first()
    assert told(row.errors) == told(violations(node, deep)) == [("/list/1" * 60 + "/n", "maximum", "must be at most 3")]
