from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payloom import samples
from payloom.model import Invalid, ResolveError, ResolveOptions, Vocabulary
from payloom.operators.validate import error_rows, exit_codes, validate, validate_by_capabilities, validate_payload, validate_self_described, verdict_json, violation_summary, with_verdict
from payloom.plans.compiler import Compiled
from payloom.plans.interpreter import violations
from payloom.plans.registry import rules
from payloom.plans.resolve import resolve
from payloom.sources.documents import Documents
from payloom.streaming.validate import rolling_violations, split_stream, validate_stream

SCHEMA = {
    "type": "object",
    "required": ["id", "items"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^a"},
        "items": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/item"}},
        "s": {"enum": ["p", 1, None, {"b": 1, "a": [2]}]},
        "n": {"anyOf": [{"type": "integer", "minimum": 3, "exclusiveMaximum": 9}, {"const": "x"}]},
        "o": {"oneOf": [{"type": "number", "multipleOf": 2}, {"type": "integer", "maximum": 5}]},
        "u": {"allOf": [{"properties": {"a": {"type": "string"}}}, {"properties": {"b": {"type": "boolean"}}}], "unevaluatedProperties": False},
        "v": {"$ref": "#/$defs/item", "unevaluatedProperties": {"type": "null"}},
        "m": {"additionalProperties": {"type": "integer"}, "propertyNames": {"maxLength": 3}, "patternProperties": {"^x": {"type": "string"}}, "maxProperties": 3, "minProperties": 1},
        "t": {"prefixItems": [{"type": "string"}, {"type": "number"}], "items": {"type": "boolean"}, "contains": {"const": True}, "maxContains": 1},
        "c": {"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["z"]}, "else": {"not": {"required": ["z"]}}},
        "d": {"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"q": {"required": ["r"]}}},
        "e": {"const": {"b": [1, 2], "a": "x"}},
        "f": False,
        "w": {"allOf": [{"prefixItems": [{"type": "string"}]}, {"contains": {"const": True}}], "unevaluatedItems": False},
        "y": {"$ref": "#count", "anyOf": [{"prefixItems": [True, True]}], "unevaluatedItems": {"type": "null"}},
    },
    "$defs": {"count": {"$anchor": "count", "type": "array", "maxItems": 3}, "item": {"type": "object", "required": ["part", "units"], "properties": {"part": {"type": ["string", "null"]}, "units": {"type": "integer", "minimum": 1}}}},
}


def same_errors(spark, schema, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, payload string")
    for r in with_verdict(rows, F.try_parse_json("payload"), schema).collect():
        found = sorted((e.path, e.keyword, e.message) for e in r.errors)
        assert found == sorted((x.path, x.keyword, x.message) for x in violations(schema, values[r.i])), values[r.i]
        assert r.valid == (not found) and r.exit_code == (1 if found else 0)


def random_value(rng, depth=0):
    simple = [None, True, False, 0, 1, 2, 3, 4, 8, 9, 2.5, 2.0, "a", "ab", "abcde", "p", "x", "", "é" * 3]
    kind = rng.random()
    if depth > 2 or kind < 0.5:
        return rng.choice(simple)
    if kind < 0.65:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    names = ["part", "units", "a", "b", "k", "z", "q", "r", "x1", "x/~", "long"]
    return {k: random_value(rng, depth + 1) for k in rng.sample(names, rng.randint(0, 4))}


def test_compiled_schema_agrees_with_interpreter(spark):
    rng = random.Random(5)
    values = [3, None, "x", [], {"id": "ab", "items": [{"part": "s", "units": 1}]}, {"id": "ab", "items": [{"part": None, "units": 1.0}], "e": {"a": "x", "b": [1, 2.0]}, "s": {"a": [2], "b": 1}, "u": {"a": "x", "b": True}}]
    for _ in range(300):
        keys = rng.sample(list(SCHEMA["properties"]) + ["other", "more"], rng.randint(0, 8))
        values.append({k: random_value(rng, 0 if rng.random() < 0.9 else 3) for k in keys})
    same_errors(spark, SCHEMA, values)


leaf = st.sampled_from([{"type": "string"}, {"type": "integer"}, {"minimum": 2}, {"const": 1}, {"enum": ["a", 2]}, {"minLength": 2}, {"required": ["a"]}, True, False])
schemas = st.recursive(
    leaf,
    lambda s: st.one_of(
        st.fixed_dictionaries({"properties": st.dictionaries(st.sampled_from("ab"), s, max_size=2), "unevaluatedProperties": st.booleans()}),
        st.fixed_dictionaries({"items": s}),
        st.fixed_dictionaries({"allOf": st.lists(s, min_size=1, max_size=2)}),
        st.fixed_dictionaries({"anyOf": st.lists(s, min_size=1, max_size=2)}),
        st.fixed_dictionaries({"oneOf": st.lists(s, min_size=1, max_size=2)}),
        st.fixed_dictionaries({"not": s}),
    ),
    max_leaves=4,
)
payloads = st.recursive(st.sampled_from([None, True, 1, 2, 2.5, "a", "bc"]), lambda v: st.one_of(st.lists(v, max_size=2), st.dictionaries(st.sampled_from("abc"), v, max_size=3)), max_leaves=5)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(schemas, st.lists(payloads, min_size=3, max_size=6))
def test_random_schemas_agree(spark, schema, values):
    same_errors(spark, schema, values)


def test_recursive_schemas_take_the_machine(spark):
    tree = {"type": "object", "properties": {"v": {"type": "integer"}, "next": {"$ref": "#"}, "down": {"$ref": "#/$defs/d"}}, "$defs": {"d": {"items": {"$ref": "#/$defs/d"}, "type": "array"}}}
    assert Compiled(tree).large and not Compiled(SCHEMA).large
    same_errors(spark, tree, [{"v": 1, "next": {"v": "x", "next": {"v": True}}}, {"down": [[], [[3]]]}, {}])


def test_patterns_end_at_the_end(spark):
    values = ["12", "12\n", "12\r", "٣", "a.b", "a\u2028b", "a b", "a\u00a0b", "[", "x/y", "&&"]
    for pattern in ("^[0-9]+$", r"^\d+$", "^a.b$", r"^a\sb$", r"^[^\sa-z]+$", "^[[]$", r"^x\/y$", "^[a&&b]+$", r"\S$"):
        same_errors(spark, {"pattern": pattern}, values)
    keyed = {"patternProperties": {"^x$": {"type": "string"}}, "additionalProperties": False}
    same_errors(spark, keyed, [{"x": 1}, {"x\n": "a"}, {"x": "a"}])
    assert [bool(violations({"pattern": "^[0-9]+$"}, v)) for v in values[:4]] == [False, True, True, True]


def test_whole_numbers_are_exact(spark):
    large = 2**53
    values = [large - 1, large, large + 1, large + 2, -large - 1, 10**30, 1.5, 6, 7.0, 2.5]
    for schema in ({"const": large + 1}, {"enum": [large + 2, 3]}, {"minimum": large + 1}, {"maximum": large}, {"exclusiveMaximum": large + 1}, {"exclusiveMinimum": -large - 1}, {"multipleOf": 2}, {"multipleOf": 7}, {"multipleOf": 0.5}):
        same_errors(spark, schema, values)
    assert [not violations({"const": large + 1}, v) for v in values[:4]] == [False, False, True, False]
    same_errors(spark, {"uniqueItems": True}, [[large, large + 1], [1, 1.0], [[1], [1.0]], [{"a": 2.50}, {"a": 2.5}], ["1.0", "1.00"], [{"a": "x:1.0,"}, {"a": "x:1,"}], [True, 1], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]])
    same_errors(spark, {"const": {"a": [1, {"b": 2.0}]}}, [{"a": [1.0, {"b": 2}]}, {"a": [1, {"b": 3}]}, {"a": ["1", {"b": 2}]}])


def test_older_drafts(spark):
    seven, four = "http://json-schema.org/draft-07/schema#", "http://json-schema.org/draft-04/schema"
    tuples = {"$schema": seven, "items": [{"type": "string"}, {"type": "integer"}], "additionalItems": False, "dependencies": {"a": ["b"], "c": {"required": ["d"]}}}
    values = [["x", 1], [1, 1], ["x", 1, 2], {"a": 1}, {"a": 1, "b": 1}, {"c": 1}, {"c": 1, "d": 1}]
    same_errors(spark, tuples, values)
    assert [bool(violations(tuples, v)) for v in values] == [False, True, True, True, False, True, False]
    beside = {"$schema": seven, "properties": {"a": {"$ref": "#/definitions/s", "maxLength": 1}}, "definitions": {"s": {"type": "string"}}, "unevaluatedProperties": False}
    same_errors(spark, beside, [{"a": "long"}, {"a": 1}, {"b": 1}])
    assert not violations(beside, {"a": "long", "b": 1})
    assert [bool(violations({"$schema": four, "minimum": 3, "exclusiveMinimum": True, "const": 9}, v)) for v in (3, 4)] == [True, False]
    assert violations({"$schema": "https://json-schema.org/draft/2019-09/schema", "items": [{"type": "null"}]}, [1])
    for schema in ({"items": [{"type": "string"}]}, {"$schema": "https://json-schema.org/draft/2020-12/schema", "properties": {"a": {"items": []}}}):
        with pytest.raises(ResolveError, match="prefixItems"):
            Compiled(schema)


def test_shared_references_are_walked_once():
    chain = {"$defs": {f"d{i}": {"properties": {"a": {"$ref": f"#/$defs/d{i + 1}"}, "b": {"$ref": f"#/$defs/d{i + 1}"}}} for i in range(60)} | {"d60": {"type": "string"}}, "$ref": "#/$defs/d0"}
    found = rules(chain)
    assert not found.loops and found.large and len(found.nodes) < 100


def test_errors_are_worked_out_once(spark):
    rows = spark.createDataFrame([("{}",)], "payload string")
    checked = violation_summary(validate(rows, samples.ORDER, ResolveOptions("response", "read")))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("must have items, at least") == 1


def test_names_of_another_format(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"request": "r", "envelope": "card"}')
    words = Vocabulary.load(tmp_path / "v.json")
    assert words.response == "on_response" and resolve({"properties": {"a": {"r": "omit"}, "b": {"on_request": "omit"}}}, ResolveOptions("request", "create", vocabulary=words)) == {"properties": {"b": {"on_request": "omit"}}}
    docs = Documents(fetch=lambda url: json.dumps({"properties": {"a": {"type": "string", "on_response": "required"}}}), vocabulary=words)
    payload = {"card": {"capabilities": {"com.example.a": [{"version": "2026-01-01", "schema": "https://example.com/s.json"}]}}}
    rows = spark.createDataFrame([(0, json.dumps(payload)), (1, json.dumps({**payload, "a": "x"})), (2, '{"about": {"capabilities": {}}}')], "i int, payload string")
    assert {r.i: r.exit_code for r in validate_by_capabilities(rows, docs, "read").collect()} == {0: 1, 1: 0, 2: 2}


def test_variants_and_strings_and_garbage(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,)], "payload string")
    schema = {"properties": {"a": {"type": "string"}}}
    got = validate(rows, schema, ResolveOptions("response", "read")).collect()
    assert [r.exit_code for r in got] == [1, 2, 2] and got[1].errors[0].keyword == "json"
    as_variant = spark.range(1).select(F.parse_json(F.lit('{"a": 1}')).alias("payload"))
    assert validate(as_variant, schema, ResolveOptions("response", "read")).first().errors[0].path == "/a"


def test_reports(spark):
    rows = spark.createDataFrame([(1, '{"l": [{"q": 1}, {"q": 0}]}'), (2, '{"l": []}')], "id int, payload string")
    checked = validate(rows, {"properties": {"l": {"items": {"properties": {"q": {"minimum": 1}}}}}}, ResolveOptions("response", "read"))
    assert [tuple(r) for r in error_rows(checked, "id").collect()] == [(1, "/l/1/q", "minimum", "must be at least 1")]
    assert [tuple(r) for r in violation_summary(checked).collect()] == [("minimum", "/l/*/q", 1)]
    assert {tuple(r) for r in exit_codes(checked).collect()} == {(0, 1), (1, 1)}
    assert {r.id: r.verdict for r in verdict_json(checked, "id").collect()} == {1: '{"valid":false,"errors":[{"path":"/l/1/q","message":"must be at least 1"}]}', 2: '{"valid":true}'}


def test_validation_plans_have_no_shuffle(spark):
    rows = spark.createDataFrame([("{}",)], "payload string")
    assert "Exchange" not in validate(rows, samples.ORDER, ResolveOptions("response", "read"))._jdf.queryExecution().executedPlan().toString()


def test_self_described_payloads(spark):
    good = {"about": {"capabilities": samples.capabilities("2026-02-01", samples.DISCOUNT)}, "number": "1234", "state": "P", "lines": [{"part": "s", "units": 6}], "discount": 0.1}
    request = {"meta": {"profile": samples.PROFILE}, "order": {"number": "1234"}}
    broken = {"about": {"capabilities": {"com.other.x": [{"version": "2026-01-01", "schema": f"{samples.BASE}/order.json"}]}}}
    cases = [good, {**good, "discount": 0}, request, {"meta": {"profile": samples.PROFILE}}, {"a": 1}, broken, {"meta": {"profile": "https://nowhere.example.com/p"}}]
    def fetch(url):
        if url not in samples.DOCUMENTS:
            raise ResolveError("NetworkError", "down")
        return json.dumps(samples.DOCUMENTS[url])

    docs = Documents(fetch=fetch)
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(9, "{")], "i int, payload string")
    got = {r.i: r for r in validate_by_capabilities(rows, docs, "complete").collect()}
    assert {i: r.exit_code for i, r in got.items()} == {0: 0, 1: 1, 2: 0, 3: 2, 4: 2, 5: 2, 6: 3, 9: 2}
    assert got[1].errors[0].path == "/discount" and got[5].errors[0].keyword == "NamespaceBindingViolation" and got[0].direction == "response"
    validate_self_described(good, docs, "complete")
    with pytest.raises(Invalid):
        validate_self_described({**good, "discount": 0}, docs, "complete")


def test_single_payloads():
    with pytest.raises(Invalid) as e:
        validate_payload({"number": 3}, samples.ORDER, ResolveOptions("response", "read"))
    assert e.value.exit_code == 1 and {v.keyword for v in e.value.violations} == {"required", "type"}


def test_streams(spark, tmp_path):
    rows = [(1, '{"a": 1}', "2026-01-01 00:00:00"), (2, '{"a": "x"}', "2026-01-01 00:01:00"), (3, "{", "2026-01-01 00:02:00")]
    spark.createDataFrame(rows, "id int, payload string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, payload string, t timestamp").parquet(str(tmp_path / "in"))
    checked = validate_stream(stream, {"properties": {"a": {"type": "integer"}}}, ResolveOptions("response", "read"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    split_stream(checked, good, bad, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert [r.id for r in spark.read.parquet(good).collect()] == [1] and sorted(r.id for r in spark.read.parquet(bad).collect()) == [2, 3]
    query = rolling_violations(checked, "t").writeStream.format("memory").queryName("rolling").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.keyword: r.n_errors for r in spark.table("rolling").collect()} == {"type": 1, "json": 1}


def test_small_tables_are_checked_by_all_cores(spark, tmp_path):
    """Orders of a few kB do not come to one task, whatever their bytes: checks take time by rows."""
    line = "1L as l_linenumber, id as l_partkey, 3.0D as l_quantity, 1.5D as l_extendedprice"
    spark.range(400).selectExpr("id as o_orderkey", "'P' as o_orderstatus", "'low' as o_orderpriority", "1.0D as o_totalprice").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(400).selectExpr("id as l_orderkey", *line.split(", ")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    checked = validate(samples.orders(spark, str(tmp_path)), samples.ORDER, ResolveOptions("response", "read"))
    tasks = checked.select(F.spark_partition_id().alias("p"), F.size("errors").alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(r.n for r in tasks) >= 400
