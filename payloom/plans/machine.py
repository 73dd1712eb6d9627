"""Rules as data: one expression of constant size that holds payloads against whichever rules stand beside them.

A payload's row carries its rules as an array of structs. The machine goes down first: level by level, the values still to be
looked at, each with the number of a rule, give the next ones, in place and below; then up again: what a rule says of its value is
put together from what was found below it. Both are folds over arrays, so all of it runs in the JVM, in the row, without a
shuffle or a Python worker. A schema that contains itself needs no more than its finite list of rules, and payloads with
different rules share the plan.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import canonical, elements, joined, json_type, keys, let, members, number, places, starts, text
from .compiler import ANY_OF, ERRORS, NOT, ONE_OF, error, is_large, no_items, no_names, none, short, whole
from .drafts import portable
from .registry import Rules

_BOUND = "struct<near:double,exact:decimal(38,0),text:string>"
_LIMITS = {"minimum": ("at least", lambda v, b: v >= b), "maximum": ("at most", lambda v, b: v <= b), "exclusiveMinimum": ("more than", lambda v, b: v > b), "exclusiveMaximum": ("less than", lambda v, b: v < b)}
_COUNTS = {
    "minLength": ("string", "characters, at least", lambda n, b: n >= b), "maxLength": ("string", "characters, at most", lambda n, b: n <= b),
    "minItems": ("array", "items, at least", lambda n, b: n >= b), "maxItems": ("array", "items, at most", lambda n, b: n <= b),
    "minProperties": ("object", "members, at least", lambda n, b: n >= b), "maxProperties": ("object", "members, at most", lambda n, b: n <= b),
}
#: A rule; what it does not have is NULL.
RULE = (
    "struct<plain:boolean,types:array<string>,integer:boolean,texts:array<string>,enum:array<string>,enum_text:string,const:string,const_text:string,"
    + ",".join(f"{k}:{_BOUND}" for k in (*_LIMITS, "multipleOf"))
    + ","
    + ",".join(f"{k}:long" for k in _COUNTS)
    + ",pattern:string,pattern_text:string,required:array<struct<name:string,text:string>>,needs:array<struct<name:string,needed:string,text:string>>,unique:boolean,"
    "properties:map<string,int>,patterns:array<struct<pattern:string,rule:int>>,additional:int,no_additional:boolean,names:int,prefix:array<int>,items:int,contains:int,min_contains:long,max_contains:long,"
    "left_names:int,no_left_names:boolean,left_items:int,no_left_items:boolean,every:array<int>,any:array<int>,one:array<int>,not:int,if:int,then:int,else:int,dependents:map<string,int>>"
)
RULES = f"array<{RULE}>"
TASK = "struct<v:variant,kind:string,rule:int,path:string,op:string,key:string>"
_LEVEL = "array<struct<v:variant,kind:string,rule:int,path:string,op:string,key:string,start:int,below:int>>"
RESULT = f"struct<op:string,key:string,errors:{ERRORS},names:array<string>,items:array<int>>"


# Rules to rows.


def rows(found: Rules) -> list[dict]:
    """The rules as JSON values of the type RULES."""
    return [_row(found, node) for node in found.nodes]


def _row(found: Rules, node: Any) -> dict:
    if isinstance(node, bool):
        return {"plain": node}
    out: dict[str, Any] = {}
    if "type" in node:
        types = [node["type"]] if isinstance(node["type"], str) else node["type"]
        out |= {"types": types, "integer": "integer" in types and "number" not in types}
    if "enum" in node:
        plain = all(isinstance(v, str) for v in node["enum"])
        out |= {"texts" if plain else "enum": node["enum"] if plain else [json.dumps(v) for v in node["enum"]], "enum_text": short(node["enum"])}
    if "const" in node:
        out |= {"const": json.dumps(node["const"]), "const_text": short(node["const"])}
    for k in (*_LIMITS, "multipleOf"):
        if k in node:
            exact = node[k] == int(node[k]) and (abs(node[k]) < 1 << 53 if k == "multipleOf" else is_large(node[k]))
            out[k] = {"near": float(node[k]), "exact": int(node[k]) if exact else None, "text": str(node[k])}
    out |= {k: int(node[k]) for k in _COUNTS if k in node}
    if "pattern" in node:
        out |= {"pattern": portable(node["pattern"]), "pattern_text": node["pattern"]}
    if "required" in node:
        out["required"] = [{"name": n, "text": f"{short(n)} is required"} for n in node["required"]]
    if "dependentRequired" in node:
        out["needs"] = [{"name": n, "needed": m, "text": f"{short(m)} is required with {short(n)}"} for n, names in node["dependentRequired"].items() for m in names]
    out |= {"unique": True} if node.get("uniqueItems") else {}
    if "patternProperties" in node:
        out["patterns"] = [{"pattern": portable(p), "rule": r} for p, r in node["patternProperties"].items()]
    for name, k in (("additional", "additionalProperties"), ("left_names", "unevaluatedProperties"), ("left_items", "unevaluatedItems")):
        if k in node:
            out |= {name: node[k], f"no_{name}": found.nodes[node[k]] is False}
    same = {"properties": "properties", "names": "propertyNames", "prefix": "prefixItems", "items": "items", "contains": "contains", "min_contains": "minContains", "max_contains": "maxContains", "any": "anyOf", "one": "oneOf", "not": "not", "if": "if", "dependents": "dependentSchemas"}
    out |= {name: node[k] for name, k in same.items() if k in node}
    if "if" in node:
        out |= {k: node[k] for k in ("then", "else") if k in node}
    every = [*node.get("$ref", ()), *node.get("allOf", ())]
    return out | ({"every": every} if every else {})


def constant(found: Rules) -> Column:
    """The rules as one column for all rows."""
    return F.from_json(F.lit(json.dumps(rows(found))), RULES)


# Down.


def _task(v: Column, kind: Column, rule: Column, path: Column, op: str, key: Column | None = None) -> Column:
    return F.struct(v.alias("v"), kind.alias("kind"), rule.alias("rule"), path.alias("path"), F.lit(op).alias("op"), (F.lit("") if key is None else key).alias("key"))


def _tasks() -> Column:
    return F.array().cast(f"array<{TASK}>")


def _each(numbers: Column, task) -> Column:
    return F.coalesce(F.transform(numbers, task), _tasks())


def _if_any(rule: Column, task: Column) -> Column:
    return F.when(rule.isNotNull(), F.array(task)).otherwise(_tasks())


def _part(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _free(r: Column, name: Column) -> Column:
    """Whether a name is neither among properties nor patternProperties."""
    listed = F.coalesce(F.map_contains_key(r["properties"], name), F.lit(False))
    return ~listed & ~F.coalesce(F.exists(r["patterns"], lambda p: F.rlike(name, p["pattern"])), F.lit(False))


def _for(op: str, task):
    return lambda rule: task(rule, op)


def _below(o: Column, r: Column) -> Column:
    """What a rule asks for next, in place and below."""
    here = lambda rule, op: _task(o["v"], o["kind"], rule, o["path"], op)
    in_place = [_each(r[op], _for(op, here)) for op in ("every", "any", "one")]
    in_place += [_if_any(r[op], here(r[op], op)) for op in ("not", "if", "then", "else")]
    held = members(o["v"])
    in_place.append(_each(F.filter(F.map_entries(r["dependents"]), lambda e: F.coalesce(F.map_contains_key(held, e["key"]), F.lit(False))), lambda e: here(e["value"], "every")))

    def member_tasks(e: Column) -> Column:
        at, name = _part(o["path"], e["key"]), e["key"]
        down = lambda rule, op: _task(e["value"], json_type(e["value"]), rule, at, op, name)
        named = F.try_element_at(r["properties"], name)
        as_value = F.try_variant_get(F.try_parse_json(F.to_json(F.array(name))), "$[0]", "variant")
        extra = F.when(r["additional"].isNotNull() & ~r["no_additional"] & _free(r, name), r["additional"])
        left = F.when(~r["no_left_names"], r["left_names"])
        return F.concat(
            _if_any(named, down(named, "down")),
            _each(F.filter(r["patterns"], lambda p: F.rlike(name, p["pattern"])), lambda p: down(p["rule"], "down")),
            _if_any(extra, down(extra, "down")),
            _if_any(r["names"], _task(as_value, F.lit("string"), r["names"], o["path"], "down")),
            _if_any(left, down(left, "left")),
        )

    def item_tasks(v: Column, i: Column) -> Column:
        at, n = F.concat(o["path"], F.lit("/"), i.cast("string")), F.coalesce(F.size(r["prefix"]), F.lit(0))
        down = lambda rule, op: _task(v, json_type(v), rule, at, op, i.cast("string"))
        n = F.when(r["prefix"].isNull(), 0).otherwise(n)
        own = F.when(i < n, F.get(r["prefix"], i)).otherwise(r["items"])
        left = F.when(~r["no_left_items"], r["left_items"])
        return F.concat(_if_any(own, down(own, "down")), _if_any(r["contains"], down(r["contains"], "contains")), _if_any(left, down(left, "left")))

    objects = F.when(o["kind"] == "object", joined(F.transform(F.map_entries(held), member_tasks)))
    arrays = F.when(o["kind"] == "array", joined(F.transform(elements(o["v"]), item_tasks)))
    return F.concat(*in_place, F.coalesce(objects, arrays, _tasks()))


def _levels(v: Column, rules: Column, rounds: Column) -> Column:
    """All tasks by levels; each knows where in the next level those that it asked for stand."""
    first = F.array(_task(v, json_type(v), F.lit(0), F.lit(""), "every")).cast(f"array<{TASK}>")
    begun = F.struct(F.array().cast(f"array<{_LEVEL}>").alias("levels"), first.alias("last"))

    def step(acc: Column, _: Column) -> Column:
        def placed(next_: Column) -> Column:
            at = starts(F.transform(next_, F.size))
            level = let(at, lambda s: F.transform(acc["last"], lambda o, j: F.struct(*(o[k].alias(k) for k in ("v", "kind", "rule", "path", "op", "key")), F.get(s, j).alias("start"), F.size(F.get(next_, j)).alias("below"))))
            return F.struct(F.concat(acc["levels"], F.array(level.cast(_LEVEL))).alias("levels"), joined(next_).cast(f"array<{TASK}>").alias("last"))

        return F.when(F.size(acc["last"]) == 0, acc).otherwise(let(F.transform(acc["last"], lambda o: let(F.get(rules, o["rule"]), lambda r: _below(o, r))), placed))

    return F.aggregate(F.sequence(F.lit(1), rounds), begun, step)["levels"]


def depth(v: Column) -> Column:
    """How deep a value's brackets go."""
    marks = F.regexp_extract_all(F.to_json(v), F.lit(r'"(?:[^"\\]|\\.)*+"|[\[{\]}]'), F.lit(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def turn(acc: Column, m: Column) -> Column:
        now = acc["now"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, zero, turn)["most"]


# Up.


def _unless(holds: Column, o: Column, keyword: str, message: Column | str) -> Column:
    return F.when(~holds, error(o["path"], keyword, message)).otherwise(none())


def _own(o: Column, r: Column) -> Column:
    """Errors of what a rule says of the value itself."""
    v, kind = o["v"], o["kind"]
    is_ = lambda k: kind == k
    typed = F.array_contains(r["types"], kind) | (r["integer"] & is_("number") & (number(v) % F.lit(1.0) == 0))
    listed = F.when(r["texts"].isNotNull(), is_("string") & F.array_contains(r["texts"], text(v))).when(r["enum"].isNotNull(), let(canonical(v), lambda c: F.exists(r["enum"], lambda e: canonical(F.try_parse_json(e)) == c)))
    checks = [
        F.when(r["plain"] == F.lit(False), error(o["path"], "false", "no value is allowed here")).otherwise(none()),
        _unless(r["types"].isNull() | F.coalesce(typed, F.lit(False)), o, "type", F.concat(F.lit("must be of type "), F.array_join(r["types"], " or "))),
        F.when(r["enum_text"].isNotNull(), _unless(F.coalesce(listed, F.lit(False)), o, "enum", F.concat(F.lit("must be one of "), r["enum_text"]))).otherwise(none()),
        F.when(r["const"].isNotNull(), _unless(canonical(v) == canonical(F.try_parse_json(r["const"])), o, "const", F.concat(F.lit("must be "), r["const_text"]))).otherwise(none()),
    ]
    for k, (words, holds) in _LIMITS.items():
        kept = F.coalesce(holds(whole(v), r[k]["exact"]), holds(number(v), r[k]["near"]))
        checks.append(F.when(is_("number") & r[k].isNotNull(), _unless(kept, o, k, F.concat(F.lit(f"must be {words} "), r[k]["text"]))).otherwise(none()))
    of = r["multipleOf"]
    ratio = number(v) / of["near"]
    near = F.abs(ratio - F.round(ratio)) < 1e-9
    near = F.when(of["exact"].isNotNull(), (number(v) % F.lit(1.0) == 0) & F.coalesce(whole(v) % of["exact"] == 0, near)).otherwise(near)
    checks.append(F.when(is_("number") & of.isNotNull(), _unless(near, o, "multipleOf", F.concat(F.lit("must be a multiple of "), of["text"]))).otherwise(none()))
    sizes = {"string": F.char_length(text(v)), "array": F.size(places(v)), "object": F.size(keys(v))}
    for k, (what, words, holds) in _COUNTS.items():
        checks.append(F.when(is_(what) & r[k].isNotNull(), _unless(holds(sizes[what], r[k]), o, k, F.concat(F.lit(f"must have {words} "), r[k].cast("string")))).otherwise(none()))
    checks.append(F.when(is_("string") & r["pattern"].isNotNull(), _unless(F.rlike(text(v), r["pattern"]), o, "pattern", F.concat(F.lit("must match "), r["pattern_text"]))).otherwise(none()))

    def of_object(held: Column) -> Column:
        missing = F.filter(r["required"], lambda n: ~F.map_contains_key(held, n["name"]))
        without = F.filter(r["needs"], lambda n: F.map_contains_key(held, n["name"]) & ~F.map_contains_key(held, n["needed"]))
        stranger = F.when(r["no_additional"], _strangers(F.filter(F.map_keys(held), lambda k: _free(r, k)), o, "additionalProperties"))
        told = lambda faults, keyword: F.coalesce(joined(F.transform(faults, lambda n: error(o["path"], keyword, n["text"]))), none())
        return F.concat(told(missing, "required"), F.coalesce(stranger, none()), told(without, "dependentRequired"))

    checks.append(F.when(is_("object"), let(members(v), of_object)).otherwise(none()))
    twice = let(F.transform(elements(v), canonical), lambda p: _unless(F.size(F.array_distinct(p)) == F.size(p), o, "uniqueItems", "must have no item twice"))
    checks.append(F.when(is_("array") & r["unique"], twice).otherwise(none()))
    return F.concat(*checks)


def _strangers(names: Column, o: Column, keyword: str) -> Column:
    return let(names, lambda n: F.when(F.size(n) > 0, error(o["path"], keyword, F.concat(F.lit("not allowed: "), F.array_join(n.cast("array<string>"), ", ")))).otherwise(none()))


def _passed(c: Column) -> Column:
    return F.size(c["errors"]) == 0


def _result(o: Column, r: Column, found: Column, annotated: bool) -> Column:
    """RESULT of a task, from those of the tasks that it asked for."""
    of = lambda *ops: F.filter(found, lambda c: c["op"].isin(*ops))
    count = lambda op: F.size(F.filter(found, lambda c: (c["op"] == op) & _passed(c)))
    errors = lambda *ops: joined(F.transform(of(*ops), lambda c: c["errors"]))
    holds = F.exists(found, lambda c: (c["op"] == "if") & _passed(c))
    most = F.coalesce(r["max_contains"].cast("string"), F.lit("any number of"))
    least = F.coalesce(r["min_contains"], F.lit(1))
    fitting = (count("contains") >= least) & F.coalesce(count("contains") <= r["max_contains"], F.lit(True))
    made = [
        _own(o, r),
        errors("every", "down"),
        F.when(r["any"].isNotNull(), _unless(count("any") > 0, o, "anyOf", ANY_OF)).otherwise(none()),
        F.when(r["one"].isNotNull(), _unless(count("one") == 1, o, "oneOf", ONE_OF)).otherwise(none()),
        F.when(r["not"].isNotNull(), _unless(count("not") == 0, o, "not", NOT)).otherwise(none()),
        F.when(r["if"].isNotNull(), F.when(holds, errors("then")).otherwise(errors("else"))).otherwise(none()),
        F.when(r["contains"].isNotNull() & (o["kind"] == "array"), _unless(fitting, o, "contains", F.concat(F.lit("must contain "), least.cast("string"), F.lit(" to "), most, F.lit(" fitting items")))).otherwise(none()),
    ]
    if not annotated:
        return F.struct(o["op"].alias("op"), o["key"].alias("key"), F.concat(*made).alias("errors"), no_names().alias("names"), no_items().alias("items"))

    applied = F.filter(found, lambda c: _passed(c) & (c["op"].isin("every", "any", "one", "if") | (c["op"] == F.when(holds, "then").otherwise("else"))))
    names, spots = F.when(o["kind"] == "object", keys(o["v"])), F.when(o["kind"] == "array", F.transform(places(o["v"]), lambda e, i: i))
    prefix = F.when(r["prefix"].isNull(), 0).otherwise(F.size(r["prefix"]))
    contained = F.transform(F.filter(found, lambda c: (c["op"] == "contains") & _passed(c)), lambda c: c["key"].try_cast("int"))
    seen = F.when(r["additional"].isNotNull(), names).otherwise(F.concat(F.filter(names, lambda k: ~_free(r, k)), joined(F.transform(applied, lambda c: c["names"]))))
    done = F.when(r["items"].isNotNull(), spots).otherwise(F.concat(F.filter(spots, lambda i: i < prefix), contained, joined(F.transform(applied, lambda c: c["items"]))))
    seen, done = F.coalesce(seen, no_names()), F.coalesce(done, no_items())

    def put_together(s: Column) -> Column:
        left = F.filter(found, lambda c: (c["op"] == "left") & F.when(o["kind"] == "object", ~F.array_contains(s["names"], c["key"])).otherwise(~F.array_contains(s["items"], c["key"].try_cast("int"))))
        strange = F.when(r["no_left_names"] & names.isNotNull(), _strangers(F.array_except(names, s["names"]), o, "unevaluatedProperties")).when(r["no_left_items"] & spots.isNotNull(), _strangers(F.array_except(spots, s["items"]), o, "unevaluatedItems"))
        every = F.concat(*made, joined(F.transform(left, lambda c: c["errors"])), F.coalesce(strange, none()))
        return F.struct(o["op"].alias("op"), o["key"].alias("key"), every.alias("errors"), F.when(r["left_names"].isNotNull() & names.isNotNull(), names).otherwise(s["names"]).alias("names"), F.when(r["left_items"].isNotNull() & spots.isNotNull(), spots).otherwise(s["items"]).alias("items"))

    return let(F.struct(seen.alias("names"), done.alias("items")), put_together)


def errors(v: Column, rules: Column, steps: int | Column, annotated: bool = True) -> Column:
    """Errors of a value by the rules of type RULES beside it, of which the first is the root. steps: how many rules follow on each other in place."""
    rounds = (depth(v) + 1) * F.lit(steps) if isinstance(steps, int) else (depth(v) + 1) * steps
    nothing = F.array().cast(f"array<{RESULT}>")

    done = let(rules, lambda known: F.aggregate(F.reverse(_levels(v, known, rounds)), nothing, lambda below, level: _up(below, level, known, annotated)))
    return F.get(done, F.lit(0))["errors"]


def _up(below: Column, level: Column, rules: Column, annotated: bool) -> Column:
    found = lambda o: F.slice(below, o["start"] + 1, o["below"])
    return F.transform(level, lambda o: let(F.get(rules, o["rule"]), lambda r: let(found(o), lambda c: _result(o, r, c, annotated)))).cast(f"array<{RESULT}>")
