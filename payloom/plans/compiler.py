"""Compiles the rules of a JSON Schema into Columns over a variant.

errors(v) is an array of (path, keyword, message), one entry for each way in which the value breaks the schema; the
expressions run in the JVM. Each rule is compiled once for each place it is used at: where unevaluatedProperties or
unevaluatedItems need it, an in-place rule gives its errors and what it has evaluated together, as one struct that all its
users share. A schema that contains itself has no finite expression, and one whose references write out too large should not
be one: Compiled.large is then true, and validation takes the machine instead.
"""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import canonical, count, elements, joined, json_type, keys, let, member, members, number, places, quoted, text
from .drafts import portable
from .registry import ADDING, Rules, rules

ERRORS = "array<struct<path:string,keyword:string,message:string>>"
#: What a rule comes to where others ask for more than its errors.
FOUND = f"struct<errors:{ERRORS},names:array<string>,items:array<int>>"

#: From here on not all integers are doubles.
EXACT = 1 << 53


def pointer_part(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def none() -> Column:
    return F.array().cast(ERRORS)


def no_names() -> Column:
    return F.array().cast("array<string>")


def no_items() -> Column:
    return F.array().cast("array<int>")


def _struct(errors: Column, names: Column, items: Column) -> Column:
    return F.struct(errors.alias("errors"), names.alias("names"), items.alias("items")).cast(FOUND)


def _held(value: Any) -> list[tuple[Any, int]]:
    """Names and numbers of the rules that a keyword holds."""
    return [(None, value)] if isinstance(value, int) else list(value.items()) if isinstance(value, dict) else list(enumerate(value))


def _passing(passed) -> Column:
    return sum((F.when(p, 1).otherwise(0) for p in passed), F.lit(0))


#: What is said of alternatives.
ANY_OF, ONE_OF, NOT = "must fit one of the alternatives at least", "must fit exactly one of the alternatives", "must not fit what is excluded"


def error(path: Column, keyword: str, message: str | Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), (F.lit(message) if isinstance(message, str) else message).alias("message"))).cast(ERRORS)


def unless(holds: Column, path: Column, keyword: str, message: str | Column) -> Column:
    """An error unless it holds; what is NULL holds."""
    return F.when(~holds, error(path, keyword, message)).otherwise(none())


def short(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def is_large(value: Any) -> bool:
    return isinstance(value, int) and EXACT <= abs(value) < 10**38


def whole(v: Column) -> Column:
    """A number without its fraction, exact to 38 digits; NULL beyond."""
    return F.try_variant_get(v, "$", "decimal(38,0)")


def exactly(v: Column, bound: int, holds) -> Column:
    """holds(number, bound) in whole numbers; in doubles for numbers that are too large."""
    return F.coalesce(holds(whole(v), F.lit(Decimal(bound))), holds(number(v), float(bound)))


class Value:
    """A variant, its type and its pointer, as Columns; map and array views are made on demand."""

    def __init__(self, v: Column, kind: Column, path: Column):
        self.v, self.kind, self.path = v, kind, path

    def below(self, name: str) -> Column:
        return F.concat(self.path, F.lit(f"/{pointer_part(name)}"))

    def below_col(self, name: Column) -> Column:
        return F.concat(self.path, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))

    def keys(self) -> Column:
        return F.coalesce(keys(self.v), no_names())

    def indices(self) -> Column:
        return F.coalesce(F.transform(places(self.v), lambda e, i: i), no_items())

    def when(self, kind: str, errors: Column) -> Column:
        return F.when(self.kind == kind, errors).otherwise(none())


class Compiled:
    def __init__(self, schema: Any):
        self.rules, self._silent = rules(schema), {}

    @classmethod
    def of(cls, found: Rules) -> Compiled:
        made = cls.__new__(cls)
        made.rules, made._silent = found, {}
        return made

    @property
    def large(self) -> bool:
        return self.rules.large

    def errors(self, v: Column, path: Column | None = None) -> Column:
        return self._at(0, v, F.lit("") if path is None else path)

    def _plain(self, rule: int) -> bool | None:
        """True or False for a rule that needs no look at the value."""
        node = self.rules.nodes[rule]
        if isinstance(node, bool):
            return node
        if rule not in self._silent:
            checks = node.keys() & (KEYWORDS.keys() | IN_PLACE.keys() | {"unevaluatedProperties", "unevaluatedItems"})
            self._silent[rule] = all(k in ADDING and all(self._plain(c) is True for c in self.rules.children(rule, (k,))) for k in checks)
        return True if self._silent[rule] else None

    # One value.

    def _at(self, rule: int, v: Column, path: Column) -> Column:
        """Binds the value and its type once; pointers are put together only where there is an error."""
        if self._plain(rule) is True:
            return none()
        if self._plain(rule) is False:
            return error(path, "false", "no value is allowed here")
        return let(v, lambda x: self._typed(rule, x, path))

    def _typed(self, rule: int, v: Column, path: Column) -> Column:
        return let(json_type(v), lambda kind: self._errors(rule, Value(v, kind, path)))

    def _if_there(self, rule: int, v: Column, path: Column) -> Column:
        """Nothing for a value that is missing."""
        if self._plain(rule) is False:
            return F.when(v.isNotNull(), error(path, "false", "no value is allowed here")).otherwise(none())
        return let(v, lambda x: F.when(x.isNotNull(), self._typed(rule, x, path)).otherwise(none()))

    def _errors(self, rule: int, x: Value) -> Column:
        if self._plain(rule) is not None:
            return none() if self._plain(rule) else error(x.path, "false", "no value is allowed here")
        node = self.rules.nodes[rule]
        if "unevaluatedProperties" in node or "unevaluatedItems" in node:
            return self._found(rule, x, "unevaluatedProperties" in node, "unevaluatedItems" in node)["errors"]
        found = []
        for keyword, compile_ in (KEYWORDS | IN_PLACE).items():
            if keyword in node:
                made = compile_(self, node, node[keyword], x)
                if made is not None:
                    found.append(made)
        return found[0] if len(found) == 1 else F.concat(*found) if found else none()

    def _passes(self, rule: int, x: Value) -> Column:
        return F.lit(True) if self._plain(rule) is True else count(self._errors(rule, x)) == 0

    # Keywords; each gives errors, or None where there is nothing to check.

    def _type(self, schema, allowed, x):
        allowed = [allowed] if isinstance(allowed, str) else list(allowed)
        plain = [t for t in allowed if t != "integer"]
        holds = x.kind.isin(plain) if plain else F.lit(False)
        if "integer" in allowed and "number" not in allowed:
            holds = holds | ((x.kind == "number") & (number(x.v) % F.lit(1.0) == 0))
        return unless(holds, x.path, "type", f"must be of type {' or '.join(allowed)}")

    def _same(self, value, x) -> Column:
        if isinstance(value, bool):
            return (x.kind == "boolean") & (F.try_variant_get(x.v, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return (x.kind == "number") & (number(x.v) == float(value)) & (exactly(x.v, value, lambda v, b: v == b) if is_large(value) else F.lit(True))
        if isinstance(value, str):
            return (x.kind == "string") & (text(x.v) == value)
        if value is None:
            return x.kind == "null"
        return (x.kind == ("array" if isinstance(value, list) else "object")) & (canonical(x.v) == canonical(F.parse_json(F.lit(json.dumps(value)))))

    def _enum(self, schema, values, x):
        holds = F.lit(False)
        texts = [v for v in values if isinstance(v, str)]
        if texts:
            holds = (x.kind == "string") & text(x.v).isin(texts)
        for value in values:
            if not isinstance(value, str):
                holds = holds | F.coalesce(self._same(value, x), F.lit(False))
        return unless(F.coalesce(holds, F.lit(False)), x.path, "enum", f"must be one of {short(values)}")

    def _const(self, schema, value, x):
        return unless(F.coalesce(self._same(value, x), F.lit(False)), x.path, "const", f"must be {short(value)}")

    def _limit(keyword, words, holds):
        def compile_(self, schema, bound, x):
            kept = exactly(x.v, bound, holds) if is_large(bound) else holds(number(x.v), float(bound))
            return x.when("number", unless(kept, x.path, keyword, f"must be {words} {bound}"))

        return compile_

    def _multiple(self, schema, of, x):
        ratio = number(x.v) / F.lit(float(of))
        near = F.abs(ratio - F.round(ratio)) < 1e-9
        if of == int(of) and abs(of) < EXACT:  # a whole number's multiples are whole, and told exactly
            near = (number(x.v) % F.lit(1.0) == 0) & F.coalesce(whole(x.v) % F.lit(Decimal(int(of))) == 0, near)
        return x.when("number", unless(near, x.path, "multipleOf", f"must be a multiple of {of}"))

    def _count(keyword, kind, size, holds, words):
        def compile_(self, schema, bound, x):
            return x.when(kind, unless(holds(size(x.v), int(bound)), x.path, keyword, f"{words} {bound}"))

        return compile_

    def _pattern(self, schema, pattern, x):
        return x.when("string", unless(text(x.v).rlike(portable(pattern)), x.path, "pattern", f"must match {pattern}"))

    def _required(self, schema, names, x):
        names = [n for n in names if isinstance(n, str)]
        if not names:
            return None
        return x.when("object", F.concat(*(unless(member(x.v, n).isNotNull(), x.path, "required", f"{short(n)} is required") for n in names)))

    def _properties(self, schema, properties, x):
        checks = [self._if_there(s, member(x.v, n), x.below(n)) for n, s in properties.items() if self._plain(s) is not True]
        return x.when("object", F.concat(*checks)) if checks else None

    def _entries(self, x, schema, wanted) -> Column:
        """Errors of the members whose names are wanted."""
        entries = F.filter(F.map_entries(members(x.v)), lambda e: wanted(e["key"]))
        return x.when("object", joined(F.transform(entries, lambda e: self._at(schema, e["value"], x.below_col(e["key"])))))

    def _pattern_properties(self, schema, patterns, x):
        checks = [self._entries(x, s, _matching(p)) for p, s in patterns.items()]
        return F.concat(*checks) if checks else None

    def _property_names(self, schema, names, x):
        held = keys(x.v)
        named = lambda k: F.try_variant_get(F.parse_json(F.to_json(F.array(k))), "$[0]", "variant")  # noqa: E731  the name as a value
        return x.when("object", joined(F.transform(held, lambda k: self._at(names, named(k), x.path))))

    @staticmethod
    def _unknown(schema, key) -> Column:
        """Whether a name is neither among properties nor patternProperties."""
        names, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))
        free = ~key.isin(names) if names else F.lit(True)
        for p in patterns:
            free = free & ~key.rlike(portable(p))
        return free

    def _additional(self, schema, extra, x):
        if self._plain(extra) is True:
            return None
        if self._plain(extra) is False:
            return x.when("object", self._strangers(F.filter(keys(x.v), lambda k: self._unknown(schema, k)), x, "additionalProperties"))
        return self._entries(x, extra, lambda k: self._unknown(schema, k))

    @staticmethod
    def _strangers(names: Column, x: Value, keyword: str) -> Column:
        """One error for all names that are not allowed."""
        return let(names, lambda n: F.when(F.size(n) > 0, error(x.path, keyword, F.concat(F.lit("not allowed: "), F.array_join(n, ", ")))).otherwise(none()))

    def _dependent_required(self, schema, needs, x):
        checks = [
            F.when(member(x.v, name).isNotNull(), F.concat(*(unless(member(x.v, n).isNotNull(), x.path, "dependentRequired", f"{short(n)} is required with {short(name)}") for n in names))).otherwise(none())
            for name, names in needs.items()
            if names
        ]
        return x.when("object", F.concat(*checks)) if checks else None

    def _items(self, schema, items, x):
        if self._plain(items) is True:
            return None
        skip = len(schema.get("prefixItems", ()))
        rest = elements(x.v) if not skip else F.slice(elements(x.v), skip + 1, 1 << 30)
        return x.when("array", joined(F.transform(rest, lambda e, i: self._at(items, e, F.concat(x.path, F.lit("/"), (i + skip).cast("string"))))))

    def _prefix_items(self, schema, prefix, x):
        checks = [self._if_there(s, F.get(elements(x.v), F.lit(i)), x.below(str(i))) for i, s in enumerate(prefix)]
        return x.when("array", F.concat(*checks)) if checks else None

    def _unique(self, schema, unique, x):
        if unique is not True:
            return None
        plain = F.transform(elements(x.v), canonical)
        return x.when("array", let(plain, lambda p: unless(F.size(F.array_distinct(p)) == F.size(p), x.path, "uniqueItems", "must have no item twice")))

    def _contains(self, schema, wanted, x):
        least, most = schema.get("minContains", 1), schema.get("maxContains")
        fit = F.size(F.filter(elements(x.v), lambda e: count(self._at(wanted, e, F.lit(""))) == 0))
        holds = lambda n: (n >= least) & (n <= most if most is not None else F.lit(True))
        return x.when("array", let(fit, lambda n: unless(holds(n), x.path, "contains", f"must contain {least} to {most if most is not None else 'any number of'} fitting items")))

    # Subschemas that are applied to the same value.

    def _refs(self, schema, refs, x):
        return F.concat(*(self._errors(s, x) for s in refs))

    def _all_of(self, schema, branches, x):
        return F.concat(*(self._errors(s, x) for s in branches)) if branches else None

    def _any_of(self, schema, branches, x):
        return unless(_passing(self._passes(s, x) for s in branches) > 0, x.path, "anyOf", ANY_OF)

    def _one_of(self, schema, branches, x):
        return unless(_passing(self._passes(s, x) for s in branches) == 1, x.path, "oneOf", ONE_OF)

    def _not(self, schema, other, x):
        return unless(~self._passes(other, x), x.path, "not", NOT)

    def _if(self, schema, condition, x):
        then, other = (self._errors(schema[k], x) if k in schema else none() for k in ("then", "else"))
        return F.when(self._passes(condition, x), then).otherwise(other)

    def _dependent_schemas(self, schema, needs, x):
        checks = [F.when(member(x.v, name).isNotNull(), self._errors(s, x)).otherwise(none()) for name, s in needs.items()]
        return x.when("object", F.concat(*checks)) if checks else None

    # The same with what has been evaluated: names of members, positions of items.

    def _found(self, rule: int, x: Value, names: bool, items: bool) -> Column:
        """FOUND of a rule; names and items tell what is asked for."""
        node = self.rules.nodes[rule]
        if isinstance(node, bool):
            return _struct(self._errors(rule, x), no_names(), no_items())
        names_too, items_too = names or "unevaluatedProperties" in node, items or "unevaluatedItems" in node
        held = [(k, name, s) for k in IN_PLACE if k in node for name, s in _held(node[k])]
        held += [(k, None, node[k]) for k in ("then", "else") if "if" in node and k in node]

        def put_together(below: Column | None) -> Column:
            at = {(k, name): F.get(below, F.lit(i)) for i, (k, name, _) in enumerate(held)}
            errors = [made for k, compile_ in KEYWORDS.items() if k in node and (made := compile_(self, node, node[k], x)) is not None]
            # which of them count: all that were applied and passed; of if, then and else only two
            counts = {key: F.size(found["errors"]) == 0 for key, found in at.items()}
            there = {key: member(x.v, key[1]).isNotNull() for key in at if key[0] == "dependentSchemas"}
            for key, found in at.items():
                if key[0] in ("$ref", "allOf"):
                    errors.append(found["errors"])
                elif key[0] == "dependentSchemas":
                    errors.append(F.when(there[key], found["errors"]).otherwise(none()))
                    counts[key] = counts[key] & there[key]
                elif key[0] in ("then", "else"):
                    on = F.size(at["if", None]["errors"]) == 0 if key[0] == "then" else F.size(at["if", None]["errors"]) > 0
                    errors.append(F.when(on, found["errors"]).otherwise(none()))
                    counts[key] = counts[key] & on
            for keyword, holds, message in (("anyOf", lambda n: n > 0, ANY_OF), ("oneOf", lambda n: n == 1, ONE_OF)):
                if keyword in node:
                    errors.append(unless(holds(_passing(c for key, c in counts.items() if key[0] == keyword)), x.path, keyword, message))
            if "not" in node:
                errors.append(unless(~counts.pop(("not", None)), x.path, "not", NOT))
            merged = lambda field, empty: [F.when(c, at[key][field]).otherwise(empty) for key, c in counts.items()]
            seen = F.concat(*self._own_names(node, x), *merged("names", no_names()), no_names()) if names_too else no_names()
            places = F.concat(*self._own_items(node, x), *merged("items", no_items()), no_items()) if items_too else no_items()
            for keyword, make in (("unevaluatedProperties", lambda s: self._unevaluated(s, seen, x)), ("unevaluatedItems", lambda s: self._unevaluated_items(s, places, x))):
                if keyword in node and self._plain(node[keyword]) is not True:
                    errors.append(make(node[keyword]))
            return _struct(F.concat(*errors, none()), x.keys() if "unevaluatedProperties" in node else seen, x.indices() if "unevaluatedItems" in node else places)

        if not held:
            return put_together(None)
        return let(F.array(*(self._found(s, x, names_too, items_too) for _, _, s in held)), put_together)

    def _own_names(self, node, x) -> list[Column]:
        """Names that the rule itself speaks of."""
        if "additionalProperties" in node:
            return [x.keys()]
        parts = [F.array(*map(F.lit, node["properties"]))] if node.get("properties") else []
        return parts + [F.filter(x.keys(), _matching(p)) for p in node.get("patternProperties", {})]

    def _own_items(self, node, x) -> list[Column]:
        if "items" in node:
            return [x.indices()]
        parts = [F.filter(x.indices(), lambda i: i < len(node["prefixItems"]))] if "prefixItems" in node else []
        if "contains" in node:
            parts.append(F.filter(x.indices(), lambda i: count(self._at(node["contains"], F.get(elements(x.v), i), F.lit(""))) == 0))
        return parts

    def _unevaluated(self, extra: int, seen: Column, x: Value) -> Column:
        left = F.array_except(x.keys(), seen)
        if self._plain(extra) is False:
            return x.when("object", self._strangers(left, x, "unevaluatedProperties"))
        return let(F.when(x.kind == "object", left), lambda names: F.coalesce(self._entries(x, extra, lambda k: F.array_contains(names, k)), none()))

    def _unevaluated_items(self, extra: int, seen: Column, x: Value) -> Column:
        left = F.array_except(x.indices(), seen)
        if self._plain(extra) is False:
            return x.when("array", let(left, lambda n: F.when(F.size(n) > 0, error(x.path, "unevaluatedItems", F.concat(F.lit("not allowed: "), F.array_join(n.cast("array<string>"), ", ")))).otherwise(none())))
        return x.when("array", joined(F.transform(left, lambda i: self._at(extra, F.get(elements(x.v), i), F.concat(x.path, F.lit("/"), i.cast("string"))))))


#: A value that is still to be held against a rule.
TASK = "struct<v:variant,rule:int,path:string>"


class Leading:
    """Of rules as Rules.in_rounds() gives them second, the values that they lead on to, each with the number of its rule."""

    def __init__(self, found: Rules):
        self.rules = found

    def tasks(self, v: Column, path: Column, rule: int = 0, at: str = "$") -> Column | None:
        """Of the value at the variant path at, which is taken out only where it is needed: that copies all that is within."""
        node = self.rules.nodes[rule]
        if isinstance(node, bool):
            return None
        value = v if at == "$" else F.try_variant_get(v, at, "variant")
        if "const" in node:
            return let(value, lambda y: F.when(y.isNotNull(), F.array(F.struct(y.alias("v"), F.lit(node["const"]).alias("rule"), path.alias("path"))).cast(f"array<{TASK}>")))
        x = Value(value, F.lit(""), path)
        parts = [self.tasks(v, path, c, at) for k in ("$ref", "allOf") for c in node.get(k, ())]
        for n, c in node.get("properties", {}).items():
            if self._leads(c):
                parts.append(self.tasks(v, x.below(n), c, at + quoted(n)) if quoted(n) else let(member(value, n), lambda y: self.tasks(y, x.below(n), c)))
        some = [(c, _matching(p)) for p, c in node.get("patternProperties", {}).items() if self._leads(c)]
        if self._leads(node.get("additionalProperties")):
            some.append((node["additionalProperties"], lambda k: Compiled._unknown(node, k)))
        for c, wanted in some:
            entries = F.filter(F.map_entries(members(value)), lambda e: wanted(e["key"]))
            parts.append(joined(F.transform(entries, lambda e: F.coalesce(self.tasks(e["value"], x.below_col(e["key"]), c), no_tasks()))))
        items = F.try_variant_get(v, at, "array<variant>")
        parts += [let(F.get(items, F.lit(i)), lambda y: self.tasks(y, x.below(str(i)), c)) for i, c in enumerate(node.get("prefixItems", ())) if self._leads(c)]
        if self._leads(node.get("items")):
            skip = len(node.get("prefixItems", ()))
            rest = items if not skip else F.slice(items, skip + 1, 1 << 30)
            parts.append(joined(F.transform(rest, lambda e, i: F.coalesce(self.tasks(e, F.concat(path, F.lit("/"), (i + skip).cast("string")), node["items"]), no_tasks()))))
        parts = [F.coalesce(p, no_tasks()) for p in parts if p is not None]
        return F.concat(*parts) if parts else None

    def _leads(self, rule: int | None) -> bool:
        return rule is not None and not isinstance(self.rules.nodes[rule], bool)


def no_tasks() -> Column:
    return F.array().cast(f"array<{TASK}>")


def errors_in_rounds(v: Column, found: dict[int, tuple[Rules, Rules]], rounds: Column) -> Column:
    """Errors by the rules of Rules.in_rounds(): each round holds the values that the one before led on to against their rules."""

    def told(t: Column) -> Column:
        errors, on = none(), no_tasks()
        for rule, (own, leading) in found.items():
            errors = F.when(t["rule"] == rule, Compiled.of(own).errors(t["v"], t["path"])).otherwise(errors)
            tasks = Leading(leading).tasks(t["v"], t["path"])
            on = on if tasks is None else F.when(t["rule"] == rule, tasks).otherwise(on)
        return F.struct(errors.alias("errors"), on.alias("tasks"))

    def step(acc: Column, _: Column) -> Column:
        made = lambda m: F.struct(F.concat(acc["errors"], F.array(joined(F.transform(m, lambda t: t["errors"])))).alias("errors"), joined(F.transform(m, lambda t: t["tasks"])).alias("tasks"))
        return F.when(F.size(acc["tasks"]) == 0, acc).otherwise(let(F.transform(acc["tasks"], told), made)).cast(kept)

    kept = f"struct<errors:array<{ERRORS}>,tasks:array<{TASK}>>"
    first = F.array(F.struct(v.alias("v"), F.lit(0).alias("rule"), F.lit("").alias("path")))
    begun = F.struct(F.array().cast(f"array<{ERRORS}>").alias("errors"), first.alias("tasks")).cast(kept)
    return joined(F.aggregate(F.sequence(F.lit(1), rounds), begun, step)["errors"])


def _matching(pattern: str):
    return lambda key: key.rlike(portable(pattern))


_C = Compiled
KEYWORDS = {
    "type": _C._type,
    "enum": _C._enum,
    "const": _C._const,
    "minimum": _C._limit("minimum", "at least", lambda v, b: v >= b),
    "maximum": _C._limit("maximum", "at most", lambda v, b: v <= b),
    "exclusiveMinimum": _C._limit("exclusiveMinimum", "more than", lambda v, b: v > b),
    "exclusiveMaximum": _C._limit("exclusiveMaximum", "less than", lambda v, b: v < b),
    "multipleOf": _C._multiple,
    "minLength": _C._count("minLength", "string", lambda v: F.char_length(text(v)), lambda n, b: n >= b, "must have characters, at least"),
    "maxLength": _C._count("maxLength", "string", lambda v: F.char_length(text(v)), lambda n, b: n <= b, "must have characters, at most"),
    "pattern": _C._pattern,
    "required": _C._required,
    "properties": _C._properties,
    "patternProperties": _C._pattern_properties,
    "propertyNames": _C._property_names,
    "additionalProperties": _C._additional,
    "minProperties": _C._count("minProperties", "object", lambda v: F.size(keys(v)), lambda n, b: n >= b, "must have members, at least"),
    "maxProperties": _C._count("maxProperties", "object", lambda v: F.size(keys(v)), lambda n, b: n <= b, "must have members, at most"),
    "dependentRequired": _C._dependent_required,
    "prefixItems": _C._prefix_items,
    "items": _C._items,
    "minItems": _C._count("minItems", "array", lambda v: F.size(places(v)), lambda n, b: n >= b, "must have items, at least"),
    "maxItems": _C._count("maxItems", "array", lambda v: F.size(places(v)), lambda n, b: n <= b, "must have items, at most"),
    "uniqueItems": _C._unique,
    "contains": _C._contains,
}
IN_PLACE = {
    "$ref": _C._refs,
    "allOf": _C._all_of,
    "anyOf": _C._any_of,
    "oneOf": _C._one_of,
    "not": _C._not,
    "if": _C._if,
    "dependentSchemas": _C._dependent_schemas,
}
