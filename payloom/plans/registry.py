"""Schemas as numbered rules: resources by URI, references looked up, every subschema met once.

A document holds resources: itself, and every subschema with an `$id`, whose URI is joined to that of what it stands in. A
reference is joined to the URI of its resource and leads to one of them, and in it to an anchor or a JSON Pointer, whose parts
may be percent-encoded. A dynamic reference that leads to a dynamic anchor goes on to the outermost resource on the way from
the root that has such an anchor; rules under dynamic references are therefore kept apart by that way.

rules(schema) gives a list of keyword objects in which numbers stand for subschemas, so that a schema which contains itself
is a finite list. Compiler, interpreter and machine all work on it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

from ..model import ResolveError
from .drafts import LISTS, MAPS, ONE, modern
from .wellformed import check

#: Keywords of subschemas that are applied to the same value, and of those applied to its parts.
IN_PLACE = ("$ref", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "dependentSchemas")
BELOW = ("properties", "patternProperties", "additionalProperties", "propertyNames", "prefixItems", "items", "contains", "unevaluatedProperties", "unevaluatedItems")
#: Subschemas that a schema may come to when references are followed, up to which it is one expression.
EXPANDED = 4000
#: Steps into the value up to which a schema that contains itself is written out, and subschemas that it may come to by that.
DEEP, WRITTEN_OUT = 4, 400
#: Keywords whose subschemas only add their errors, in place and below.
ADDING = ("$ref", "allOf", "properties", "patternProperties", "additionalProperties", "prefixItems", "items")


def invalid(message: str, **details: Any) -> ResolveError:
    return ResolveError("InvalidSchema", f"invalid schema: {message}", **details)


def joined(base: str, ref: str) -> str:
    if ref.startswith("#"):
        return urldefrag(base)[0] + ref
    return urljoin(base, ref)


class Registry:
    """Resources and anchors of a document, and of others by their URIs."""

    def __init__(self, root: Any, others: dict[str, Any] | None = None):
        self.resources: dict[str, Any] = {}
        self.anchors: dict[tuple[str, str], Any] = {}
        self.dynamic: dict[tuple[str, str], Any] = {}
        self.base: dict[int, str] = {}
        self.uses_scopes = False
        for uri, document in {**(others or {}), "": root}.items():
            self.resources[uri] = document
            self._index(document, uri)

    def _index(self, schema: Any, base: str) -> None:
        if not isinstance(schema, dict):
            return
        own = schema.get("$id")
        if isinstance(own, str) and own.startswith("#"):  # an anchor, in older drafts
            self.anchors.setdefault((base, own[1:]), schema)
        elif isinstance(own, str):
            base = urldefrag(joined(base, own))[0]
            if base in self.resources and self.resources[base] is not schema and base:
                raise invalid(f"two resources are named {base}", ref=base)
            self.resources[base] = schema
        self.base[id(schema)] = base
        self.uses_scopes |= isinstance(schema.get("$dynamicRef"), str)
        for keyword, into in (("$anchor", (self.anchors,)), ("$dynamicAnchor", (self.anchors, self.dynamic))):
            if isinstance(schema.get(keyword), str):
                for names in into:
                    names.setdefault((base, schema[keyword]), schema)
        for s in below(schema):
            self._index(s, base)

    def find(self, ref: str, base: str) -> tuple[Any, str]:
        """What a reference leads to, and the URI of the resource that it is in."""
        uri, fragment = urldefrag(joined(base, ref))
        fragment = unquote(fragment)
        if uri not in self.resources:
            raise invalid(f"reference {ref} is to {uri}, which is not in the document", ref=ref)
        if not fragment or fragment.startswith("/"):
            found = self._at(self.resources[uri], fragment, uri)
        else:
            found = self.anchors.get((uri, fragment)), uri
        if not isinstance(found[0], (dict, bool)):
            raise invalid(f"reference {ref} points nowhere", ref=ref)
        return found

    def _at(self, value: Any, pointer: str, base: str) -> tuple[Any, str]:
        base = self.base.get(id(value), base)
        for part in pointer.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            if isinstance(value, list) and part.isdigit() and int(part) < len(value):
                value = value[int(part)]
            else:
                value = value.get(part) if isinstance(value, dict) else None
            base = self.base.get(id(value), base)
        if isinstance(value, dict) and id(value) not in self.base:  # under a keyword that is not known
            self._index(value, base)
        return value, base

    def find_dynamic(self, ref: str, base: str, scope: tuple[str, ...]) -> tuple[Any, str]:
        schema, uri = self.find(ref, base)
        name = unquote(urldefrag(ref)[1])
        if isinstance(schema, dict) and schema.get("$dynamicAnchor") == name:
            for outer in scope:
                if (outer, name) in self.dynamic:
                    return self.dynamic[outer, name], outer
        return schema, uri


def below(schema: dict) -> list[Any]:
    """All subschemas that stand in a schema."""
    found = [schema[k] for k in ONE if isinstance(schema.get(k), (dict, bool))]
    found += [s for k in LISTS if isinstance(schema.get(k), list) for s in schema[k]]
    return found + [s for k in MAPS if isinstance(schema.get(k), dict) for s in schema[k].values()]


@dataclass
class Rules:
    """nodes: keywords of each rule, with the numbers of others in place of subschemas; True or False for plain ones. The first is the root."""

    nodes: list[Any] = field(default_factory=list)
    #: Whether a rule leads back to itself.
    loops: bool = False
    #: Rules that there are if each reference is written out; without meaning for loops.
    expanded: int = 0

    @classmethod
    def of(cls, nodes: list[Any]) -> Rules:
        found = cls(nodes)
        if _cycle(found, IN_PLACE):
            raise invalid("a reference leads back to itself without going into the value")
        found.loops = _cycle(found, IN_PLACE + BELOW)
        found.expanded = 0 if found.loops else _expanded(found)
        return found

    @property
    def large(self) -> bool:
        return self.loops or self.expanded > EXPANDED

    @property
    def annotated(self) -> bool:
        """Whether it matters what rules have evaluated."""
        return any(isinstance(n, dict) and ("unevaluatedProperties" in n or "unevaluatedItems" in n) for n in self.nodes)

    @property
    def steps(self) -> int:
        """Rules that may follow on each other in place, at most."""
        longest: dict[int, int] = {}
        for start in range(len(self.nodes)):
            stack = [start]
            while stack:
                todo = [c for c in self.children(stack[-1], IN_PLACE) if c not in longest]
                if todo:
                    stack += todo
                else:
                    at = stack.pop()
                    longest[at] = 1 + max((longest[c] for c in self.children(at, IN_PLACE)), default=0)
        return max(longest.values(), default=1)

    def written_out(self) -> tuple[Rules, int] | None:
        """Rules without loops that say the same of values as deep as the number beside them; None where even flat values would need too many."""
        for depth in range(DEEP, 0, -1):
            found = self._down_to(depth)
            if found.expanded <= WRITTEN_OUT:
                return found, depth
        return None

    def in_rounds(self) -> dict[int, tuple[Rules, Rules]] | None:
        """Rules without loops for the root and for each rule that others lead back to, by their numbers; None where these do more than add errors.

        The first of two leaves out what leads on to such a rule; the second holds only that, with the number of the rule as const.
        """
        back = self._back()
        reaching = self._reaching(back)
        todo, seen = [0, *back], set()
        while todo:
            at = todo.pop()
            if at in seen or not isinstance(self.nodes[at], dict):
                continue
            seen.add(at)
            closed = "unevaluatedProperties" in self.nodes[at] or "unevaluatedItems" in self.nodes[at]
            adding = [k for k in ADDING if not (closed and k in IN_PLACE)]  # what fails has evaluated nothing
            if any(c in reaching for c in self.children(at, tuple(k for k in IN_PLACE + BELOW if k not in adding))):
                return None
            todo += self.children(at, tuple(adding))
        found = {rule: (self._until(rule, back, reaching, False), self._until(rule, back, reaching, True)) for rule in sorted({0} | back)}
        return found if sum(own.expanded + on.expanded for own, on in found.values()) <= EXPANDED else None

    def _back(self) -> set[int]:
        """Rules that others lead back to on the way from the root."""
        found, on_way, done, stack = set(), {0}, set(), [(0, iter(self.children(0)))]
        while stack:
            at, rest = stack[-1]
            for to in rest:
                if to in on_way:
                    found.add(to)
                elif to not in done:
                    on_way.add(to)
                    stack.append((to, iter(self.children(to))))
                    break
            else:
                stack.pop()
                on_way.discard(at)
                done.add(at)
        return found

    def _reaching(self, wanted: set[int]) -> set[int]:
        """Rules that lead to one of those wanted, and these."""
        above: dict[int, list[int]] = {}
        for at in range(len(self.nodes)):
            for c in self.children(at):
                above.setdefault(c, []).append(at)
        found, todo = set(), list(wanted)
        while todo:
            at = todo.pop()
            if at not in found:
                found.add(at)
                todo += above.get(at, ())
        return found

    def _until(self, start: int, back: set[int], reaching: set[int], leading: bool) -> Rules:
        """The rules from start on that end at those of back; of leading ones, only what leads there."""
        numbers, nodes, pending = {start: 0}, [None], [start]

        def number(rule: int) -> int:
            key = -1 - rule if rule in back else rule
            if leading and rule not in reaching:
                key = len(self.nodes)
            if key not in numbers:
                numbers[key] = len(nodes)
                nodes.append({"const": rule} if leading and key < 0 else True if key < 0 or key == len(self.nodes) else None)
                if nodes[-1] is None:
                    pending.append(rule)
            return numbers[key]

        while pending:
            rule = pending.pop()
            node = self.nodes[rule]
            if isinstance(node, dict):
                node = {k: v for k, v in node.items() if not leading or k in ADDING}
                for k in IN_PLACE + BELOW:
                    if k in node:
                        held = node[k]
                        node[k] = number(held) if isinstance(held, int) else {n: number(r) for n, r in held.items()} if isinstance(held, dict) else [number(r) for r in held]
            nodes[numbers[rule]] = node
        return Rules.of(nodes)

    def _down_to(self, depth: int) -> Rules:
        numbers, nodes, pending = {(0, 0): 0}, [None], [(0, 0)]

        def number(rule: int, steps: int) -> int:
            if (rule, steps) not in numbers:
                numbers[rule, steps] = len(nodes)
                nodes.append(None)
                pending.append((rule, steps))
            return numbers[rule, steps]

        while pending:
            rule, steps = pending.pop()
            node = self.nodes[rule]
            if isinstance(node, dict) and steps > depth:
                node = True  # no value is there
            elif isinstance(node, dict):
                node = dict(node)
                for k in IN_PLACE + BELOW:
                    if k in node:
                        held, at = node[k], steps + (k in BELOW)
                        node[k] = number(held, at) if isinstance(held, int) else {n: number(r, at) for n, r in held.items()} if isinstance(held, dict) else [number(r, at) for r in held]
            nodes[numbers[rule, steps]] = node
        return Rules.of(nodes)

    def children(self, number: int, keywords: tuple[str, ...] = IN_PLACE + BELOW) -> list[int]:
        node, found = self.nodes[number], []
        if isinstance(node, dict):
            for k in keywords:
                held = node.get(k, ())
                found += [held] if isinstance(held, int) else held.values() if isinstance(held, dict) else held
        return found


def rules(schema: Any, others: dict[str, Any] | None = None) -> Rules:
    """The rules that a schema of any draft comes to; ResolveError InvalidSchema if it is none."""
    schema = modern(schema)
    check(schema)
    others = {uri: modern(document) for uri, document in (others or {}).items()}
    for document in others.values():
        check(document)
    registry, out, numbers = Registry(schema, others), Rules(), {}
    pending: list[tuple[int, dict, str, tuple[str, ...]]] = []

    def number(s: Any, base: str, scope: tuple[str, ...]) -> int:
        passed = 0
        while isinstance(s, dict) and "$ref" in s and s.keys() <= {"$ref", "title", "description", "$comment", "$defs"}:  # a mere reference is what it leads to
            s, base = registry.find(s["$ref"], registry.base.get(id(s), base))
            passed += 1
            if passed > 1000:
                raise invalid("references lead to each other only")
        if s is True or s == {} or s is False:
            s = s is not False
            key: Any = s
        else:
            base = registry.base.get(id(s), base)
            scope = scope if not registry.uses_scopes or base in scope else (*scope, base)
            key = id(s), scope
        if key not in numbers:
            numbers[key] = len(out.nodes)
            out.nodes.append(s if isinstance(s, bool) else {})
            if not isinstance(s, bool):
                pending.append((numbers[key], s, base, scope))
        return numbers[key]

    number(schema, "", ())
    while pending:
        at, s, base, scope = pending.pop()
        node = {k: v for k, v in s.items() if k not in ("$defs", "definitions", "dependencies", "$ref", "$dynamicRef")}
        refs = [registry.find(s["$ref"], base)] if "$ref" in s else []
        refs += [registry.find_dynamic(s["$dynamicRef"], base, scope)] if "$dynamicRef" in s else []
        if refs:
            node["$ref"] = [number(t, b, scope) for t, b in refs]
        for k, v in list(node.items()):
            if k in ONE and isinstance(v, (dict, bool)):
                node[k] = number(v, base, scope)
            elif k in LISTS and isinstance(v, list):
                node[k] = [number(x, base, scope) for x in v]
            elif k in MAPS and isinstance(v, dict):
                node[k] = {name: number(x, base, scope) for name, x in v.items()}
        out.nodes[at] = node
    return Rules.of(out.nodes)


def _cycle(found: Rules, keywords: tuple[str, ...]) -> bool:
    """Whether rules lead back to themselves by these keywords."""
    state = [0] * len(found.nodes)  # 1: on the way, 2: leads nowhere
    for start in range(len(found.nodes)):
        stack = [(start, iter(found.children(start, keywords)))] if not state[start] else []
        state[start] = state[start] or 1
        while stack:
            at, rest = stack[-1]
            for to in rest:
                if state[to] == 1:
                    return True
                if not state[to]:
                    state[to] = 1
                    stack.append((to, iter(found.children(to, keywords))))
                    break
            else:
                state[at] = 2
                stack.pop()
    return False


def _expanded(found: Rules) -> int:
    sizes: dict[int, int] = {}
    stack = [0]
    while stack:
        at = stack[-1]
        todo = [c for c in found.children(at) if c not in sizes]
        if todo:
            stack += todo
        else:
            sizes[at] = 1 + sum(sizes[c] for c in found.children(at))
            stack.pop()
    return sizes[0]
