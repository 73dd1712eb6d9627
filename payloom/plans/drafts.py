"""Older drafts of JSON Schema in the form of 2020-12, and patterns in a form that two regular expression engines read alike."""

from __future__ import annotations

import re
from typing import Any

try:
    import regex
except ImportError:  # then patterns with \p{...} are not known here, only in the JVM
    regex = re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

from ..model import ResolveError

#: Keywords that hold schemas: one, a list of them, or a map.
ONE = ("items", "additionalItems", "additionalProperties", "unevaluatedProperties", "unevaluatedItems", "contains", "propertyNames", "not", "if", "then", "else")
LISTS, MAPS = ("allOf", "anyOf", "oneOf", "prefixItems", "items"), ("properties", "patternProperties", "dependentSchemas", "dependencies", "$defs", "definitions")
# Keywords that a draft does not know yet, by the draft that brought them.
SINCE = {
    6: ("const", "contains", "propertyNames"),
    7: ("if", "then", "else"),
    2019: ("unevaluatedProperties", "unevaluatedItems", "dependentRequired", "dependentSchemas", "minContains", "maxContains", "$anchor"),
    2020: ("prefixItems", "$dynamicRef", "$dynamicAnchor"),
}


def draft(schema: Any) -> int:
    """4, 6, 7, 2019 or 2020, by $schema; 2020 where it says nothing that is known."""
    said = schema.get("$schema") if isinstance(schema, dict) else None
    m = re.search(r"json-schema\.org/(?:draft-0([467])/|draft/(2019|2020)-)", said) if isinstance(said, str) else None
    return int(m[1] or m[2]) if m else 2020


def modern(schema: Any) -> Any:
    """The schema with the meaning that its draft gives it, in keywords of 2020-12."""
    of = draft(schema)
    return _modern(schema, of)


def _modern(schema: Any, of: int) -> Any:
    if not isinstance(schema, dict):
        return schema
    own = schema.get("$id", schema.get("id") if of == 4 else None)
    if isinstance(own, str) and isinstance(schema.get("$schema"), str):  # a resource may have a draft of its own
        of = draft(schema)
    if of >= 2020 and isinstance(schema.get("items"), list):
        raise ResolveError("InvalidSchema", "invalid schema: items is a list, which 2020-12 calls prefixItems")
    unknown = {k for since, keys in SINCE.items() if since > of for k in keys}
    out = {k: v for k, v in schema.items() if k not in unknown}
    if of == 4 and isinstance(own, str):
        out["$id"] = out.pop("id", own)
    for k in ONE:
        if isinstance(out.get(k), dict):
            out[k] = _modern(out[k], of)
    for k in LISTS:
        if isinstance(out.get(k), list):
            out[k] = [_modern(v, of) for v in out[k]]
    for k in MAPS:
        if isinstance(out.get(k), dict):
            out[k] = {name: _modern(v, of) for name, v in out[k].items()}
    if of >= 2020:
        return out
    if isinstance(out.get("items"), list):
        prefix = out.pop("items")
        rest = out.pop("additionalItems", None)
        out = {**out, "prefixItems": prefix, **({"items": rest} if rest is not None else {})}
    out.pop("additionalItems", None)
    if of == 2019:
        if isinstance(out.get("$recursiveRef"), str):
            out.setdefault("$ref", out.pop("$recursiveRef"))
        return out
    if isinstance(out.get("$ref"), str):  # what stands beside a reference does not count
        return {k: v for k, v in out.items() if k in ("$schema", "$ref", "$defs", "definitions")}
    needs = out.pop("dependencies", None)
    if isinstance(needs, dict):
        names = {k: v for k, v in needs.items() if isinstance(v, list)}
        out |= {"dependentRequired": names} if names else {}
        schemas = {k: v for k, v in needs.items() if not isinstance(v, list)}
        out |= {"dependentSchemas": schemas} if schemas else {}
    if of == 4:
        for plain, exclusive in (("minimum", "exclusiveMinimum"), ("maximum", "exclusiveMaximum")):
            if out.get(exclusive) is True and plain in out:
                out[exclusive] = out.pop(plain)
            elif isinstance(out.get(exclusive), bool):
                out.pop(exclusive)
    return out


_SPACE = r"\t\n\x0b\f\r    -     　﻿"


#: Classes as ECMA 262 has them: digits and letters are ASCII, spaces are not.
_CLASSES = {"s": _SPACE, "d": "0-9", "w": "A-Za-z0-9_"}


def portable(pattern: str) -> str:
    """A pattern with the meaning of ECMA 262: $ is the end alone, a dot stops at four line ends, \\s has all spaces, [ in a set is itself."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n in _CLASSES:
                out.append(_CLASSES[n] if inside else f"[{_CLASSES[n]}]")
            else:
                out.append(f"[^{_CLASSES[n.lower()]}]" if n in "SDW" and not inside else c + n)
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
        else:
            out.append(r"(?![\s\S])" if c == "$" else r"[^\n\r  ]" if c == "." else c)
        i += 1
    return "".join(out)


def compiled(pattern: str) -> Any:
    return regex.compile(portable(pattern))


def fault_of_pattern(pattern: str) -> str | None:
    """What is wrong about a pattern, as both engines see it."""
    try:
        compiled(pattern)
    except (re.error, regex.error) as e:
        return f"{pattern} is no pattern: {e}"
    return None if readable(portable(pattern)) else f"{pattern} is no pattern"


def readable(portable_pattern: str) -> bool:
    """Whether the JVM reads a pattern, if there is one to ask: in tasks there is none."""
    session = SparkSession.getActiveSession()
    if session is None:
        return True
    try:
        session._jvm.java.util.regex.Pattern.compile(portable_pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True
