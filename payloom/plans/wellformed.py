"""Whether a schema is one: each keyword has the kind of value that its draft asks for. Checked before anything is compiled."""

from __future__ import annotations

from typing import Any

from ..model import ResolveError
from .drafts import LISTS, MAPS, ONE, fault_of_pattern

#: Fixed values of JSON Schema.
TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")
NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
TEXTS = ("$id", "$schema", "$ref", "$dynamicRef", "$anchor", "$dynamicAnchor", "$comment", "title", "description", "format", "pattern")


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def is_names(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value) and len(set(value)) == len(value)


def check(schema: Any) -> None:
    """Raises ResolveError InvalidSchema, with the pointer of the first fault."""
    pending = [(schema, "")]
    while pending:
        here, path = pending.pop()
        if isinstance(here, bool):
            continue
        if not isinstance(here, dict):
            raise _fault(path, "a schema is an object, true or false")
        for keyword, value in here.items():
            said = _wrong(keyword, value)
            if said:
                raise _fault(f"{path}/{keyword}", said)
            if keyword in LISTS and isinstance(value, list):
                pending += [(x, f"{path}/{keyword}/{i}") for i, x in enumerate(value)]
            elif keyword in MAPS:
                pending += [(x, f"{path}/{keyword}/{name}") for name, x in value.items() if keyword != "dependencies" or not isinstance(x, list)]
            elif keyword in ONE:
                pending.append((value, f"{path}/{keyword}"))


def _fault(path: str, said: str) -> ResolveError:
    return ResolveError("InvalidSchema", f"invalid schema: {path or 'the root'}: {said}", path=path)


def _wrong(keyword: str, value: Any) -> str | None:
    """What is wrong about a keyword's own value, apart from subschemas."""
    if keyword == "type":
        if value not in TYPES if isinstance(value, str) else not (is_names(value) and value and all(t in TYPES for t in value)):
            return f"a type is one or several of {', '.join(TYPES)}"
    elif keyword in COUNTS:
        if not is_number(value) or value < 0 or value != int(value):
            return "must be a whole number, 0 or more"
    elif keyword in NUMBERS:
        if not is_number(value):
            return "must be a number"
    elif keyword == "multipleOf":
        if not is_number(value) or value <= 0:
            return "must be a number above 0"
    elif keyword in TEXTS:
        if not isinstance(value, str):
            return "must be a string"
        if keyword == "pattern":
            return fault_of_pattern(value)
    elif keyword == "required":
        if not is_names(value):
            return "must be a list of different names"
    elif keyword == "enum":
        if not isinstance(value, list):
            return "must be a list"
    elif keyword == "uniqueItems":
        if not isinstance(value, bool):
            return "must be true or false"
    elif keyword == "dependentRequired":
        if not isinstance(value, dict) or not all(map(is_names, value.values())):
            return "must have a list of different names for each name"
    elif keyword in MAPS:
        if not isinstance(value, dict):
            return "must have a schema for each name"
        if keyword == "patternProperties":
            return next(filter(None, map(fault_of_pattern, value)), None)
    elif keyword in LISTS and keyword not in ONE and not (isinstance(value, list) and (value or keyword == "prefixItems")):
        return "must be a list of schemas"
    return None
