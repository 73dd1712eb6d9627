"""Options, fixed names and errors."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# Fixed values of the document format.
VISIBILITIES = ("omit", "required", "optional")
OPERATIONS = ("create", "update", "complete", "read")

INCLUDE = "include"

#: What a run ends with.
OK, INVALID, BAD_SCHEMA, BAD_IO = 0, 1, 2, 3

VERSION = re.compile(r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])")


class PayloomError(Exception):
    """kind names the failure; details are its parts."""

    exit_code = BAD_SCHEMA
    io_kinds: frozenset[str] = frozenset()

    def __init__(self, kind: str, message: str, **details: Any):
        super().__init__(message)
        self.kind, self.message, self.details = kind, message, details
        if kind in self.io_kinds:
            self.exit_code = BAD_IO


class ComposeError(PayloomError):
    io_kinds = frozenset({"SchemaFetch", "ProfileFetch"})


class ResolveError(PayloomError):
    io_kinds = frozenset({"FileNotFound", "ReadError", "NetworkError"})


class BindingError(PayloomError):
    pass


@dataclass(frozen=True)
class Violation:
    """One way in which a payload breaks its schema."""

    path: str
    keyword: str
    message: str


class Invalid(PayloomError):
    """A payload that breaks its schema; violations holds all the ways."""

    exit_code = INVALID

    def __init__(self, violations: list[Violation]):
        super().__init__("Invalid", f"validation failed with {len(violations)} error(s)")
        self.violations = violations


@dataclass(frozen=True)
class Vocabulary:
    """The keys that a family of documents gives to annotations, to its envelope and to transitions in resolved schemas."""

    request: str = "on_request"
    response: str = "on_response"
    envelope: str = "about"
    transition: str = "x-transition"

    @property
    def annotations(self) -> tuple[str, str]:
        return self.request, self.response

    @classmethod
    def load(cls, path: str | Path) -> Vocabulary:
        """From a JSON object with any of the four names."""
        try:
            return cls(**json.loads(Path(path).read_text("utf-8")))
        except (OSError, ValueError, TypeError) as e:
            raise ResolveError("ReadError", f"cannot read the vocabulary {path}: {e}", path=str(path)) from e


DEFAULT = Vocabulary()


@dataclass(frozen=True)
class ResolveOptions:
    direction: str
    operation: str
    strict: bool = False
    include_future: bool = False
    def_name: str | None = None
    vocabulary: Vocabulary = DEFAULT

    def __post_init__(self):
        if self.direction not in ("request", "response"):
            raise ValueError(f"direction must be request or response, not {self.direction!r}")
        object.__setattr__(self, "operation", self.operation.lower())

    @property
    def annotation(self) -> str:
        return self.vocabulary.request if self.direction == "request" else self.vocabulary.response

    @property
    def shape_key(self) -> str:
        return f"{self.operation}_{self.direction}"


@dataclass(frozen=True)
class Transition:
    source: str
    target: str
    description: str


@dataclass(frozen=True)
class Capability:
    name: str
    version: str
    schema_url: str
    extends: tuple[str, ...] | None = None


@dataclass(frozen=True)
class SchemaBase:
    """Where schema URLs are found: a local folder, in place of a remote prefix if one is given."""

    local: str | None = None
    remote: str | None = None


@dataclass(frozen=True)
class VersionRange:
    least: str
    most: str | None = None

    def holds(self, version: str) -> bool:
        """Versions are compared as text, and both ends belong to the range."""
        return self.least <= version and (self.most is None or version <= self.most)

    def __str__(self) -> str:
        return f">= {self.least}" if self.most is None else f"[{self.least}, {self.most}]"

    @classmethod
    def parse(cls, value: Any) -> VersionRange | None:
        """None where the value is no range."""
        if not isinstance(value, dict) or not is_version(value.get("min")):
            return None
        most = value.get("max")
        if most is not None and not is_version(most) or "max" in value and most is None:
            return None
        return cls(value["min"], most)


@dataclass(frozen=True)
class Requires:
    protocol: VersionRange | None = None
    capabilities: dict[str, VersionRange] = field(default_factory=dict)

    @classmethod
    def parse(cls, value: Any) -> Requires | None:
        """None where anything in the value is malformed."""
        if not isinstance(value, dict):
            return None
        protocol, named = None, {}
        if "protocol" in value:
            protocol = VersionRange.parse(value["protocol"])
            if protocol is None:
                return None
        if "capabilities" in value:
            if not isinstance(value["capabilities"], dict):
                return None
            for name, x in value["capabilities"].items():
                named[name] = VersionRange.parse(x)
                if named[name] is None:
                    return None
        return cls(protocol, named)


def is_version(value: Any) -> bool:
    return isinstance(value, str) and VERSION.fullmatch(value) is not None


def json_type(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]
