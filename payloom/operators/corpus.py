"""Resolution over corpora of schema documents: each document is small and is worked on in one task, where Spark has dealt it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..model import DEFAULT, PayloomError, Requires, ResolveOptions, Vocabulary
from ..plans.resolve import resolve, visibility_matrix
from ..sources.documents import parse_json


def _each(corpus: DataFrame, schema: str, rows_of: Callable[[Any], list[tuple]], failed: Callable[[PayloomError], list[tuple]]) -> DataFrame:
    """uri and the rows of each document of corpus(uri, content); failed: the rows of one that an error stops."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(content: str | None) -> list[tuple]:
        try:
            return rows_of(parse_json(content or ""))
        except PayloomError as e:
            return failed(e)

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(uri, *r) for uri, content in zip(part["uri"], part["content"], strict=True) for r in rows(content)], columns=["uri", *names])

    return corpus.select("uri", "content").mapInPandas(made, f"uri string, {schema}")


def visibility_rows(corpus: DataFrame, operations: tuple[str, ...], directions: tuple[str, ...] = ("request", "response"), vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """uri, pointer, direction, op, visibility, becomes, fault of every member of every document; a document with a fault has one row."""
    schema = "pointer string, direction string, op string, visibility string, becomes string, fault string"
    return _each(corpus, schema, lambda v: [(*r, None) for r in visibility_matrix(v, operations, directions, vocabulary)], lambda e: [(None,) * 5 + (e.kind,)])


def resolved(corpus: DataFrame, options: ResolveOptions) -> DataFrame:
    """uri, content (the plain schema), fault of every document."""
    return _each(corpus, "content string, fault string", lambda v: [(json.dumps(resolve(v, options), ensure_ascii=False), None)], lambda e: [(None, e.kind)])


def demands(corpus: DataFrame) -> DataFrame:
    """uri, target, least, most of the versions that every document asks for; documents whose demands are malformed ask for nothing."""

    def asked(value: Any) -> list[tuple]:
        requires = Requires.parse(value.get("requires")) if isinstance(value, dict) else None
        if requires is None:
            return []
        return [(name, r.least, r.most) for name, r in [("protocol", requires.protocol), *requires.capabilities.items()] if r is not None]

    return _each(corpus, "target string, least string, most string", asked, lambda e: [])
