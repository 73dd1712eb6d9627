"""Linting of schema corpora: documents are flattened to nodes once, and every rule is a query over the nodes.

A node row knows its own members' names and texts and the keys above it, so most rules are filters; only references and
demands on capabilities need joins, all by document and place. Documents are small and many: the corpus is distributed,
and one document is flattened in one task.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_version_col
from ..model import DEFAULT, OPERATIONS, VISIBILITIES, PayloomError, ResolveError, Vocabulary, json_type
from ..plans.interpreter import violations
from ..sources.documents import parse_json, schema_files
from .capabilities import need_shared_folder

NODES = (
    "uri string, node_id int, parent_id int, depth int, pointer string, anchor string, key string, ordinal int, json_type string, scalar string, "
    "keys array<string>, texts map<string,string>, up_key string, up_type string, up_pointer string, up2_key string, target_uri string, bad_examples array<int>, fault string"
)
_NAMES = [c.split()[0] for c in re.sub(r"<[^>]*>", "", NODES).split(", ")]


def nodes(corpus: DataFrame) -> DataFrame:
    """Nodes of corpus(uri, content); a document that is no JSON has one node, with a fault."""

    def flattened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for uri, content in zip(part["uri"], part["content"], strict=True) for r in document_nodes(uri, content)]
            found = pd.DataFrame(rows, columns=_NAMES)
            yield found.astype({"node_id": "Int32", "parent_id": "Int32", "depth": "Int32", "ordinal": "Int32"})

    return corpus.select("uri", "content").mapInPandas(flattened, NODES)


def document_nodes(uri: str, content: str | None) -> list[tuple]:
    try:
        root = parse_json(content or "")
    except ResolveError as e:
        return [(uri, 0, None, 0, "", None, None, None, None, None, None, None, None, None, None, None, None, None, e.message)]
    rows: list[tuple] = []
    todo: list[tuple] = [(root, None, 0, "", "", None, 0, None, None, None, None)]
    while todo:
        value, parent, depth, pointer, anchor, key, ordinal, up_key, up_type, up_pointer, up2_key = todo.pop()
        me, kind = len(rows), json_type(value)
        scalar = value if kind == "string" else None if kind in ("object", "array") else json.dumps(value)
        keys = list(value) if kind == "object" else None
        texts = {k: v for k, v in value.items() if isinstance(v, str)} if kind == "object" else None
        target = None
        if key == "$ref" and kind == "string" and up_type == "object" and not value.startswith(("#", "http://", "https://")):
            target = resolved_uri(uri, value.partition("#")[0])
        rows.append((uri, me, parent, depth, pointer, anchor, key, ordinal, kind, scalar, keys, texts, up_key, up_type, up_pointer, up2_key, target, bad_examples(value), None))
        below: list[tuple[Any, str | None, str]] = []
        if kind == "object":
            below = [(v, k, k) for k, v in value.items()]
        elif kind == "array":
            below = [(v, None, str(i)) for i, v in enumerate(value)]
        for i, (v, k, part) in reversed(list(enumerate(below))):
            way = None if k is None or anchor is None else f"{anchor}/{k.replace('~', '~0').replace('/', '~1')}"
            todo.append((v, me, depth + 1, f"{pointer}/{part}", way, k, i, key, kind, pointer, up_key))
    return rows


def resolved_uri(uri: str, place: str) -> str:
    scheme, slashes, path = uri.partition("://")
    if not slashes:
        return posixpath.normpath(posixpath.join(posixpath.dirname(uri), place))
    return f"{scheme}://{posixpath.normpath(posixpath.join(posixpath.dirname(path), place))}"


def bad_examples(value: Any) -> list[int] | None:
    """Positions of the examples that break the schema which holds them; nothing where it cannot be checked alone."""
    if not isinstance(value, dict) or not isinstance(value.get("examples"), list):
        return None
    try:
        return [i for i, x in enumerate(value["examples"]) if violations(value, x)]
    except (PayloomError, RecursionError, re.error, TypeError, ValueError, AttributeError):
        return None


def canonical_anchor(fragment: Column) -> Column:
    """#/a/b, #a/b and #/a/b/ name the same place."""
    inner = F.regexp_replace(F.regexp_replace(fragment, "^#", ""), "^/+|/+$", "")
    return F.when(inner == "", "").otherwise(F.concat(F.lit("/"), inner))


def diagnostics(corpus: DataFrame, operations: tuple[str, ...] = OPERATIONS, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """file, severity, code, path, message of every finding."""
    need_shared_folder(corpus.sparkSession)
    return from_nodes(nodes(corpus).checkpoint(), operations, vocabulary)  # flattened once for all rules


def from_nodes(found: DataFrame, operations: tuple[str, ...] = OPERATIONS, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    read = found.where("fault is null")
    rules = [*_documents(found, read), *_references(read), *_annotations(read, operations, vocabulary), *_requires(read)]
    return reduce(DataFrame.unionByName, rules)


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus; Spark takes nodes for as small as the table that they were made from, and would broadcast them."""
    return df.hint("merge")


def _rows(df: DataFrame, code: str, path: Column, message: Column) -> DataFrame:
    severity = "error" if code.startswith("E") else "warning"
    return df.select(F.col("uri").alias("file"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"), message.alias("message"))


def _said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def _documents(found: DataFrame, read: DataFrame) -> list[DataFrame]:
    here = F.col("pointer")
    spoilt = read.where("bad_examples is not null").select("uri", "pointer", F.explode("bad_examples").alias("i"))
    return [
        _rows(found.where("fault is not null"), "E001", F.lit("/"), _said("syntax error: ", F.col("fault"))),
        _rows(read.where("node_id = 0").where(~F.coalesce(F.array_contains("keys", "$id"), F.lit(False))), "W002", F.lit("/"), F.lit("the schema has no $id")),
        _rows(spoilt, "E008", _said(here, "/examples/", F.col("i").cast("string")), F.lit("the example breaks its own schema")),
    ]


def _references(read: DataFrame) -> list[DataFrame]:
    refs = read.where("key = '$ref' and json_type = 'string' and up_type = 'object'").select("uri", "target_uri", F.col("scalar").alias("ref"), F.col("up_pointer").alias("pointer"))
    refs = refs.withColumn("fragment", F.when(F.col("ref").contains("#"), F.concat(F.lit("#"), F.substring_index("ref", "#", -1))))
    there = read.where("anchor is not null").select(F.col("uri").alias("to_uri"), F.col("anchor").alias("to_anchor"))
    files = read.select(F.col("uri").alias("to_uri")).distinct()
    own = refs.where(F.col("ref").startswith("#") & (F.col("ref") != "#")).withColumn("to_uri", F.col("uri"))
    other = refs.where("target_uri is not null").withColumn("to_uri", F.col("target_uri"))
    # a file that is there but cannot be read has no nodes with anchors; that is told once, by E001
    known = other.where("fragment is not null and fragment <> '#'").join(_shuffled(files), "to_uri", "left_semi")
    anchored = own.unionByName(known).withColumn("to_anchor", canonical_anchor(F.col("fragment")))
    missing = anchored.join(_shuffled(there), ["to_uri", "to_anchor"], "left_anti")
    return [
        _rows(missing, "E003", F.col("pointer"), _said("anchor not found: ", F.col("ref"))),
        _rows(other.join(_shuffled(files), "to_uri", "left_anti"), "E002", F.col("pointer"), _said("file not found: ", F.substring_index("ref", "#", 1))),
    ]


def _annotations(read: DataFrame, operations: tuple[str, ...], vocabulary: Vocabulary) -> list[DataFrame]:
    names, here = list(vocabulary.annotations), F.col("pointer")
    kind, value = F.col("json_type"), F.col("scalar")
    bad = (kind == "string") & ~value.isin(*VISIBILITIES)
    annotation = read.where(F.col("key").isin(names) & (F.col("up_type") == "object"))
    op = read.where(F.col("up_key").isin(names) & (F.col("up_type") == "object"))
    plain = op.where("key <> 'transition'")
    wrapped = F.coalesce(F.array_contains("keys", "transition"), F.lit(False))
    # a transition stands for all operations, or under one, and then is told at the operation
    inner = read.where((F.col("key") == "transition") & F.col("up2_key").isin(names) & (F.col("up_key") != "transition") & (F.col("up_type") == "object")).withColumn("pointer", F.col("up_pointer"))
    transitions = op.where("key = 'transition'").unionByName(inner)
    text = lambda k: F.coalesce(F.try_element_at("texts", F.lit(k)), F.lit(""))
    moves = text("from").isin(*VISIBILITIES) & text("to").isin(*VISIBILITIES) & (text("from") != text("to"))
    objects = transitions.where("json_type = 'object'")
    one_of = f": one of {', '.join(VISIBILITIES)} is expected"
    return [
        _rows(annotation.where(bad), "E004", here, _said("invalid ", F.col("key"), ' value "', value, f'"{one_of}')),
        _rows(annotation.where(~kind.isin("string", "object")), "E005", here, _said("invalid ", F.col("key"), " type: a string or an object is expected, not ", kind)),
        _rows(plain.where(~F.col("key").isin(*operations)), "W003", here, _said('unknown operation "', F.col("key"), f'": one of {", ".join(operations)} is expected')),
        _rows(plain.where(bad), "E004", here, _said("invalid ", F.col("up_key"), ' value "', value, f'"{one_of}')),
        _rows(plain.where((kind != "string") & ~((kind == "object") & wrapped)), "E005", here, _said("invalid ", F.col("up_key"), " value type: a string or a transition is expected, not ", kind)),
        _rows(transitions.where(kind != "object"), "E005", here, _said("invalid transition: an object is expected, not ", kind)),
        _rows(objects.where(text("description") == ""), "E004", here, F.lit('invalid transition: "description" is missing')),
        _rows(objects.where(~moves), "E004", here, _said('invalid transition: "from" (', text("from"), ') and "to" (', text("to"), ") must be two different visibilities")),
    ]


def _requires(read: DataFrame) -> list[DataFrame]:
    here, kind = F.col("pointer"), F.col("json_type")
    demand = read.where("depth = 1 and key = 'requires'")
    part = read.where("depth = 2 and up_key = 'requires' and up_type = 'object'")
    named = read.where("depth = 3 and up_key = 'capabilities' and up2_key = 'requires' and up_type = 'object'")
    limit = part.where("key = 'protocol'").unionByName(named)
    objects = limit.where("json_type = 'object'")
    text = lambda k: F.try_element_at("texts", F.lit(k))
    has_most = F.array_contains("keys", "max")
    least, most = text("min"), text("max")
    sound = objects.where(least.isNotNull() & is_version_col(F.coalesce(least, F.lit(""))))
    strange = objects.select("uri", "pointer", F.explode(F.array_except("keys", F.array(F.lit("min"), F.lit("max")))).alias("key"))
    defs = read.where("depth = 1 and key = '$defs'").select("uri", F.explode("keys").alias("key"))
    return [
        _rows(demand.where(kind != "object"), "E006", here, _said('"requires" must be an object, not ', kind)),
        _rows(part.where("key = 'capabilities' and json_type <> 'object'"), "E006", here, _said('"requires.capabilities" must be an object, not ', kind)),
        _rows(part.where("key not in ('protocol', 'capabilities')"), "W005", here, _said('unknown key "', F.col("key"), '" in requires')),
        _rows(limit.where(kind != "object"), "E006", here, _said("a version constraint must be an object, not ", kind)),
        _rows(strange, "W005", _said(here, "/", F.col("key")), _said('unknown key "', F.col("key"), '" in a version constraint')),
        _rows(objects.where(least.isNull()), "E006", here, F.lit('the version constraint has no "min"')),
        _rows(objects.where(least.isNotNull() & ~is_version_col(F.coalesce(least, F.lit("")))), "E006", _said(here, "/min"), _said('invalid version "', least, '": YYYY-MM-DD is expected')),
        _rows(sound.where(has_most & most.isNull()), "E006", _said(here, "/max"), F.lit('"max" must be a string')),
        _rows(sound.where(most.isNotNull() & ~is_version_col(F.coalesce(most, F.lit("")))), "E006", _said(here, "/max"), _said('invalid version "', most, '": YYYY-MM-DD is expected')),
        _rows(sound.where(is_version_col(F.coalesce(most, F.lit(""))) & (least > most)), "W004", here, _said("min (", least, ") is after max (", most, ")")),
        _rows(named.join(_shuffled(defs), ["uri", "key"], "left_anti"), "E007", here, _said('"', F.col("key"), '" of requires.capabilities is not in $defs')),
    ]


def file_results(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """file, n_errors, n_warnings, status of every document of the corpus."""
    counts = found.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    every = corpus.select(F.col("uri").alias("file")).join(_shuffled(counts), "file", "left").na.fill(0, ["n_errors", "n_warnings"])
    return every.withColumn("status", F.when(F.col("n_errors") > 0, "error").when(F.col("n_warnings") > 0, "warning").otherwise("ok"))


def summary(results: DataFrame, strict: bool = False) -> DataFrame:
    """One row: files_checked, passed, failed, errors, warnings. Strictly, a warning fails a file."""
    failed = F.count_if((F.col("status") != "ok") if strict else (F.col("status") == "error"))
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return results.agg(n.alias("files_checked"), (n - failed).alias("passed"), failed.alias("failed"), total("n_errors").alias("errors"), total("n_warnings").alias("warnings"))


def from_corpus(path: Path, strict: bool = False, vocabulary: Vocabulary = DEFAULT) -> dict[str, Any]:
    """Report on the schema files at or below a local path, in order, with every finding: what the command line prints."""
    files = schema_files(path)
    root = path if path.is_dir() else path.parent
    names = {str(f.absolute()): str(f.relative_to(root)) for f in files}
    found: dict[str, list[dict]] = {name: [] for name in names}
    if files:
        spark = SparkSession.builder.getOrCreate()
        corpus = spark.createDataFrame([(name, f.read_text("utf-8", "replace")) for name, f in zip(names, files, strict=True)], "uri string, content string")
        for r in diagnostics(corpus, vocabulary=vocabulary).collect():
            if r["code"] == "E002" and _is_elsewhere(r["file"], r["message"].partition(": ")[2]):
                continue  # outside of what is linted, but there
            found[r["file"]].append({"severity": r["severity"], "code": r["code"], "path": r["path"], "message": r["message"]})
    order = {"error": 2, "warning": 1}
    results = []
    for name, some in found.items():
        some.sort(key=lambda d: (-order[d["severity"]], d["code"], d["path"], d["message"]))
        worst = max((order[d["severity"]] for d in some), default=0)
        results.append({"file": names[name], "status": ("ok", "warning", "error")[worst], "diagnostics": some})
    failed = sum(r["status"] != "ok" if strict else r["status"] == "error" for r in results)
    count = lambda s: sum(d["severity"] == s for r in results for d in r["diagnostics"])
    return {"path": str(path), "files_checked": len(files), "passed": len(files) - failed, "failed": failed, "errors": count("error"), "warnings": count("warning"), "results": results}


def _is_elsewhere(file: str, place: str) -> bool:
    return bool(place) and Path(resolved_uri(file, place)).exists()
