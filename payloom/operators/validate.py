"""Validation of payload tables: verdicts, pointer-addressed errors and exit codes, row by row and without a shuffle."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import json_type, member, members, parsed, text, with_variant
from ..functions.names import short_name
from ..model import BAD_SCHEMA, DEFAULT, INVALID, OK, Capability, Invalid, PayloomError, ResolveOptions, Vocabulary
from ..plans import machine
from ..plans.compiler import ERRORS, Compiled, error, errors_in_rounds
from ..plans.compose import compose, detect_direction, envelope_body, parse_capabilities, payload_capabilities, profile_capabilities
from ..plans.drafts import readable
from ..plans.interpreter import violations
from ..plans.registry import Rules, rules
from ..plans.resolve import resolve, select_shape
from ..sources.documents import Documents
from .bundle import bundle_corpus, compose_from_tables
from .capabilities import need_shared_folder

#: Bytes of composed rules up to which they are broadcast, and different rules up to which each is an expression of its own.
BROADCAST_BYTES, COMPILED = 16 << 20, 16


def plan(schema: Any, options: ResolveOptions) -> Any:
    """The plain schema that a payload is held against. All of the schema is resolved before a shape is selected."""
    return select_shape(resolve(schema, options), options)


def validate_payload(payload: Any, schema: Any, options: ResolveOptions) -> None:
    """One value, on the driver; raises Invalid with all violations."""
    found = violations(plan(schema, options), payload)
    if found:
        raise Invalid(found)


def validate_self_described(payload: Any, documents: Documents, operation: str, direction: str | None = None, strict: bool = False, def_name: str | None = None, profile: str | None = None) -> None:
    """One payload against the schema that its capabilities compose."""
    found = detect_direction(payload, documents.vocabulary)
    if profile is not None:
        capabilities, body, found = profile_capabilities(profile, documents), payload, direction or "request"
    else:
        capabilities = payload_capabilities(payload, documents)
        body = envelope_body(payload, capabilities)[0] if found == "request" else payload
    validate_payload(body, compose(capabilities, documents), ResolveOptions(direction or found, operation, strict, False, def_name, documents.vocabulary))


def as_variant(payload: Column, kind: str) -> Column:
    return payload if kind == "variant" else parsed(payload)


def errors_of(v: Column, plain: Any) -> Column:
    """Errors of a variant; of one that could not be parsed, that alone."""
    return F.when(v.isNull(), error(F.lit(""), "json", "the payload is no JSON")).otherwise(_errors_by(Compiled(plain), v))


def _errors_by(compiled: Compiled, v: Column) -> Column:
    """By expressions, where the rules are few, loops only add errors, or the value is no deeper than loops are written out; else by the machine, which is slower and says the same."""
    if not compiled.large:
        return compiled.errors(v)
    rounds = compiled.rules.in_rounds() if compiled.rules.loops else None
    if rounds is not None:
        return errors_in_rounds(v, rounds, (machine.depth(v) + 1) * compiled.rules.steps)
    by_machine = machine.errors(v, machine.constant(compiled.rules), compiled.rules.steps, compiled.rules.annotated)
    flat = compiled.rules.written_out() if compiled.rules.loops else None
    return by_machine if flat is None else F.when(machine.depth(v) <= flat[1], Compiled.of(flat[0]).errors(v)).otherwise(by_machine)


def validate(payloads: DataFrame, schema: Any, options: ResolveOptions, column: str = "payload") -> DataFrame:
    """payloads with valid, errors and exit_code, for one annotated schema; batch or streaming."""
    return with_verdict(payloads, as_variant(F.col(column), dict(payloads.dtypes)[column]), plan(schema, options))


def with_verdict(payloads: DataFrame, v: Column, plain: Any) -> DataFrame:
    return with_variant(payloads, "__payloom_v", v).withColumn("errors", errors_of(F.col("__payloom_v"), plain)).drop("__payloom_v").withColumns(_verdict())


def _verdict() -> dict[str, Column]:
    unread = F.exists("errors", lambda e: e["keyword"] == "json")
    valid = F.size("errors") == 0
    return {"valid": valid, "exit_code": F.when(valid, OK).when(unread, BAD_SCHEMA).otherwise(INVALID)}


# Payloads that describe themselves.


def direction_of(v: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    return F.when(member(member(v, vocabulary.envelope), "capabilities").isNotNull(), "response").when(member(member(v, "meta"), "profile").isNotNull(), "request")


def signature_of(v: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """What decides about the schema: the capabilities themselves (keys in order), or the profile's URL; NULL if that is no string."""
    caps = F.to_json(member(member(v, vocabulary.envelope), "capabilities"))
    profile = member(member(v, "meta"), "profile")
    return F.when(direction_of(v, vocabulary) == "response", caps).when(json_type(profile) == "string", text(profile))


#: What a set of capabilities comes to: rules as JSON, or why there are none.
PLAN = "direction string, __payloom_s string, key string, nodes string, rules string, steps int, annotated boolean, kind string, message string, code int"


@dataclass(frozen=True)
class Tables:
    """Schemas and profiles as tables (uri, content), in place of documents that are fetched; references in schemas are inlined first."""

    schemas: DataFrame
    profiles: DataFrame
    vocabulary: Vocabulary = DEFAULT


def capability_plans(signatures: DataFrame, documents: Documents | Tables, operation: str, strict: bool = False) -> DataFrame:
    """One row for each of signatures (direction, __payloom_s): the rules that it composes, or its fault.

    Tasks compose them, each with its own copy of documents, so that each document is read once in a task at most.
    """

    schema, n = to_arrow_schema(T.StructType.fromDDL(PLAN)), signatures.sparkSession.sparkContext.defaultParallelism
    if isinstance(documents, Tables):
        return _plans_from(signatures, documents, operation, strict, schema)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_plan(*pair, documents, operation, strict) for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema)

    return signatures.repartition(n, "direction", "__payloom_s").mapInArrow(composed, PLAN)


def _plans_from(signatures: DataFrame, tables: Tables, operation: str, strict: bool, schema: pa.Schema) -> DataFrame:
    response, s, words = F.col("direction") == "response", F.col("__payloom_s"), tables.vocabulary
    sets = signatures.select(F.to_json(F.struct("direction", "__payloom_s")).alias("key"), F.when(response, s).alias("capabilities"), F.when(~response, s).alias("profile"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, capabilities, content, kind, message, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = json.loads(key)
                try:
                    if kind is not None:
                        row |= {"kind": kind, "message": message, "code": code}
                    else:
                        row |= _ruled(row["direction"], parse_capabilities(json.loads(capabilities)), json.loads(content), operation, strict, words)
                except PayloomError as e:
                    row |= {"kind": e.kind, "message": e.message, "code": e.exit_code}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return compose_from_tables(sets, bundle_corpus(tables.schemas), tables.profiles, words).mapInArrow(planned, PLAN)


def _ruled(direction: str, capabilities: list[Capability], composed: Any, operation: str, strict: bool, words: Vocabulary) -> dict:
    key = None if direction == "response" else short_name(next((c.name for c in capabilities if c.extends is None), ""))
    found = rules(plan(composed, ResolveOptions(direction, operation, strict, vocabulary=words)))
    return {"key": key, "nodes": json.dumps(found.nodes), "rules": json.dumps(machine.rows(found)), "steps": found.steps, "annotated": found.annotated}


def _plan(direction: str, signature: str, documents: Documents, operation: str, strict: bool) -> dict:
    row: dict[str, Any] = {"direction": direction, "__payloom_s": signature}
    try:
        capabilities = parse_capabilities(json.loads(signature)) if direction == "response" else profile_capabilities(signature, documents)
        return row | _ruled(direction, capabilities, compose(capabilities, documents), operation, strict, documents.vocabulary)
    except PayloomError as e:
        return row | {"kind": e.kind, "message": e.message, "code": e.exit_code}


def validate_by_capabilities(payloads: DataFrame, documents: Documents | Tables, operation: str, strict: bool = False, column: str = "payload") -> DataFrame:
    """payloads with direction, valid, errors, exit_code, each against what its own capabilities compose.

    Schemas are composed once for each distinct signature, and go to the payloads as rows of rules, so that the plan is the
    same for any number of signatures; where they come to no more than COMPILED different rules, each of these is compiled,
    which is faster and gives the same. A signature that cannot be composed, or whose schema is none, is an error of its
    own payloads, with the exit code of the failure. Rules are broadcast while they measure no more than
    BROADCAST_BYTES; beyond, payloads are shuffled to them. Batch only.
    """
    marked = by_signature(payloads, documents.vocabulary, column)
    need_shared_folder(payloads.sparkSession)
    plans = unreadable_patterns(capability_plans(signatures(marked), documents, operation, strict).checkpoint())
    return with_plans(marked, plans, payloads.columns)


def by_signature(payloads: DataFrame, vocabulary: Vocabulary = DEFAULT, column: str = "payload") -> DataFrame:
    """payloads with __payloom_v (the variant), direction and __payloom_s (the signature)."""
    v = as_variant(F.col(column), dict(payloads.dtypes)[column])
    return with_variant(payloads, "__payloom_v", v).withColumn("direction", direction_of(F.col("__payloom_v"), vocabulary)).withColumn("__payloom_s", signature_of(F.col("__payloom_v"), vocabulary))


def signatures(marked: DataFrame) -> DataFrame:
    return marked.where("direction is not null and __payloom_s is not null").select("direction", "__payloom_s").distinct()


def with_plans(marked: DataFrame, plans: DataFrame, columns: list[str]) -> DataFrame:
    """columns, direction, errors, valid, exit_code of by_signature(), by plans that have been written down."""
    few = [r["nodes"] for r in plans.where("kind is null").select("nodes").distinct().limit(COMPILED + 1).collect()]
    size, annotated = plans.agg(F.sum(F.coalesce(F.length("rules"), F.lit(0)) * 4 + F.length("__payloom_s") + 64), F.max("annotated")).first()
    names = ("key", "set", "rules", "steps", "annotated", "kind", "message", "code")
    plans = plans.withColumn("set", F.md5("nodes")).drop("nodes").withColumn("rules", F.lit(None) if len(few) <= COMPILED else F.from_json("rules", machine.RULES)).withColumnsRenamed({k: f"__payloom_{k}" for k in names})
    joined = marked.join(F.broadcast(plans) if (size or 0) <= BROADCAST_BYTES else plans, ["direction", "__payloom_s"], "left")
    col = lambda k: F.col(f"__payloom_{k}")
    fault = lambda kind, message, code: F.struct(error(F.lit(""), kind, message).alias("errors"), F.lit(code).alias("failed"))
    body = F.when(col("key").isNull(), col("v")).otherwise(F.try_element_at(members(col("v")), col("key")))
    if len(few) <= COMPILED:
        found = F.lit(None).cast(ERRORS)
        for nodes in few:
            found = F.when(col("set") == hashlib.md5(nodes.encode()).hexdigest(), _errors_by(Compiled.of(Rules.of(json.loads(nodes))), body)).otherwise(found)
    else:
        found = machine.errors(body, col("rules"), col("steps"), bool(annotated))
    told = F.array(F.struct(F.lit("").alias("path"), col("kind").alias("keyword"), col("message").alias("message")))
    verdict = (
        F.when(col("v").isNull(), fault("InvalidJson", "invalid JSON", BAD_SCHEMA))
        .when(F.col("direction").isNull(), fault("NotSelfDescribing", "nothing in the payload says which schema it follows", BAD_SCHEMA))
        .when(col("s").isNull(), fault("InvalidEnvelope", "meta.profile of a request has to be a string", BAD_SCHEMA))
        .when(col("kind").isNotNull(), F.struct(told.alias("errors"), col("code").alias("failed")))
        .when(body.isNull(), fault("InvalidEnvelope", F.concat(F.lit("the request holds no '"), col("key"), F.lit("'")), BAD_SCHEMA))
        .otherwise(F.struct(found.alias("errors"), F.lit(None).cast("int").alias("failed")))
    )
    checked = joined.withColumn("__payloom_r", verdict).withColumn("errors", F.col("__payloom_r.errors"))
    checked = checked.withColumns({"valid": F.size("errors") == 0, "exit_code": F.coalesce(F.col("__payloom_r.failed"), F.when(F.size("errors") == 0, OK).otherwise(INVALID))})
    return checked.select(*columns, "direction", "errors", "valid", "exit_code")


def unreadable_patterns(plans: DataFrame) -> DataFrame:
    """plans, with a fault in place of rules that have a pattern which the JVM cannot read; tasks have asked Python's engine only."""
    listed = "array<struct<pattern:string,patterns:array<struct<pattern:string>>>>"
    each = plans.select(F.explode(F.from_json("rules", listed)).alias("r")).select(F.explode(F.array_compact(F.concat(F.array("r.pattern"), F.coalesce("r.patterns.pattern", F.array().cast("array<string>"))))).alias("p"))
    bad = [r["p"] for r in each.distinct().toLocalIterator() if not readable(r["p"])]  # one after the other; what is kept are faults
    if not bad:
        return plans
    of = F.from_json("rules", listed)
    hit = F.exists(of, lambda r: r["pattern"].isin(bad) | F.exists(r["patterns"], lambda p: p["pattern"].isin(bad)))
    hit = F.coalesce(hit, F.lit(False))
    return plans.withColumns({"kind": F.when(hit, "InvalidSchema").otherwise(F.col("kind")), "message": F.when(hit, "invalid schema: a pattern cannot be read").otherwise(F.col("message")), "code": F.when(hit, BAD_SCHEMA).otherwise(F.col("code"))})


# Reports.


def error_rows(validated: DataFrame, *keys: str) -> DataFrame:
    """One row for each error, with the payload's keys."""
    # a plain explode would have Spark test the size of errors below, and work them out twice for that
    every = validated.select(*keys, F.explode_outer("errors").alias("e")).where("e is not null")
    return every.select(*keys, "e.path", "e.keyword", "e.message")


def violation_summary(validated: DataFrame) -> DataFrame:
    """Errors by keyword and place, array positions taken together."""
    place = F.regexp_replace("path", r"/[0-9]+(?=/|$)", "/*")
    return error_rows(validated).groupBy("keyword", place.alias("place")).agg(F.count("*").alias("n_errors"))


def exit_codes(validated: DataFrame) -> DataFrame:
    return validated.groupBy("exit_code").agg(F.count("*").alias("n_payloads"))


def verdict_json(validated: DataFrame, *keys: str) -> DataFrame:
    """keys and verdict: {"valid":true}, or {"valid":false,"errors":[{"path","message"}]}."""
    told = F.transform("errors", lambda e: F.struct(e["path"].alias("path"), e["message"].alias("message")))
    verdict = F.when(F.col("valid"), F.lit('{"valid":true}')).otherwise(F.to_json(F.struct(F.col("valid").alias("valid"), told.alias("errors"))))
    return validated.select(*keys, verdict.alias("verdict"))


