"""References inlined and schemas composed over tables of documents: what documents ask of each other is found by joins.

A unit is a document, or the part of one that a reference leads to. Units are looked for round by round, each round one join of
new references with the documents by their URIs; then they are put together from those that refer to nothing upwards. A
task holds one unit with the parts that it refers to, never a whole corpus.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import join_url
from ..model import DEFAULT, ComposeError, PayloomError, Vocabulary
from ..plans.compose import compose, parse_capabilities, profile_envelope
from ..sources.documents import Documents, navigate, parse_json
from .capabilities import need_shared_folder

UNIT = "uri string, fragment string, content string, refs array<struct<ref:string,to_uri:string,to_fragment:string>>, fault string"


def _refs(value: Any) -> set[str]:
    """The references in a value, but for those to the document as a whole."""
    found, pending = set(), [value]
    while pending:
        v = pending.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$ref"), str) and v["$ref"] != "#":
                found.add(v["$ref"])
            pending += v.values()
        elif isinstance(v, list):
            pending += v
    return found


def inlined(value: Any, targets: dict[str, Any]) -> Any:
    """A value with references replaced by their targets, beside which what is there already wins."""
    if isinstance(value, list):
        return [inlined(v, targets) for v in value]
    if not isinstance(value, dict):
        return value
    ref = value.get("$ref")
    own = {k: inlined(v, targets) for k, v in value.items() if k != "$ref" or v == "#" or not isinstance(v, str)}
    if not isinstance(ref, str) or ref == "#":
        return own
    target = targets[ref]
    return {**own, **{k: v for k, v in target.items() if k not in own}} if isinstance(target, dict) else own


def _unit(uri: str, fragment: str, content: str | None) -> tuple:
    if content is None:
        return uri, fragment, None, [], f"{uri} is not in the corpus"
    try:
        root = parse_json(content)
    except PayloomError as e:
        return uri, fragment, None, [], e.message
    value = navigate(root, fragment) if fragment else root
    if value is None and fragment:
        return uri, fragment, None, [], f"{uri}#{fragment} points nowhere"
    refs = []
    for ref in sorted(_refs(value)):
        place, _, part = ref.partition("#")
        refs.append((ref, join_url(place, uri) if place else uri, part))
    return uri, fragment, json.dumps(value, ensure_ascii=False), refs, None


def _mapped(rows: DataFrame, schema: str, make: Callable[..., tuple], *names: str) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in _top(schema)]

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([make(*r) for r in zip(*(part[n] for n in names), strict=True)], columns=columns)

    return rows.select(*names).mapInPandas(made, schema)


def _top(schema: str) -> list[str]:
    """The columns of a schema, at its commas outside brackets."""
    parts, depth = [""], 0
    for c in schema:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def bundle_corpus(corpus: DataFrame) -> DataFrame:
    """uri, content (with references inlined), fault of every document of corpus(uri, content), of which each URI is one row.

    A document that leads to one that is missing, to a pointer that points nowhere, or back to itself has a fault and no
    content; so has every document that refers to it. Rounds grow with the longest chain of references.
    """
    need_shared_folder(corpus.sparkSession)
    docs = corpus.select("uri", "content")
    new = _mapped(docs.withColumn("fragment", F.lit("")), UNIT, _unit, "uri", "fragment", "content").checkpoint()
    every = new
    while True:
        wanted = new.select(F.explode("refs").alias("r")).select(F.col("r.to_uri").alias("uri"), F.col("r.to_fragment").alias("fragment")).distinct()
        wanted = wanted.join(every.select("uri", "fragment"), ["uri", "fragment"], "left_anti").join(docs, "uri", "left")
        new = _mapped(wanted, UNIT, _unit, "uri", "fragment", "content").checkpoint()
        if new.isEmpty():
            break
        every = every.unionByName(new)
    done = every.where("size(refs) = 0").drop("refs")
    left = every.where("size(refs) > 0")
    while True:
        edges = left.select("uri", "fragment", F.explode("refs").alias("r")).select("uri", "fragment", "r.*")
        met = edges.join(done.select(F.col("uri").alias("to_uri"), F.col("fragment").alias("to_fragment"), F.struct("content", "fault").alias("target")), ["to_uri", "to_fragment"])
        met = met.groupBy("uri", "fragment").agg(F.collect_list(F.struct("ref", "target.content", "target.fault")).alias("targets"))
        ready = left.join(met, ["uri", "fragment"]).where((F.size("targets") == F.size("refs")) | F.exists("targets", lambda t: t["fault"].isNotNull()))
        ready = _mapped(ready.withColumn("targets", F.to_json("targets")), "uri string, fragment string, content string, fault string", _put_together, "uri", "fragment", "content", "targets").checkpoint()
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        left = left.join(ready.select("uri", "fragment"), ["uri", "fragment"], "left_anti").checkpoint()
    circular = left.select("uri", "fragment", F.lit(None).cast("string").alias("content"), F.lit("circular reference").alias("fault"))
    return done.unionByName(circular).where("fragment = ''").join(docs.select("uri"), "uri", "left_semi").select("uri", "content", "fault")


def _put_together(uri: str, fragment: str, content: str, targets: str) -> tuple:
    found = json.loads(targets)
    fault = min((t["fault"] for t in found if t.get("fault")), default=None)
    if fault:
        return uri, fragment, None, fault
    return uri, fragment, json.dumps(inlined(json.loads(content), {t["ref"]: json.loads(t["content"]) for t in found}), ensure_ascii=False), None


COMPOSED = "key string, capabilities string, content string, kind string, message string, code int"


def compose_from_tables(sets: DataFrame, schemas: DataFrame, profiles: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """key, capabilities, content (the composed schema), kind, message, code for each of sets(key, capabilities, profile).

    capabilities is JSON as a payload declares it; where it is NULL, profile is the URI of a row of profiles(uri, content). Schemas
    are rows of schemas(uri, content) by the URIs that capabilities name, with their references inlined, as bundle_corpus()
    gives them. What is missing is a fault of the sets that ask for it: ProfileFetch or SchemaFetch.
    """
    key = vocabulary.envelope
    known = sets.join(profiles.select(F.col("uri").alias("profile"), F.col("content").alias("told")), "profile", "left").select("key", "capabilities", "profile", "told")

    def declared(key_: str, capabilities: str | None, profile: str | None, told: str | None) -> tuple:
        try:
            if capabilities is None:
                if told is None:
                    raise ComposeError("ProfileFetch", f"the profile {profile} is not in the table", url=profile)
                capabilities = json.dumps(profile_envelope(parse_json(told), profile, key))
            urls = sorted({c.schema_url for c in parse_capabilities(json.loads(capabilities))})
            return key_, capabilities, urls, None, None, None
        except PayloomError as e:
            return key_, capabilities, [], e.kind, e.message, e.exit_code

    def composed(key_: str, capabilities: str, found: str) -> tuple:
        held = {d.get("uri"): d.get("content") for d in json.loads(found)}

        def fetch(url: str) -> str:
            if held.get(url) is None:
                raise ComposeError("SchemaFetch", "it is not in the table", url=url)
            return held[url]

        try:
            schema = compose(parse_capabilities(json.loads(capabilities)), Documents(fetch=fetch, vocabulary=vocabulary))
            return key_, capabilities, json.dumps(schema, ensure_ascii=False), None, None, None
        except PayloomError as e:
            return key_, capabilities, None, e.kind, e.message, e.exit_code

    need_shared_folder(sets.sparkSession)
    parsed = _mapped(known, "key string, capabilities string, urls array<string>, kind string, message string, code int", declared, "key", "capabilities", "profile", "told").checkpoint()
    asked = parsed.where("kind is null").select("key", F.explode_outer("urls").alias("uri")).join(schemas.select("uri", "content"), "uri", "left")
    held = asked.groupBy("key").agg(F.to_json(F.collect_list(F.struct("uri", "content"))).alias("found"))  # the few schemas of a set
    good = _mapped(parsed.where("kind is null").join(held, "key"), COMPOSED, composed, "key", "capabilities", "found")
    return good.unionByName(parsed.where("kind is not null").select("key", "capabilities", F.lit(None).cast("string").alias("content"), "kind", "message", "code"))
