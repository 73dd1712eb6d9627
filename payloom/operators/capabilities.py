"""Capabilities of payload tables as rows, and the checks of their graphs as joins and aggregates."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import elements, json_type, member, members
from ..functions.names import binding_status_col, in_range_col, short_name_col
from ..model import DEFAULT, Vocabulary


def need_shared_folder(spark: SparkSession) -> None:
    """Sets the folder for checkpoints: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine; on a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {context.master} share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="payloom-checkpoint-"))


def capability_rows(payloads: DataFrame, key: str, v: Column, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """key, ord, name, version, schema_url, extends, fault: the first version of each capability of a payload.

    Names are in order, since a variant keeps its members so. fault tells why an entry is no capability, else it is NULL.
    """
    found = payloads.select(key, F.posexplode(F.map_entries(members(member(member(v, vocabulary.envelope), "capabilities")))).alias("ord", "c"))
    return _parsed(found, key, "c.value", "c.key")


def _parsed(found: DataFrame, key: str, versions: str, name: str) -> DataFrame:
    """An entry's parts are looked up once, all together, and their types once each."""
    listed = elements(F.col(versions))
    found = found.select(key, "ord", F.col(name).alias("name"), listed.alias("versions"))
    shape = "struct<version:variant,schema:variant,extends:variant>"
    found = found.select(key, "ord", "name", "versions", F.try_variant_get(F.get("versions", F.lit(0)), "$", shape).alias("first"))
    part = lambda k: F.col(f"first.{k}")
    typed = found.select("*", *(json_type(part(k)).alias(f"{k}_type") for k in ("version", "schema", "extends")), elements(part("extends")).alias("listed"))
    text = lambda k: F.when(F.col(f"{k}_type") == "string", F.try_variant_get(part(k), "$", "string"))
    parents = F.when(F.col("extends_type") == "string", F.array(text("extends"))).when(F.col("extends_type") == "array", F.transform("listed", lambda x: F.try_variant_get(x, "$", "string")))
    strings = F.coalesce(F.forall("listed", lambda x: json_type(x) == "string"), F.lit(False))
    fault = (
        F.when(F.coalesce(F.size("versions"), F.lit(0)) < 1, "a non-empty array of versions is expected")
        .when(text("version").isNull(), "missing version")
        .when(text("schema").isNull(), "missing schema")
        .when(F.col("extends_type").isNotNull() & ~((F.col("extends_type") == "string") | strings), "extends must be a string or an array of strings")
    )
    return typed.select(key, "ord", "name", text("version").alias("version"), text("schema").alias("schema_url"), parents.alias("extends"), fault.alias("fault"))


def roots(caps: DataFrame, key: str) -> DataFrame:
    """key, n_roots, status (ok, none, many), root (the first one) of each graph."""
    is_root = F.col("extends").isNull()
    n = F.count_if(is_root)
    return caps.groupBy(key).agg(
        n.alias("n_roots"), F.when(n == 1, "ok").when(n == 0, "none").otherwise("many").alias("status"), F.min_by(F.when(is_root, F.col("name")), F.when(is_root, F.col("ord"))).alias("root")
    )


def edges(caps: DataFrame, key: str) -> DataFrame:
    return caps.select(key, F.col("name"), F.explode("extends").alias("parent"))


def unknown_parents(caps: DataFrame, key: str) -> DataFrame:
    """key, name, parent of the edges whose parent is no capability of the same graph."""
    return edges(caps, key).join(caps.select(key, F.col("name").alias("parent")), [key, "parent"], "left_anti").select(key, "name", "parent")


def orphans(caps: DataFrame, key: str) -> DataFrame:
    """key, name of the capabilities from which no way leads to a root.

    Graphs are walked downwards from their roots, one step a round, each round a join of what is new with the edges;
    it ends when nothing new is reached, so cycles do no harm.
    """
    need_shared_folder(caps.sparkSession)  # a plan that is not cut grows with each round
    below = edges(caps, key)
    reached = caps.where("extends is null").select(key, "name")
    new = reached
    while True:
        new = below.join(new.withColumnRenamed("name", "parent"), [key, "parent"]).select(key, "name").distinct().join(reached, [key, "name"], "left_anti")
        new = new.checkpoint()
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
    return caps.select(key, "name").join(reached, [key, "name"], "left_anti")


def binding_status(caps: DataFrame, key: str) -> DataFrame:
    """key, name, schema_url, status: ok, unbound (no URL), or the rule broken."""
    bound = F.col("schema_url").startswith("http://") | F.col("schema_url").startswith("https://")
    return caps.select(key, "name", "schema_url", F.when(bound, binding_status_col(F.col("name"), F.col("schema_url"))).otherwise("unbound").alias("status"))


def version_violations(caps: DataFrame, demands: DataFrame, key: str) -> DataFrame:
    """key, extension, target, least, most, actual for each version that an extension does not accept.

    demands has extension, target (a capability's name, or "protocol"), least, most. The protocol's version is that of
    the root. A target that a graph does not have is no violation.
    """
    there = caps.select(key, F.col("name").alias("target"), F.col("version").alias("actual"))
    protocol = caps.where("extends is null").select(key, F.lit("protocol").alias("target"), F.col("version").alias("actual"))
    wanted = caps.where("extends is not null").select(key, F.col("name").alias("extension")).join(demands, "extension")
    found = wanted.join(there.unionByName(protocol), [key, "target"])
    return found.where(~in_range_col(F.col("actual"), F.col("least"), F.col("most"))).select(key, "extension", "target", "least", "most", "actual")


def unwrapped(payloads: DataFrame, v: Column, root: Column) -> DataFrame:
    """payloads with body: what a request's envelope holds under its root capability's short name, NULL where it is missing."""
    return payloads.withColumn("body", F.try_element_at(members(v), short_name_col(root)))
