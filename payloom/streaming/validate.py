"""Validation of payload streams. By one schema it keeps no state, and a stream is validated by the batch expression itself; by the
payloads' own capabilities it keeps the sets that it has met."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import BAD_IO, OK, ResolveOptions
from ..operators.capabilities import need_shared_folder
from ..operators.validate import PLAN, Tables, by_signature, capability_plans, signatures, unreadable_patterns, validate, with_plans
from ..sources.documents import Documents


def validate_stream(payloads: DataFrame, schema: Any, options: ResolveOptions, column: str = "payload") -> DataFrame:
    """payloads with valid, errors and exit_code; the schema is resolved and compiled once, when the query starts."""
    return validate(payloads, schema, options, column)


def split_stream(validated: DataFrame, good_path: str, bad_path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Writes valid payloads to one folder and the others, with their errors, to another; a batch repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.where("valid").drop("valid", "errors", "exit_code").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
            kept.where("not valid").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        finally:
            kept.unpersist()

    return validated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def validate_stream_by_capabilities(payloads: DataFrame, documents: Documents | Tables, operation: str, registry: str, path: str, checkpoint: str, strict: bool = False, column: str = "payload", **trigger: Any) -> StreamingQuery:
    """Writes payloads to path with direction, errors, valid, exit_code, each held against what its own capabilities compose.

    registry is a folder of the sets of capabilities met so far, with their rules: a set is composed in the batch that it first
    appears in, and read in those after it. What could not be fetched is not kept, and tried again. A batch repeated after a
    failure replaces what it had written.
    """
    words, columns = documents.vocabulary, payloads.columns

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        met = [spark.read.schema(PLAN).parquet(f"{registry}/{p}") for p in _folders(spark, registry) if p != f"batch={number}"]
        known = reduce(DataFrame.unionByName, met) if met else spark.createDataFrame([], PLAN)
        marked = by_signature(batch, words, column)
        new = signatures(marked).join(known, ["direction", "__payloom_s"], "left_anti").select("direction", "__payloom_s")
        need_shared_folder(spark)
        made = unreadable_patterns(capability_plans(new, documents, operation, strict).checkpoint())
        made.where(F.coalesce(F.col("code"), F.lit(OK)) != BAD_IO).write.mode("overwrite").parquet(f"{registry}/batch={number}")
        with_plans(marked, known.unionByName(made).checkpoint(), columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path of whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()) if store.exists(at) else []


def rolling_violations(validated: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Errors by window and keyword, for streams with an event time. An addition: one document at a time has no windows."""
    rows = validated.withWatermark(time, late).select(F.col(time), F.explode("errors").alias("e"))
    return rows.groupBy(F.window(time, width), F.col("e.keyword").alias("keyword")).agg(F.count("*").alias("n_errors"))
