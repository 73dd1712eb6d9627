"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes up to which joined_hot() broadcasts all keys.
SMALL_BYTES = 8 << 20
#: Keys that joined_hot() broadcasts at most.
HOT = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder; on a cluster, whose machines would not share it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    return tempfile.mkdtemp(prefix="payloom-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, so that a lost executor costs a reread and not a recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bytes_of(df: DataFrame) -> int:
    """About as many bytes as the rows take in memory, measured over all of them."""
    total = F.lit(0)
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c) + 16
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            size = F.greatest(F.size(c), F.lit(0)) * 8 + 24
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(c)) * 2 + 24
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(8)).cast("long")
    return df.agg(F.sum(total + 16)).first()[0] or 0


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df to be broadcast if it measures no more than so many bytes; else Spark shuffles it. df should be cut, since it is measured."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def hot_from(keyed: DataFrame, n: str = "n") -> int | None:
    """Of how many rows keys are hot (they are HOT at most), where keyed has in n how many rows have a key; None if there are no such keys."""
    total, most = keyed.agg(F.sum(n), F.max(n)).first()
    least = max(256, (total or 0) // HOT)
    return least if (most or 0) > least else None


def joined_hot(rows: DataFrame, keyed: DataFrame, by: list[str], least: int | None, n: str = "n") -> DataFrame:
    """rows joined with keyed, which has each key once; least: hot_from().

    Hot keys are broadcast, so that their rows stay where they are; the others, of which none is large, are shuffled, unless
    all keys together are few enough to be broadcast.
    """
    if least is None:
        return rows.join(keyed, by)
    keyed = cut(keyed)
    if bytes_of(keyed) <= SMALL_BYTES:
        return rows.join(F.broadcast(keyed), by)
    hot, usual = keyed.where(F.col(n) > least), keyed.where(F.col(n) <= least)
    cold = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(usual, by)
    return rows.join(F.broadcast(hot), by).unionByName(cold)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: inside other functions' lambdas an expression would run for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Entries of an array that are folded in one loop.
BLOCK = 64


def prefixes(values: Column, use: Callable[[Callable[[Column], Column]], Column], maximum: bool = False) -> Column:
    """use(before), where before(i) is the sum (or the maximum, 0 at least) of the first i of an array of longs.

    Sums of blocks, and of blocks of blocks, keep the loops short for arrays of millions.
    """

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda t, x: F.greatest(t, x) if maximum else t + x)

    def blocks(a: Column) -> Column:
        last = F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(a, b * BLOCK + 1, BLOCK)))

    def at(v: Column, small: Column, run: Column) -> Callable[[Column], Column]:
        def before(i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            c = F.floor(i / (BLOCK * BLOCK)).cast("int")
            parts = F.get(run, c), fold(F.slice(small, c * BLOCK + 1, b - c * BLOCK)), fold(F.slice(v, b * BLOCK + 1, i - b * BLOCK))
            return F.greatest(*parts) if maximum else parts[0] + parts[1] + parts[2]

        return before

    def running(small: Column) -> Column:
        return let(blocks(small), lambda large: F.transform(F.sequence(F.lit(0), F.size(large)), lambda c: fold(F.slice(large, F.lit(1), c))))

    return let(values, lambda v: let(blocks(v), lambda small: let(running(small), lambda run: use(at(v, small, run)))))


def located(text: Column, pattern: str) -> Column:
    """start, end (code points) and value of each match of a pattern, in order; its matches must not be empty."""

    def spans(s: Column) -> Column:
        pieces, hits = s["pieces"], s["hits"]
        steps = F.transform(hits, lambda h, i: (F.length(F.get(pieces, i)) + F.length(h)).cast("long"))

        def one(before):
            def span(h: Column, i: Column) -> Column:
                return let(before(i) + F.length(F.get(pieces, i)), lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("value")))

            return span

        return prefixes(steps, lambda before: F.transform(hits, one(before)))

    return let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), spans)
