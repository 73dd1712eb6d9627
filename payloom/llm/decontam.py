"""Benchmark decontamination by spaced seeds.

A mask of SPAN positions selects some and ignores the others, so that a hash of the selected words of a window is the
same with any words at the ignored positions. Windows of the documents and of the benchmark whose hashes agree under one
of the masks are hits; around a hit, the words on the same diagonal are compared, up to MARGIN words beyond it on either
side as far as the benchmark item goes, and the document is contaminated where AGREE of the words of some stretch that
holds the hit are the same. So a passage of SPAN words counts, wherever it stands in its item. (contaminated() can also
be asked for the longest stretch alone.) An item of fewer than SPAN words is hit where all its words stand in a row.

A Bloom filter of the benchmark's leading pairs of words, which all masks select, and one of its masked hashes stand in
the plan, so that only windows that may hit leave their row. What passes is joined with the benchmark exactly; no
document's text is shuffled. A benchmark whose filters would exceed MAX_BITS is dealt by hash into shards, and the documents
pass once for each.

Words are runs of letters and digits in lower case. Defined cases: a null or empty text has no words; an item without
words cannot be hit; an empty benchmark contaminates nothing; rows repeated with one doc_id, or items with one
item_id, are reported once; rows whose doc_id is null are never reported; other columns are ignored, and kept by
decontaminate().
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, let, table

#: 1: selected. All begin with two selected positions.
MASKS = ("110110010111", "111010110011", "110101101101")
SPAN, MARGIN, AGREE = len(MASKS[0]), 6, 0.8
WORD = r"[\p{L}\p{N}]+"
#: Bits of each filter at most (2 MiB), and for each of its keys.
MAX_BITS, PER_KEY, HASHES = 1 << 24, 12, 3


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _pair(h: Column, i: Column) -> Column:
    return F.xxhash64(F.get(h, i), F.get(h, i + 1))


def _masked(h: Column, i: Column, m: int) -> Column:
    return F.xxhash64(F.lit(m), *(F.get(h, i + p) for p, on in enumerate(MASKS[m]) if on == "1"))


def _starts(h: Column) -> Column:
    last = F.size(h) - SPAN
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _around(h: Column, i: Column) -> Column:
    return F.slice(h, F.greatest(i - MARGIN, F.lit(0)) + 1, F.lit(SPAN + MARGIN) + F.least(i, F.lit(MARGIN)))


def windows(benchmark: DataFrame) -> DataFrame:
    """mask, hash, item_id, before (words in around before the window), around (words' hashes) of all windows."""
    items = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("h"))
    placed = items.select("item_id", "h", F.explode(_starts(F.col("h"))).alias("i"))
    masks = F.array(*(F.struct(F.lit(m).alias("mask"), _masked(F.col("h"), F.col("i"), m).alias("hash")) for m in range(len(MASKS))))
    found = placed.select("item_id", "i", "h", _pair(F.col("h"), F.col("i")).alias("pair"), F.explode(masks).alias("m"))
    return found.select("m.mask", "m.hash", "pair", "item_id", F.least("i", F.lit(MARGIN)).alias("before"), _around(F.col("h"), F.col("i")).alias("around"))


class Filter:
    """A Bloom filter of a column of hashes; its words become a literal of the plan."""

    def __init__(self, keys: DataFrame):
        keys = keys.toDF("key").distinct()
        self.bits = 64 * max(1, math.ceil(keys.count() * PER_KEY / 64))
        spots = keys.select(F.explode(F.array(*self._spots(F.col("key")))).alias("at"))
        words = spots.groupBy(F.expr("at div 64").cast("int").alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("mask")).collect()  # bits / 64 rows at most
        held = [0] * (self.bits // 64)
        for r in words:
            held[r["word"]] = r["mask"]
        self.words = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")

    def _spots(self, key: Column) -> list[Column]:
        # a key is a hash: three of its ranges of bits serve as hashes
        return [F.pmod(F.shiftrightunsigned(key, s), F.lit(self.bits)) for s in (0, 11, 23)[:HASHES]]

    def may_hold(self, key: Column) -> Column:
        def held(k: Column) -> Column:
            found = F.lit(True)
            for at in self._spots(k):
                found = found & (F.get(self.words, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0)
            return found

        return let(key, held)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def _share(same: Column) -> Column:
    return F.aggregate(same, F.lit(0), lambda a, x: a + x) / F.size(same)


def _best(same: Column, before: Column) -> Column:
    """The largest share of ones in a stretch that holds the hit, which begins after `before` places."""
    ends = F.sequence(before + SPAN, F.size(same))
    shares = F.transform(F.sequence(F.lit(0), before), lambda i: F.array_max(F.transform(ends, lambda j: _share(F.slice(same, i + 1, j - i)))))
    return F.array_max(shares)


def _key(words: Column) -> Column:
    return F.xxhash64(words)


def _short(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, agreement (1) of each place where a whole item(item_id, words, key) of fewer than SPAN words stands."""
    lengths = sorted(r["n"] for r in items.select(F.size("words").alias("n")).distinct().collect())  # SPAN - 1 rows at most
    if not lengths:
        return docs.where("false").select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(1.0).alias("agreement"))
    first = Filter(items.select(F.get("words", F.lit(0))))
    keys = Filter(items.select("key"))

    def runs(h: Column) -> Column:
        begun = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: first.may_hold(F.get(h, i)))
        here = lambda i: F.array(*(F.when(i + n <= F.size(h), F.slice(h, i + 1, F.lit(n))) for n in lengths))
        return F.filter(F.flatten(F.transform(begun, here)), lambda w: w.isNotNull() & keys.may_hold(_key(w)))

    found = docs.where(F.size("h") > 0).select("doc_id", F.explode(runs(F.col("h"))).alias("words"))
    return found.join(bounded(items.select("item_id", "words")), "words").select("doc_id", "item_id", F.lit(1.0).alias("agreement"))


def contaminated(docs: DataFrame, benchmark: DataFrame, stretches: bool = False, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, item_id, n_hits and agreement (the best hit's share of equal words) of each document and item that overlap.

    With stretches, a hit's share is that of the best stretch of SPAN words or more around it, and short items count.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("h"))
    known = cut(windows(benchmark))
    # as many keys as a filter may hold: windows share their pairs, so there are no more of those than of hashes
    shards = max(1, math.ceil(known.select("hash").distinct().count() * PER_KEY / max_bits))
    parts = [known] if shards == 1 else [known.where(F.pmod("hash", F.lit(shards)) == i) for i in range(shards)]
    checked = reduce(DataFrame.unionByName, (_checked(rows, part, stretches) for part in parts))
    if stretches:
        short = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("words"))
        short = cut(short.where((F.size("words") > 0) & (F.size("words") < SPAN)).distinct().withColumn("key", _key(F.col("words"))))
        shards = max(1, math.ceil(short.count() * PER_KEY / max_bits))
        for i in range(shards):
            checked = checked.unionByName(_short(rows, short.where(F.pmod("key", F.lit(shards)) == i)))
    return checked.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.max("agreement").alias("agreement"))


def _checked(rows: DataFrame, known: DataFrame, stretches: bool) -> DataFrame:
    """doc_id, item_id, agreement of each hit of some of the benchmark's windows in rows(doc_id, h)."""
    pairs, hashes = Filter(known.select("pair")), Filter(known.select("hash"))

    def hit(h: Column, i: Column, m: int) -> Column:
        # no struct where the filter says no
        return let(_masked(h, i, m), lambda x: F.when(hashes.may_hold(x), F.struct(F.lit(m).alias("mask"), x.alias("hash"), i.alias("i"))))

    def hits(h: Column) -> Column:
        begun = F.filter(_starts(h), lambda i: pairs.may_hold(_pair(h, i)))
        return F.filter(F.flatten(F.transform(begun, lambda i: F.array(*(hit(h, i, m) for m in range(len(MASKS)))))), lambda x: x.isNotNull())

    found = rows.select("doc_id", "h", F.explode(hits(F.col("h"))).alias("x"))
    found = found.select("doc_id", F.col("x.mask").alias("mask"), F.col("x.hash").alias("hash"), F.least("x.i", F.lit(MARGIN)).alias("own_before"), _around(F.col("h"), F.col("x.i")).alias("own"))
    both = found.join(bounded(known.drop("pair")), ["mask", "hash"])
    same = F.transform("around", lambda w, t: F.coalesce(F.get("own", t - F.col("before") + F.col("own_before")) == w, F.lit(False)).cast("int"))
    both = both.select("doc_id", "item_id", "before", same.alias("same"))
    best = let(F.col("same"), lambda s: F.when(F.forall(s, lambda x: x == 1), 1.0).otherwise(_best(s, F.col("before"))))
    agreement = best if stretches else _share(F.col("same"))
    return both.select("doc_id", "item_id", agreement.alias("agreement")).where(F.col("agreement") >= AGREE)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    bad = bounded(cut(contaminated(docs, benchmark, stretches=True).select(F.col("doc_id").alias("__payloom_id")).distinct()))
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("__payloom_id"), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stretches=True)


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL: dict[str, str] = {}
