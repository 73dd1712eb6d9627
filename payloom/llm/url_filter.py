"""URL filters: host and path rules, then a Bloom filter cascade over a blocklist of domains.

The cascade alternates: odd levels encode listed keys, even levels encode keys of the corpus that the level above lets
through although they are not listed, and so on until a level lets nothing wrong through. Over the keys it was built
for, which are the listed ones and all domain suffixes of all hosts of the corpus, membership is exact, and probing needs
no join. A list whose cascade would take more than MAX_BITS is dealt by hash into shards with a cascade each, and the
pages pass once for each shard.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; an empty table
gives an empty result; repeated rows are judged one by one; other columns of the table are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let, table

#: (verdict, rule); a rule is host/path-prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The query's list stands for one that comes from outside: domains of the corpus whose hash under SEED begins with one of these
#: digits are blocked with their subdomains where no rule fits. It has no others, and grows with the corpus.
SEED, PICKED = "blocked:", "01"
#: Largest cascade, in bits over all its levels, that is put into the plan (2 MiB).
MAX_BITS = 1 << 24
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """a.b.c: a.b.c, b.c, c; an empty host has none."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(F.length(host) > 0, F.filter(every, lambda k: F.length(k) > 0)).otherwise(F.array().cast("array<string>"))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # a later, longer rule overrides
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    size = F.lit(bits).cast("long")
    one, two = F.pmod(F.xxhash64(key, F.lit(number)), size), F.pmod(F.xxhash64(F.lit(-1 - number), key), size)
    return [F.pmod(one + two * i, size) for i in range(hashes)]


def _build(keys: DataFrame, number: int, count: int, p: float) -> Level:
    hashes = max(1, round(math.log2(1 / p)))
    bits = 64 * max(1, math.ceil(count * math.log2(1 / p) / math.log(2) / 64))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    words = spots.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    held = [0] * (bits // 64)
    for row in words.collect():  # at most bits / 64 rows, and bits is bounded by MAX_BITS
        held[row["word"]] = row["mask"]
    return Level(number, bits, hashes, tuple(held))


def _holds(level: Level, key: Column) -> Column:
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")  # folded to a literal

    def found(held: Column) -> Column:
        at_all = F.lit(True)
        for at in _positions(key, level.number, level.bits, level.hashes):
            at_all = at_all & (F.get(held, F.floor(at / 64).cast("int")).bitwiseAND(_bit(at)) != 0)
        return at_all

    return let(words, found)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def _first_rate(n: int, rest: int) -> float:
    """How many keys that are not listed the first level lets through: so many that the level below takes no more bits than this one saves."""
    return min(0.5, max(1e-6, n * math.sqrt(0.5) / max(1, rest)))


def bits_needed(n: int, rest: int) -> int:
    """About as many bits as the levels for n listed keys take, when there are `rest` others."""
    return math.ceil(n * (math.log2(1 / _first_rate(n, rest)) / math.log(2) + 4)) if n else 0


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the column key of both tables.

    Keys of either may be asked for. Null keys are in neither set.
    """
    listed = cut(listed.where("key is not null").select("key").distinct())
    outside = universe.where("key is not null").select("key").distinct().join(listed, "key", "left_anti")
    sets = cut(listed.withColumn("in", F.lit(True)).unionByName(outside.withColumn("in", F.lit(False))))
    size = {r["in"]: r["n"] for r in sets.groupBy("in").agg(F.count("*").alias("n")).collect()}
    count, p = size.get(True, 0), _first_rate(size.get(True, 0), size.get(False, 0))
    levels: list[Level] = []
    keys = sets.where("in").select("key")
    while count:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade did not come to an end")
        levels.append(_build(keys, len(levels), count, p))
        # keys of the other set that all levels let through: the last level's are a subset of those of the one before the last
        through = F.lit(True)
        for level in levels:
            through = through & _holds(level, F.col("key"))
        keys = sets.where(F.col("in") if len(levels) % 2 == 0 else ~F.col("in")).where(through).select("key")
        count, p = keys.count(), 0.5
    return levels


def contains(levels: list[Level], key: Column) -> Column:
    """Whether key, one of the universe, is listed: decided by the first level that does not hold it."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(_holds(level, key), answer).otherwise(F.lit(level.number % 2 == 1))
    return answer


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row of pages(page_id, url); listed(key) are blocked domains."""
    marked = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.lit(False).alias("listed"))
    universe = cut(marked.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct())
    keys = cut(listed.where("key is not null").select(ascii_lower(F.col("key")).alias("key")).distinct())
    shards = max(1, math.ceil(bits_needed(keys.count(), universe.count()) / max_bits))
    shard = lambda key: F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))
    for i in range(shards):
        mine = F.lit(i) == shard(F.col("key"))
        levels = cascade(keys.where(mine), universe.where(mine))
        hit = F.exists(suffixes(F.col("host")), lambda k: (shard(k) == i) & contains(levels, k))  # noqa: B023  used in this round
        marked = marked.withColumn("listed", F.col("listed") | hit)
        if i < shards - 1:
            marked = cut(marked)  # so that the next round's plan does not hold this one's levels
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "listed")


def blocklist(pages: DataFrame, seed: str = SEED, picked: str = PICKED) -> DataFrame:
    """key of the domains of pages(url) that are picked; names without a dot are no domains."""
    keys = pages.select(url_host(F.col("url")).alias("host")).distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    return keys.where(F.col("key").contains(".") & F.substring(F.sha2(F.concat(F.lit(seed), "key"), 256), 1, 1).isin(*picked))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, blocklist(pages))


def _oracle() -> str:
    texts = lambda some: ", ".join(f"'{x}'" for x in some)
    fit = []
    for says, text in RULES:
        name, slash, rest = text.partition("/")
        fit.append(f"select '{text}' as rule, '{says}' as says, '{name}' as name, '{slash + rest}' as prefix")
    return f"""
with parsed as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules as ({" union all ".join(fit)}),
labels as (select distinct string_split(host, '.') as l from parsed where host <> ''),
keys as (select distinct array_to_string(l[i:], '.') as key from labels, range(1, 200) r(i) where i <= len(l)),
blocked as (select key from keys where contains(key, '.') and substr(sha256('{SEED}' || key), 1, 1) in ({texts(PICKED)})),
judged as (
  select p.*, (select r.rule from rules r where (p.host = r.name or ends_with(p.host, '.' || r.name)) and starts_with(p.path, r.prefix)
               order by length(r.rule) desc limit 1) as rule,
         exists (select 1 from blocked b where p.host = b.key or ends_with(p.host, '.' || b.key)) as listed
  from parsed p)
select j.page_id, j.host, j.path, j.rule, coalesce(r.says, case when j.listed then 'block' else 'allow' end) as verdict, j.listed
from judged j left join rules r on r.rule = j.rule
"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL = {"op1_url_filter": _oracle()}
