"""Mixing sources to target weights: hierarchical budgeting over a tree of domain, language and source.

A token budget flows down the tree. At each node it is shared among the children by weight; a child that cannot use its
share (a leaf can give its tokens once for each epoch allowed) takes what it can, and the rest goes to its siblings by
weight. Only what all children of a node together cannot use was never given to that node: it had gone to the node's own
siblings. So shortages are redistributed among siblings before ancestors.

A leaf's share is filled from seeded epochs: in each epoch its documents stand in the order of
md5(seed:epoch:doc_id), and the longest prefix of all epochs whose tokens fit the share is selected.

A leaf may hold a third of all rows, so its order is cut by the hash into buckets of about BUCKET_ROWS documents: sums
of buckets tell which are in whole and which one holds the cut, and only that one is put in order.

Defined cases: null source, lang or domain forms a leaf of its own (""), a null or empty text has no tokens and is
selected whenever its place in the order is before the cut; nodes without a stated weight get the weight default_weight;
weights must not be negative, and a weight of 0 gives nothing; an empty table gives an empty result; rows repeated with
one doc_id stand side by side in the order and count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, table

SEED = 17
#: Share of all tokens that the mixture has, and how often a document may be used at most.
BUDGET_SHARE, EPOCHS = 0.5, 2
#: Documents of a bucket, on average.
BUCKET_ROWS = 1000
DOMAINS = ("web", "code", "books", "wiki")
DOMAIN_WEIGHTS = {"web": 0.4, "code": 0.2, "books": 0.25, "wiki": 0.15}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def domain_of(source: Column) -> Column:
    """The domain of a source: by the last digit of its name; other names are web."""
    digit = F.coalesce(F.right(source, F.lit(1)).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*(F.lit(d) for d in DOMAINS)), F.pmod(digit, F.lit(len(DOMAINS))) + 1)


def token_count(text: Column) -> Column:
    """Words between spaces, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds share: nodes has the parents' columns, name, weight, capacity and budget, the parent's share."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy("__ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("__can").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = (
        nodes.withColumn("__can", F.when(F.col("weight") > 0, F.col("capacity").cast("double")).otherwise(F.lit(0.0)))
        .withColumn("__ratio", F.when(F.col("weight") > 0, F.col("__can") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("__level", F.when(F.sum("weight").over(rest) > 0, level))
        .withColumn("__open", F.max(F.when(F.col("__ratio") > F.col("__level"), F.col("__level"))).over(by))
    )
    share = F.when(F.col("__open").isNull(), F.col("__can")).otherwise(F.least("__can", F.greatest(F.lit(0.0), F.col("__open") * F.col("weight"))))
    return found.withColumn("share", share).drop("__can", "__ratio", "__level", "__open")


def weighted(nodes: DataFrame, name: str, weights: dict[str, float], default_weight: float) -> DataFrame:
    weight = F.lit(float(default_weight))
    for key, value in weights.items():
        weight = F.when(F.col(name) == key, F.lit(float(value))).otherwise(weight)
    return nodes.withColumn("weight", weight)


def budgets(leaves: DataFrame, budget: Column, epochs: int = EPOCHS, domain_weights=None, lang_weights=None, source_weights=None, default_weight: float = 1.0) -> DataFrame:
    """domain, lang, source, n_docs, n_tokens, capacity and share (tokens) of every leaf(domain, lang, source, n_docs, n_tokens)."""
    leaves = leaves.withColumn("capacity", F.col("n_tokens") * F.lit(epochs))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("n_tokens").alias("n_tokens"))
    domains = domains.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))  # a row for each domain
    domains = weighted(domains, "domain", domain_weights or {}, default_weight).withColumn("budget", budget)
    domains = shared(domains, [], "domain").select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = shared(weighted(langs, "lang", lang_weights or {}, default_weight), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    found = shared(weighted(leaves.join(langs, ["domain", "lang"]), "source", source_weights or {}, default_weight), ["domain", "lang"], "source")
    return found.select("domain", "lang", "source", "n_docs", "n_tokens", "capacity", "share")


#: What a use of a document is called while rows of any columns are carried with it.
_LEAF = ["__mix_domain", "__mix_lang", "__mix_source"]


def _order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("__mix_epoch"), F.coalesce(F.col("__mix_id"), F.lit(""))).cast("binary"))


def _named(docs: DataFrame, carried: Column) -> DataFrame:
    """The leaf, the id as text and the tokens of each row, and what is carried along."""
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    leaf = domain_of(name("source")), name("lang"), name("source")
    return docs.select(*(c.alias(n) for c, n in zip(leaf, _LEAF, strict=True)), F.col("doc_id").cast("string").alias("__mix_id"), token_count(F.col("text")).alias("__mix_tokens"), carried.alias("__mix_row"))


def _taken(narrow: DataFrame, wide: DataFrame, ties: list[Column], seed: int, budget_share: float, epochs: int, domain_weights, lang_weights, source_weights) -> DataFrame:
    """The rows of wide in the mixture, once for each use, with __mix_epoch. narrow: the same rows, cut; ties: what orders rows of one id."""
    public = ["domain", "lang", "source"]
    leaves = cut(narrow.groupBy(*_LEAF).agg(F.count("*").alias("n_docs"), F.sum("__mix_tokens").alias("n_tokens")))
    wanted = leaves.select(*(F.col(c).alias(n) for c, n in zip(_LEAF, public, strict=True)), "n_docs", "n_tokens")
    wanted = budgets(wanted, F.col("all_tokens") * F.lit(float(budget_share)), epochs, domain_weights or DOMAIN_WEIGHTS, lang_weights or LANG_WEIGHTS, source_weights)
    leaf = [F.col(n).alias(c) for c, n in zip(_LEAF, public, strict=True)]
    wanted = bounded(cut(wanted.select(*leaf, F.floor("share").alias("__mix_share"), F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("__mix_buckets"))))  # a row for each source

    def placed(rows: DataFrame) -> DataFrame:
        used = rows.join(wanted, _LEAF).withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        used = used.withColumn("__mix_order", _order(seed))
        part = F.conv(F.substring("__mix_order", 1, 8), 16, 10).cast("long")
        return used.withColumn("__mix_bucket", F.floor(part * F.col("__mix_buckets") / F.lit(float(1 << 32))))

    bucket = [*_LEAF, "__mix_epoch", "__mix_bucket"]
    sums = placed(narrow).groupBy(*bucket, "__mix_share").agg(F.sum("__mix_tokens").alias("in_bucket"))
    upto = Window.partitionBy(*_LEAF).orderBy("__mix_epoch", "__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__mix_left", F.col("__mix_share") - F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)))
    # a bucket counts if the prefix reaches it; it is whole if it fits
    sums = bounded(cut(sums.where("__mix_left >= 0").select(*bucket, "__mix_left", (F.col("in_bucket") <= F.col("__mix_left")).alias("__mix_whole"))))
    reached = placed(wide).join(sums, bucket)
    within = Window.partitionBy(*bucket).orderBy("__mix_order", "__mix_id", "__mix_tokens", *ties).rowsBetween(Window.unboundedPreceding, 0)
    some = reached.where(~F.col("__mix_whole")).withColumn("__mix_upto", F.sum("__mix_tokens").over(within)).where("__mix_upto <= __mix_left")
    return reached.where("__mix_whole").unionByName(some.drop("__mix_upto"))


def mix(docs: DataFrame, seed: int = SEED, budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS, domain_weights=None, lang_weights=None, source_weights=None) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens of every use of a document."""
    rows = cut(_named(docs, F.col("doc_id")))
    uses = _taken(rows, rows, [], seed, budget_share, epochs, domain_weights, lang_weights, source_weights)
    return uses.select(F.col("__mix_row").alias("doc_id"), *(F.col(c).alias(c.removeprefix("__mix_")) for c in [*_LEAF, "__mix_epoch"]), F.col("__mix_tokens").alias("n_tokens"))


def mixture(docs: DataFrame, seed: int = SEED, budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS, domain_weights=None, lang_weights=None, source_weights=None) -> DataFrame:
    """The rows of docs in the mixture, once for each use, with all their columns and mix_domain, mix_epoch, mix_tokens.

    Rows are carried along as they are and never joined back by doc_id: each of several rows with one doc_id, or with
    none, is taken or left by itself, the one of fewer tokens, then of the smaller text, first. Texts stay where they
    are, but for those of the one bucket of a leaf that holds its cut. Columns of docs with these three names are replaced.
    """
    docs = docs.drop("mix_domain", "mix_epoch", "mix_tokens")
    narrow = cut(_named(docs, F.lit(None).cast("string")))
    wide = _named(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    uses = _taken(narrow, wide, [F.col("__mix_row.text")], seed, budget_share, epochs, domain_weights, lang_weights, source_weights)
    own = [F.col(c).alias(n) for c, n in (("__mix_domain", "mix_domain"), ("__mix_epoch", "mix_epoch"), ("__mix_tokens", "mix_tokens"))]
    return uses.select("__mix_row.*", *own)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    case = lambda column, weights: f"case {' '.join(f"when {column} = '{k}' then {v}" for k, v in weights.items())} else 1.0 end"
    share = lambda by, name: f"""
  select *, case when opened is null then can else least(can, greatest(0.0, opened * weight)) end as share from (
    select *, max(case when ratio > level then level end) over (partition by {by}) as opened from (
      select *, case when sum(weight) over rest > 0 then (budget - coalesce(sum(can) over before, 0.0)) / sum(weight) over rest end as level
      from (select *, case when weight > 0 then capacity::double else 0.0 end as can, case when weight > 0 then capacity::double / weight else 'infinity'::double end as ratio from weighted)
      window before as (partition by {by} order by ratio, {name} rows between unbounded preceding and 1 preceding),
             rest as (partition by {by} order by ratio, {name} rows between current row and unbounded following)))"""  # noqa: E731
    return f"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         [{", ".join(f"'{d}'" for d in DOMAINS)}][coalesce(try_cast(right(coalesce(source, ''), 1) as integer), 0) % {len(DOMAINS)} + 1] as domain,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as n_tokens, sum(n_tokens)::bigint * {EPOCHS} as capacity from docs group by all),
domains as (with weighted as (
    select domain, sum(capacity) as capacity, {case("domain", DOMAIN_WEIGHTS)}::double as weight, (select sum(n_tokens) from leaves)::double * {BUDGET_SHARE} as budget from leaves group by domain)
  {share("1", "domain")}),
langs as (with weighted as (
    select l.domain, l.lang, sum(l.capacity) as capacity, {case("l.lang", LANG_WEIGHTS)}::double as weight, any_value(d.share) as budget from leaves l join domains d using (domain) group by l.domain, l.lang)
  {share("domain", "lang")}),
shares as (with weighted as (
    select l.domain, l.lang, l.source, l.capacity, 1.0::double as weight, g.share as budget from leaves l join langs g using (domain, lang))
  {share("domain, lang", "source")}),
uses as (
  select d.*, epoch::integer as epoch, floor(s.share) as share,
         sum(n_tokens) over (partition by d.domain, d.lang, d.source order by epoch, md5('{SEED}:' || epoch || ':' || coalesce(doc_id::varchar, '')), doc_id rows unbounded preceding) as upto
  from docs d join shares s using (domain, lang, source), range({EPOCHS}) e(epoch))
select doc_id, domain, lang, source, epoch, n_tokens from uses where upto <= share
"""


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL = {"op10_mixing": _oracle()}
