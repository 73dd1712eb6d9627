"""Personal data: fixed patterns, then information-theoretic sanitisation of the terms that reveal what they find.

Every address, number or mail address that recurs is a protected entity. From all documents it is estimated how much a
term of a document reveals of an entity in it: with IC(e) = log(N / docs with e), the disclosure of e by t is
PMI(e; t) / IC(e) = 1 + log(docs with both / docs with t) / IC(e): 1 if t occurs only with e, 0 if they are independent.
Terms stand anywhere in the document. Pairs seen in fewer than SUPPORT documents say nothing and are kept.

A term that discloses DISCLOSED or more of an entity is generalised in all documents with that entity: to its longest
beginning that another word shares which is common enough, so that the beginning discloses less (docs with both are
docs with e at most, and docs with the beginning are those with its commonest word at least). Where no beginning of
SHORTEST letters or more will do, the term is removed.

Entities that stand in the same documents are one class, so that a list of thousands of addresses, and its copies, make
one row a term and not thousands (two different sets of documents count as one with a chance of 2^-64).

All of it is DataFrame expressions. Patterns are possessive where that changes no match, so that long texts neither
recurse nor backtrack; work and memory are in proportion to a text's length.

Defined cases: a null text counts as empty (and stays null in sanitise()); an empty table gives an empty result; rows
repeated with one doc_id count as one document in the statistics, and each is returned; a row whose doc_id is null has
its fixed patterns found, and takes no part in the statistics; columns besides doc_id and text are ignored, and kept as
they are by sanitise(), except that n_chars follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, hot_from, joined_hot, let, located, prefixes, table

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Kind and expression, in the order in which spans that start together are listed.
PATTERNS = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: What a text must hold for a kind's expression to run.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
TERM = r"\p{L}{4,}"
SUPPORT, DISCLOSED = 3, 0.8
#: Letters of the beginnings to which terms are generalised.
SHORTEST, LONGEST = 3, 8
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": ""}
#: value: the entity of a fixed pattern; of a term, what it is replaced by.
SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string>>"
PLACES = "array<struct<start:bigint,end:bigint,term:string>>"
#: Characters of a text's parts in redacted().
PART = 4096


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    return F.lower(value) if kind == "email" else value if kind == "ip" else F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans, by start, then kind; value is the entity."""
    kinds = [F.when(_gate(kind, text), _spans(k, kind, pattern, text)).otherwise(F.array().cast(SPAN)) for k, (kind, pattern) in enumerate(PATTERNS)]
    return F.array_sort(F.coalesce(F.concat(*kinds), F.array().cast(SPAN)))


def _gate(kind: str, text: Column) -> Column:
    return text.contains(GATES[kind]) if kind == "email" else text.rlike(GATES[kind])


def _spans(k: int, kind: str, pattern: str, text: Column) -> Column:
    shaped = lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), _entity(kind, s["value"]).alias("value"))
    return F.transform(F.filter(located(text, pattern), lambda s: _valid(kind, s["value"])), shaped).cast(SPAN)


def places(text: Column) -> Column:
    """start, end and term (in lower case) of a text's words of four letters and more; the insides of mail addresses are no words."""
    pattern = PATTERNS[0][1]
    mail = text.contains("@")
    pieces = F.when(mail, F.split(text, pattern, -1)).otherwise(F.array(text))
    hits = F.when(mail, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def words(s: Column) -> Column:
        steps = F.transform(s["pieces"], lambda x, i: (F.length(x) + F.coalesce(F.length(F.get(s["hits"], i)), F.lit(0))).cast("long"))

        def of_piece(x: Column, at: Column) -> Column:
            return F.transform(located(x, TERM), lambda t: F.struct((t["start"] + at).alias("start"), (t["end"] + at).alias("end"), F.lower(t["value"]).alias("term")))

        return prefixes(steps, lambda before: F.flatten(F.transform(s["pieces"], lambda x, i: let(before(i), lambda at: of_piece(x, at)))))

    return let(F.struct(pieces.alias("pieces"), hits.alias("hits")), words).cast(PLACES)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), spans, and places where there are spans, of every row."""
    none = F.array().cast(PLACES)
    both = let(base_spans(F.col("text")), lambda s: F.struct(s.alias("spans"), F.when(F.size(s) > 0, places(F.col("text"))).otherwise(none).alias("places")))
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), both.alias("b")).select("doc_id", "h", "b.spans", "b.places"))


def protected(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and class of the entities that recur; class and with_entity (documents)."""
    entities = found.where("doc_id is not null and size(spans) > 0").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.value").distinct()
    documents = F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), F.col("doc_id"))).alias("b")
    known = entities.groupBy("kind", "value").agg(*documents).where(F.col("n") >= SUPPORT)
    known = cut(known.select("kind", "value", "n", F.xxhash64("n", "a", "b").alias("class")))
    return joined_hot(entities, known, ["kind", "value"], hot_from(known)).select("doc_id", "class").distinct(), known.select("class", F.col("n").alias("with_entity")).distinct()


def _beginnings(term: Column, most: Column) -> Column:
    """Of SHORTEST to LONGEST letters, and `most` at most; NULL where there are none."""
    return F.when(most >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(most, F.lit(LONGEST))), lambda n: F.substring(term, F.lit(1), n)))


def disclosures(docs: DataFrame, pairs: DataFrame, classes: DataFrame, support: int = SUPPORT) -> DataFrame | None:
    """class, term, n (documents with both), disclosure, kind and value (what the term becomes) of the pairs that disclose enough.

    pairs: doc_id, class, term, each once. Counts are of documents and cover all of them.
    """
    both = cut(pairs.groupBy("class", "term").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    if both.isEmpty():
        return None
    named = docs.where("doc_id is not null")
    words = named.select(F.col("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    if named.select("doc_id").distinct().count() < named.count():
        words = words.distinct()
    vocabulary = cut(words.groupBy("term").agg(F.count("*").alias("with_term")))
    total = docs.select("doc_id").where("doc_id is not null").distinct().count()
    content = F.log(F.lit(float(total)) / F.col("with_entity"))
    share = lambda a, b: F.log(F.least(F.lit(1.0), F.col(a) / F.col(b)))
    known = both.join(bounded(cut(classes.where(F.col("with_entity") < total))), "class").join(vocabulary, "term")
    known = cut(known.withColumn("disclosure", 1 + share("n", "with_term") / content).where(F.col("disclosure") >= DISCLOSED))
    wanted = known.select("class", "term", "with_entity", F.explode(_beginnings(F.col("term"), F.length("term") - 1)).alias("start"))
    starts = vocabulary.select("with_term", F.explode(_beginnings(F.col("term"), F.length("term"))).alias("start"))
    common = starts.join(bounded(cut(wanted.select("start").distinct())), "start").groupBy("start").agg(F.max("with_term").alias("with_start"))
    less = wanted.join(common, "start").where(1 + share("with_entity", "with_start") / content < DISCLOSED)
    less = less.groupBy("class", "term").agg(F.max(F.struct(F.length("start").alias("n"), "start"))["start"].alias("start"))
    general = F.col("start").isNotNull()
    found = known.join(less, ["class", "term"], "left")
    return cut(found.select("class", "term", "n", "disclosure", F.when(general, "general").otherwise("removed").alias("kind"), F.when(general, F.concat(F.lit("["), "start", F.lit("*]"))).otherwise("").alias("value")))


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """doc_id, h and terms (spans) of the documents whose terms disclose an entity in them; None if there are none."""
    of, classes = protected(found)
    held = found.where("doc_id is not null and size(places) > 0")
    terms = held.select("doc_id", F.array_distinct(F.transform("places", lambda p: p["term"])).alias("terms"))
    pairs = cut(terms.join(of, "doc_id").select("doc_id", "class", F.explode("terms").alias("term")).distinct())
    told = disclosures(docs, pairs, classes)
    if told is None or told.isEmpty():
        return None
    hits = joined_hot(pairs, told, ["class", "term"], hot_from(told))
    # what two entities ask for: to be removed goes before a beginning, a shorter beginning before a longer one
    first = F.min(F.struct(F.length("value").alias("n"), "value", "kind")).alias("x")
    hits = hits.groupBy("doc_id", "term").agg(first).select("doc_id", "term", "x.kind", "x.value")
    spots = held.select("doc_id", "h", F.explode("places").alias("p")).select("doc_id", "h", "p.start", "p.end", "p.term").distinct()
    span = F.struct("start", F.lit(len(PATTERNS)).alias("ord"), "end", "kind", "value")
    return spots.join(hits, ["doc_id", "term"]).groupBy("doc_id", "h").agg(F.collect_list(span).cast(SPAN).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs(doc_id, text)."""
    found = found_in(docs)
    terms = revealing(docs, found)
    every = F.col("spans")
    if terms is not None:
        found = found.join(terms, ["doc_id", "h"], "left")
        every = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(SPAN))))
    counts = [_count(kind).alias(f"n_{kind}") for kind, _ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(every).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's label or value."""
    label = lambda s: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), s["kind"]), s["value"])

    def gap(parts: Column, a: Column, b: Column) -> Column:
        """Characters from a to b, of the parts that hold them."""
        x, y = F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")
        cut_ = lambda i, at, n: F.substring(F.get(parts, i), (at % PART + 1).cast("int"), n.cast("int"))
        across = F.concat(cut_(x, a, F.lit(PART)), F.array_join(F.slice(parts, x + 2, y - x - 1), ""), cut_(y, F.lit(0), b - y * PART))
        return F.when(b <= a, "").when(x == y, cut_(x, a, b - a)).otherwise(across)

    def put(parts: Column, held: Column) -> Column:
        ends = F.transform(held, lambda s: s["end"])

        def one(before):
            # `done`: where the spans before this one end
            return lambda s, i: let(before(i), lambda done: F.when(s["start"] < done, "").otherwise(F.concat(gap(parts, done, s["start"]), label(s))))

        return prefixes(ends, lambda before: F.concat(F.array_join(F.transform(held, one(before)), ""), gap(parts, F.array_max(ends), F.length(text).cast("long"))), maximum=True)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda parts: let(spans, lambda held: put(parts, held)))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and revealing terms replaced, and all their columns.

    Only documents with personal data meet the terms found for them; the others' texts stay where they are.
    """
    terms = revealing(docs, found_in(docs))
    spans, names = "__payloom_spans", docs.columns
    marked = docs.withColumn(spans, base_spans(F.col("text")))
    if terms is not None:
        terms = bounded(cut(terms.select(F.col("doc_id").alias("__payloom_id"), F.col("h").alias("__payloom_h"), F.col("terms").alias("__payloom_terms"))))
        same = (F.col("doc_id").cast("long") == F.col("__payloom_id")) & (F.xxhash64("text") == F.col("__payloom_h"))
        touched = marked.where(F.size(spans) > 0).join(terms, same, "left")
        touched = touched.withColumn(spans, F.array_sort(F.concat(spans, F.coalesce("__payloom_terms", F.array().cast(SPAN)))))
        marked = marked.where(F.size(spans) == 0).unionByName(touched.select(*names, spans))
    changed = F.size(spans) > 0
    marked = marked.withColumn("text", F.when(changed, redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in names:
        marked = marked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return marked.select(*names)


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLE_SQL: dict[str, str] = {}
