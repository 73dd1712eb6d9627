"""Registered queries of the engine, each with the same answer in SQL over the tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .functions.columns import at_pointer, elements, json_type, member, members, spread
from .functions.names import binding_status_col, is_url_col, is_version_col, join_url_col, map_prefix_col, reverse_labels_col, url_path_col
from .model import ResolveOptions
from .operators import bundle
from .operators import capabilities as graph
from .operators import corpus as corpus_of
from .operators import lint
from .operators.validate import Tables, direction_of, error_rows, exit_codes, validate, validate_by_capabilities, verdict_json, violation_summary, with_verdict
from .plans.compose import compose, parse_capabilities
from .plans.resolve import resolve
from .sources.documents import Documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
READ, CREATE = ResolveOptions("response", "read"), ResolveOptions("request", "create")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, values: list) -> DataFrame:
    return spark.createDataFrame(values, schema)


# Sources and projections.


@query("""select event_type, count(*) filter (json_valid(p))::bigint as n_valid, count(*) filter (not json_valid(p))::bigint as n_invalid
from (select event_type, case when event_id % 7 = 0 then substr(props, 1, length(props) - 1) else props end as p from events) group by event_type""")
def scan_wellformed(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    v = F.try_parse_json(text).isNotNull()
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(v).alias("n_valid"), F.count_if(~v).alias("n_invalid"))


@query("""select case role when 'user' then 'request' when 'assistant' then 'response' else 'none' end as direction, count(*)::bigint as n from conversations group by 1""")
def detect_direction(spark, sf_dir):
    about = f'{{"{samples.ENVELOPE}": '
    envelope = F.when(F.col("role") == "user", '{"meta": {"profile": null}}').when(F.col("role") == "assistant", about + '{"capabilities": {}}}').otherwise(about + '{"meta": {"profile": 1}}}')
    found = table(spark, sf_dir, "conversations").select(F.coalesce(direction_of(F.try_parse_json(envelope)), F.lit("none")).alias("direction"))
    return found.groupBy("direction").agg(F.count("*").alias("n"))


def _capability_payloads(spark, sf_dir) -> DataFrame:
    """Orders whose payloads declare a root, and extensions by status."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    old = F.lit('}, {"version": "1900-01-01", "schema": "https://example.com/old.json"}]')  # only the first one counts
    entry = lambda extends: F.concat(F.lit('[{"version": "'), day, F.lit('", "schema": "https://example.com/s.json"'), F.lit(extends), old)
    ext = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit(', "com.example.b": '), entry(', "extends": "com.example.a"'))).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit(', "com.example.c": '), entry(', "extends": ["com.example.a", "com.example.x"]'))
    )
    text = F.concat(F.lit(f'{{"{samples.ENVELOPE}": {{"capabilities": {{"com.example.a": '), entry(""), F.coalesce(ext, F.lit("")), F.lit("}}}"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("payload_id"), F.parse_json(text).alias("v"))


_CAPABILITIES = """
caps as (
  select o_orderkey as payload_id, 'com.example.a' as name, strftime(o_orderdate, '%Y-%m-%d') as version, [] as parents, true as is_root from orders
  union all select o_orderkey, 'com.example.b', strftime(o_orderdate, '%Y-%m-%d'), ['com.example.a'], false from orders where o_orderstatus = 'P'
  union all select o_orderkey, 'com.example.c', strftime(o_orderdate, '%Y-%m-%d'), ['com.example.a', 'com.example.x'], false from orders where o_orderstatus = 'F')"""


@query(f"with {_CAPABILITIES} select name, min(version) as first_version, count(*)::bigint as n, sum(len(parents))::bigint as n_parents from caps group by name")
def extract_capabilities(spark, sf_dir):
    caps = graph.capability_rows(_capability_payloads(spark, sf_dir), "payload_id", F.col("v")).where("fault is null")
    return caps.groupBy("name").agg(F.min("version").alias("first_version"), F.count("*").alias("n"), F.sum(F.coalesce(F.size("extends"), F.lit(0))).alias("n_parents"))


@query("select o_orderstatus as status, count(*)::bigint as n, sum(o_orderkey)::bigint as ids from orders group by 1")
def jsonrpc_unwrap(spark, sf_dir):
    body = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("order"), F.lit("x").alias("other")))
    found = graph.unwrapped(table(spark, sf_dir, "orders").select(F.parse_json(body).alias("v")), F.col("v"), F.lit(samples.ROOT))
    return found.groupBy(F.try_variant_get("body", "$.status", "string").alias("status")).agg(F.count("*").alias("n"), F.sum(F.try_variant_get("body", "$.id", "bigint")).alias("ids"))


@query("select json_extract_string(props, '$.k')::bigint as k, count(*)::bigint as n from events group by 1")
def pointer_navigate(spark, sf_dir):
    v = member(F.try_parse_json("props"), "k")
    return table(spark, sf_dir, "events").groupBy(F.try_variant_get(v, "$", "bigint").alias("k")).agg(F.count("*").alias("n"))


@query("select k::bigint as k, count(*)::bigint as n from (select json_extract_string(props, '$.k') as k from events) group by 1")
def pointer_escapes(spark, sf_dir):
    v = F.try_parse_json(F.concat(F.lit('{"a/b": {"~x": {"deep": ['), F.col("props"), F.lit(']}, "c": 1}, "a": {"b": 2}}')))
    found = F.get(elements(at_pointer(v, "/a~1b/~0x/deep")), F.lit(0))
    return table(spark, sf_dir, "events").groupBy(F.try_variant_get(found, "$.k", "bigint").alias("k")).agg(F.count("*").alias("n"))


@query("""select kind, (count(*) * times)::bigint as n from events, (values ('number', 2), ('object', 2), ('string', 1), ('null', 1), ('boolean', 1), ('array', 1)) k(kind, times) group by kind, times""")
def json_types(spark, sf_dir):
    v = F.try_parse_json(F.concat(F.lit('["x", null, true, [1], 2.5, {}, '), F.col("props"), F.lit("]")))
    kinds = F.flatten(F.transform(elements(v), lambda x: F.concat(F.array(json_type(x)), F.coalesce(F.transform(F.map_values(members(x)), json_type), F.array().cast("array<string>")))))
    return table(spark, sf_dir, "events").select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# Graphs, versions, names.


def _places(spark, sf_dir) -> DataFrame:
    """A graph for each region: nations under it, some of them under nothing known, and customers under their nations."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("g"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("name"), F.lit(None).cast("array<string>").alias("extends"))
    up = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("gone"))).otherwise(F.array(F.concat(F.lit("r"), F.col("n_regionkey"))))
    nations = nation.select(F.col("n_regionkey").alias("g"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), up.alias("extends"))
    customers = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(F.col("n_regionkey").alias("g"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"), F.array(F.concat(F.lit("n"), F.col("n_nationkey"))).alias("extends"))
    return region.unionByName(nations).unionByName(customers)


_PLACES = """
places as (
  select r_regionkey as g, 'r' || r_regionkey as name, null as parent from region
  union all select n_regionkey, 'n' || n_nationkey, case when n_nationkey % 5 = 0 then 'gone' else 'r' || n_regionkey end from nation
  union all select n_regionkey, 'c' || c_custkey, 'n' || n_nationkey from customer join nation on c_nationkey = n_nationkey)"""


@query(f"""with recursive {_PLACES},
reached as (select g, name from places where parent is null union select p.g, p.name from places p join reached r on p.g = r.g and p.parent = r.name)
select g, count(*)::bigint as n_orphans from places p where not exists (select 1 from reached r where r.g = p.g and r.name = p.name) group by g""")
def graph_reaches_root(spark, sf_dir):
    return graph.orphans(_places(spark, sf_dir), "g").groupBy("g").agg(F.count("*").alias("n_orphans"))


@query(f"with {_PLACES} select g, name, parent from places p where parent is not null and not exists (select 1 from places q where q.g = p.g and q.name = p.parent)")
def graph_unknown_parent(spark, sf_dir):
    return graph.unknown_parents(_places(spark, sf_dir), "g")


@query("""select status, count(*)::bigint as n from (
  select o_custkey, case count(*) filter (o_orderstatus = 'F') when 0 then 'none' when 1 then 'ok' else 'many' end as status from orders group by 1) group by 1""")
def graph_root_count(spark, sf_dir):
    caps = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") != "F", F.array(F.lit("x"))).alias("extends"))
    return graph.roots(caps, "o_custkey").groupBy("status").agg(F.count("*").alias("n"))


_VERSION = "case when o_orderkey % 10 = 0 then strftime(o_orderdate, '%Y-13-%d') when o_orderkey % 10 = 1 then strftime(o_orderdate, '%Y-%m-%d') || 'x' else strftime(o_orderdate, '%Y-%m-%d') end"


@query(f"select regexp_full_match({_VERSION}, '[0-9]{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') as ok, count(*)::bigint as n from orders group by 1")
def version_format(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    version = F.when(F.col("o_orderkey") % 10 == 0, F.date_format("o_orderdate", "yyyy-'13'-dd")).when(F.col("o_orderkey") % 10 == 1, F.concat(day, F.lit("x"))).otherwise(day)
    return table(spark, sf_dir, "orders").groupBy(is_version_col(version).alias("ok")).agg(F.count("*").alias("n"))


@query(f"""with {_CAPABILITIES},
demands as (select * from (values ('com.example.b', 'protocol', '1995-01-01', null), ('com.example.b', 'com.example.a', '1993-06-01', '1996-06-01'), ('com.example.c', 'com.example.none', '2030-01-01', null)) d(extension, target, least, most))
select c.payload_id, d.extension, d.target, d.least, d.most, a.version as actual
from caps c join demands d on c.name = d.extension join caps a on a.payload_id = c.payload_id and (a.name = d.target or d.target = 'protocol' and a.is_root)
where not c.is_root and (a.version < d.least or a.version > d.most)""")
def version_range_violations(spark, sf_dir):
    demands = rows(spark, "extension string, target string, least string, most string", [("com.example.b", "protocol", "1995-01-01", None), ("com.example.b", "com.example.a", "1993-06-01", "1996-06-01"), ("com.example.c", "com.example.none", "2030-01-01", None)])
    caps = graph.capability_rows(_capability_payloads(spark, sf_dir), "payload_id", F.col("v"))
    return graph.version_violations(caps, demands, "payload_id")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"""select case when not starts_with(url, 'https') then 'NonHttpsScheme' when page_id % 5 = 0 then 'Userinfo' when page_id % 5 = 1 then 'NonDomainHost'
  when page_id % 5 = 2 or {_HOST} not like '%.example.com' then 'AuthorityMismatch' else 'ok' end as status, count(*)::bigint as n from pages group by 1""")
def namespace_binding(spark, sf_dir):
    five = F.col("page_id") % 5
    url = F.when(five == 0, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).when(five == 1, F.regexp_replace("url", "://[^/?#]*", "://127.0.0.1")).otherwise(F.col("url"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    name = F.when(five == 2, F.concat(F.lit("x."), reverse_labels_col(host))).otherwise(F.concat(F.replace(F.replace(reverse_labels_col(host), F.lit("org"), F.lit("com")), F.lit("net"), F.lit("com")), F.lit(".cap")))
    return table(spark, sf_dir, "pages").groupBy(binding_status_col(name, url).alias("status")).agg(F.count("*").alias("n"))


#: Hosts, and what they are in ASCII; None for what is no host.
_HOSTS = (("faß.example", "xn--fa-hia.example"), ("ΒΌΛΟΣ.example", "xn--nxasmq6b.example"), ("βόλος.example", "xn--nxasmm1c.example"), ("BÜCHER。example", "xn--bcher-kva.example"), ("a\u200db.example", None), ("x%C2%ADy.example", "xy.example"))


@query("select page_id, [" + ", ".join(f"'{'ok' if a else 'Unparsable'}'" for _, a in _HOSTS) + f"][page_id % {len(_HOSTS)} + 1] as status from pages")
def binding_of_international_hosts(spark, sf_dir):
    """Names under the reversed host, of hosts beyond ASCII as UTS 46 reads them."""
    of = lambda texts: samples.by_number(F.col("page_id"), texts)
    name = F.concat(of([".".join(reversed((a or "a.example").split("."))) for _, a in _HOSTS]), F.lit(".a"))
    url = F.concat(F.lit("https://"), of([h for h, _ in _HOSTS]), F.lit("/x"))
    return table(spark, sf_dir, "pages").select("page_id", binding_status_col(name, url).alias("status"))


@query(f"select page_id, array_to_string(list_reverse(string_split({_HOST}, '.')), '.') as reversed from pages")
def reverse_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", reverse_labels_col(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("reversed"))


@query("select page_id, nullif(regexp_extract(url, '^https?://[^/]*(/.*)$', 1), '') as path, starts_with(url, 'http') as is_url from pages")
def url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url_path_col(F.col("url")).alias("path"), is_url_col(F.col("url")).alias("is_url"))


@query("select page_id, '/local/' || case when starts_with(url, 'https://') then substr(url, 9) else url end as local from pages")
def url_prefix_map(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", map_prefix_col(F.col("url"), "/local", "https://").alias("local"))


@query("select page_id, case when page_id % 2 = 0 then 'http://other.example/x' else regexp_replace(url, '[^/]*$', '') || 'd.json' end as joined from pages")
def url_join(spark, sf_dir):
    ref = F.when(F.col("page_id") % 2 == 0, "http://other.example/x").otherwise("d.json")
    return table(spark, sf_dir, "pages").select("page_id", join_url_col(ref, F.col("url")).alias("joined"))


# Validation.


def _errors(spark, sf_dir, plain, *extra) -> DataFrame:
    payloads = samples.orders(spark, sf_dir, *extra)
    return error_rows(with_verdict(payloads, F.try_parse_json("payload"), plain), "payload_id").select("payload_id", "path", "keyword")


def _property(name: str, schema) -> dict:
    return {"type": "object", "properties": {name: schema}}


def keyword_query(name: str, plain: dict, sql: str, *extra) -> None:
    def run(spark, sf_dir):
        return _errors(spark, sf_dir, plain, *(make() for make in extra))

    run.__name__ = f"validate_{name}"
    query(sql)(run)


_NOT_P = "o_orderstatus <> 'P'"
_AT = "select o_orderkey as payload_id, '{path}' as path, '{keyword}' as keyword from orders where {where}"


def _due():
    """A member that only some orders have."""
    return F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("due")


keyword_query("required", {"required": ["number", "due"]}, _AT.format(path="", keyword="required", where="o_orderstatus <> 'P'"), _due)
keyword_query("type", _property("amount", {"type": "integer"}), _AT.format(path="/amount", keyword="type", where="o_totalprice <> floor(o_totalprice)"))
keyword_query("enum", _property("state", {"enum": ["P", "F", 3]}), _AT.format(path="/state", keyword="enum", where="o_orderstatus not in ('P', 'F')"))
keyword_query("const", _property("state", {"const": "P"}), _AT.format(path="/state", keyword="const", where="o_orderstatus <> 'P'"))
keyword_query("minimum", _property("amount", {"minimum": 100000}), _AT.format(path="/amount", keyword="minimum", where="o_totalprice < 100000"))
keyword_query("maximum", _property("amount", {"exclusiveMaximum": 300000.5}), _AT.format(path="/amount", keyword="exclusiveMaximum", where="o_totalprice >= 300000.5"))
keyword_query("pattern", _property("urgency", {"pattern": "^[12]-"}), _AT.format(path="/urgency", keyword="pattern", where="not regexp_matches(o_orderpriority, '^[12]-')"))
keyword_query("minlength", _property("number", {"minLength": 4}), _AT.format(path="/number", keyword="minLength", where="length(o_orderkey::varchar) < 4"))
keyword_query("strict_unknown", {"properties": {k: True for k in ("number", "state", "urgency", "amount", "lines")}, "additionalProperties": False}, _AT.format(path="", keyword="additionalProperties", where="o_orderstatus = 'P'"), _due)
keyword_query(
    "unevaluated",
    {"allOf": [{"properties": {"number": True, "state": {"const": "P"}, "urgency": True}}, {"properties": {"amount": True, "lines": True, "due": True}}], "unevaluatedProperties": False},
    # a branch that fails evaluates nothing
    _AT.format(path="/state", keyword="const", where="o_orderstatus <> 'P'") + " union all " + _AT.format(path="", keyword="unevaluatedProperties", where="o_orderstatus <> 'P'"),
    _due,
)
keyword_query("anyof", {"anyOf": [_property("state", {"const": "P"}), _property("amount", {"minimum": 150000})]}, _AT.format(path="", keyword="anyOf", where="o_orderstatus <> 'P' and o_totalprice < 150000"))
keyword_query("oneof", {"oneOf": [_property("state", {"const": "P"}), _property("amount", {"minimum": 150000})]}, _AT.format(path="", keyword="oneOf", where="(o_orderstatus = 'P') = (o_totalprice >= 150000)"))
keyword_query(
    "allof",
    {"allOf": [_property("state", {"const": "P"}), _property("amount", {"minimum": 150000})]},
    _AT.format(path="/state", keyword="const", where="o_orderstatus <> 'P'") + " union all " + _AT.format(path="/amount", keyword="minimum", where="o_totalprice < 150000"),
)
keyword_query("not", {"not": _property("state", {"const": "P"})}, _AT.format(path="", keyword="not", where="o_orderstatus = 'P'"))
keyword_query(
    "if",
    {"if": _property("state", {"const": "P"}), "then": _property("amount", {"minimum": 150000}), "else": _property("amount", {"maximum": 250000})},
    _AT.format(path="/amount", keyword="minimum", where="o_orderstatus = 'P' and o_totalprice < 150000") + " union all " + _AT.format(path="/amount", keyword="maximum", where="o_orderstatus <> 'P' and o_totalprice > 250000"),
)
_LINES = "select l_orderkey as payload_id, '/lines/' || (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar, l_quantity, l_extendedprice) - 1) || '/{name}' as path, '{keyword}' as keyword, {bad} as bad from lineitem"
keyword_query(
    "items_paths",
    _property("lines", {"items": _property("units", {"minimum": 5})}),
    f"select payload_id, path, keyword from ({_LINES.format(name='units', keyword='minimum', bad='l_quantity < 5')}) where bad and payload_id in (select o_orderkey from orders)",
)
keyword_query("min_items", _property("lines", {"minItems": 4}), "select l_orderkey as payload_id, '/lines' as path, 'minItems' as keyword from lineitem where l_orderkey in (select o_orderkey from orders) group by 1 having count(*) < 4")


keyword_query("exclusive_minimum", _property("amount", {"exclusiveMinimum": 100000.5}), _AT.format(path="/amount", keyword="exclusiveMinimum", where="o_totalprice <= 100000.5"))
keyword_query("multiple_of", _property("due", {"multipleOf": 3}), _AT.format(path="/due", keyword="multipleOf", where="o_orderstatus = 'P' and o_orderkey % 3 <> 0"), _due)
keyword_query("maxlength", _property("urgency", {"maxLength": 5}), _AT.format(path="/urgency", keyword="maxLength", where="length(o_orderpriority) > 5"))
keyword_query("max_items", _property("lines", {"maxItems": 4}), "select l_orderkey as payload_id, '/lines' as path, 'maxItems' as keyword from lineitem where l_orderkey in (select o_orderkey from orders) group by 1 having count(*) > 4")


def _tags():
    return F.array(F.col("o_orderstatus"), F.lit("P"), F.lit("x")).alias("tags")


def _pair():
    return F.array(F.col("o_orderstatus"), F.lit("P")).alias("pair")


_LINED = "o_orderkey in (select l_orderkey from lineitem)"
keyword_query("unique_items", _property("tags", {"uniqueItems": True}), _AT.format(path="/tags", keyword="uniqueItems", where="o_orderstatus = 'P'"), _tags)
keyword_query("contains", _property("tags", {"contains": {"const": "F"}}), _AT.format(path="/tags", keyword="contains", where="o_orderstatus <> 'F'"), _tags)
keyword_query(
    "contains_counted",
    _property("lines", {"contains": _property("units", {"minimum": 25}), "minContains": 2, "maxContains": 3}),
    "select l_orderkey as payload_id, '/lines' as path, 'contains' as keyword from lineitem where l_orderkey in (select o_orderkey from orders) group by 1 having count(*) filter (l_quantity::int >= 25) not between 2 and 3",
)
keyword_query("prefix_items", _property("tags", {"prefixItems": [{"const": "P"}, True], "items": {"const": "x"}}), _AT.format(path="/tags/0", keyword="const", where="o_orderstatus <> 'P'"), _tags)
keyword_query("unevaluated_items", _property("pair", {"contains": {"const": "P"}, "unevaluatedItems": False}), _AT.format(path="/pair", keyword="unevaluatedItems", where="o_orderstatus <> 'P'"), _pair)
_N_MEMBERS = f"(4 + ({_LINED})::int + (o_orderstatus = 'P')::int)"
keyword_query("min_properties", {"minProperties": 6}, _AT.format(path="", keyword="minProperties", where=f"{_N_MEMBERS} < 6"), _due)
keyword_query("max_properties", {"maxProperties": 5}, _AT.format(path="", keyword="maxProperties", where=f"{_N_MEMBERS} > 5"), _due)
keyword_query("pattern_properties", {"patternProperties": {"^d": {"type": "string"}}}, _AT.format(path="/due", keyword="type", where="o_orderstatus = 'P'"), _due)
keyword_query("property_names", {"propertyNames": {"maxLength": 5}}, " union all ".join(_AT.format(path="", keyword="maxLength", where="true") for _ in range(3)))  # number, urgency and amount are longer
keyword_query("dependent_required", {"dependentRequired": {"due": ["number", "paid"]}}, _AT.format(path="", keyword="dependentRequired", where="o_orderstatus = 'P'"), _due)
keyword_query("dependent_schemas", {"dependentSchemas": {"due": _property("amount", {"minimum": 150000})}}, _AT.format(path="/amount", keyword="minimum", where="o_orderstatus = 'P' and o_totalprice < 150000"), _due)
keyword_query("anchor", _property("state", {"$ref": "#p"}) | {"$defs": {"p": {"$anchor": "p", "const": "P"}}}, _AT.format(path="/state", keyword="const", where="o_orderstatus <> 'P'"))
keyword_query("dynamic_ref", _property("state", {"$dynamicRef": "#p"}) | {"$defs": {"p": {"$dynamicAnchor": "p", "const": "P"}}}, _AT.format(path="/state", keyword="const", where="o_orderstatus <> 'P'"))
keyword_query("format_is_a_remark", _property("number", {"format": "email", "minLength": 4}), _AT.format(path="/number", keyword="minLength", where="length(o_orderkey::varchar) < 4"))
keyword_query("boolean", _property("due", False), _AT.format(path="/due", keyword="false", where="o_orderstatus = 'P'"), _due)
keyword_query(
    "additional_schema",
    {"properties": {"number": True}, "additionalProperties": {"type": "string"}},
    " union all ".join(_AT.format(path=p, keyword="type", where=w) for p, w in (("/amount", "true"), ("/lines", _LINED), ("/due", "o_orderstatus = 'P'"))),
    _due,
)
keyword_query(
    "draft07",
    {"$schema": "http://json-schema.org/draft-07/schema#", **_property("tags", {"items": [{"const": "P"}], "additionalItems": {"const": "P"}}), "dependencies": {"due": ["paid"]}},
    " union all ".join(_AT.format(path=p, keyword=k, where=w) for p, k, w in (("/tags/0", "const", "o_orderstatus <> 'P'"), ("/tags/2", "const", "true"), ("", "dependentRequired", "o_orderstatus = 'P'"))),
    _tags,
    _due,
)
keyword_query(
    "recursive",
    {"properties": {"state": {"const": "P"}, "within": {"$ref": "#"}}},
    _AT.format(path="/state", keyword="const", where="o_orderstatus <> 'P'") + " union all " + _AT.format(path="/within/state", keyword="const", where="o_orderpriority <> '1-URGENT'"),
    lambda: F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "P").otherwise("F").alias("state")).alias("within"),
)
keyword_query("large_integers", _property("big", {"maximum": 2**53 + 1000}), _AT.format(path="/big", keyword="maximum", where="o_orderkey > 1000"), lambda: (F.col("o_orderkey") + 2**53).alias("big"))
keyword_query("pattern_end", _property("code", {"pattern": "^[A-Z]$"}), _AT.format(path="/code", keyword="pattern", where="o_orderstatus = 'P'"), lambda: F.when(F.col("o_orderstatus") == "P", "P\n").otherwise("F").alias("code"))


# Rules: resources, faults of schemas, recursion, values.

_RECEIPT = {
    "$id": f"{samples.BASE}/receipt.json",
    "properties": {"state": {"$ref": "state.json"}, "amount": {"$ref": "limits.json#/$defs/most%20of%20all"}, "lines": {"items": {"$ref": f"{samples.BASE}/line.json#own"}}},
    "$defs": {
        "s": {"$id": "state.json", "const": "P"},
        "l": {"$id": "limits.json", "$defs": {"most of all": {"maximum": 250000}}},
        "i": {"$id": "line.json", "$defs": {"x": {"$anchor": "own", "properties": {"units": {"$ref": "#/$defs/u"}}}, "u": {"minimum": 5}}},
    },
}
keyword_query(
    "embedded_resources",
    _RECEIPT,
    f"{_AT.format(path='/state', keyword='const', where=_NOT_P)} union all {_AT.format(path='/amount', keyword='maximum', where='o_totalprice > 250000')} union all "
    f"select payload_id, path, keyword from ({_LINES.format(name='units', keyword='minimum', bad='l_quantity < 5')}) where bad and payload_id in (select o_orderkey from orders)",
)
_ODD = ("customer's", 'said "so"', "a\\b", "a.b/c~d", "it's \"both\"")
keyword_query(
    "odd_names",
    {"properties": {n: {"const": "P"} for n in _ODD}, "required": list(_ODD)},
    " union all ".join(
        _AT.format(path="/" + n.replace("~", "~0").replace("/", "~1").replace("'", "''"), keyword="const", where=_NOT_P + " and o_orderkey % 2 = 0") + " union all " + _AT.format(path="", keyword="required", where="o_orderkey % 2 = 1") for n in _ODD
    ),
    *(lambda n=n: F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias(n) for n in _ODD),
)
keyword_query(
    "dynamic_scope",
    {
        "$id": f"{samples.BASE}/strict.json",
        "$dynamicAnchor": "node",
        "$ref": "nested.json",
        "unevaluatedProperties": False,
        "$defs": {"n": {"$id": "nested.json", "$dynamicAnchor": "node", "properties": {**{k: True for k in ("number", "state", "urgency", "amount", "lines")}, "within": {"$dynamicRef": "#node"}}}},
    },
    # what fails has evaluated nothing, so the outer node is closed to all of it then
    " union all ".join(_AT.format(path=p, keyword="unevaluatedProperties", where="o_orderstatus = 'F'") for p in ("/within", "")),
    lambda: F.struct(F.col("o_orderstatus").alias("state"), F.when(F.col("o_orderstatus") == "F", 1).alias("odd")).alias("within"),
)


def _nested(depth: int):
    """Structs in each other, each with the state of the order's digit at its depth."""
    digit = lambda i: F.substring(F.lpad(F.col("o_orderkey").cast("string"), depth, "0"), i + 1, 1)
    value = F.struct(digit(depth - 1).alias("digit"))
    for i in range(depth - 2, -1, -1):
        value = F.struct(digit(i).alias("digit"), F.array(value).alias("parts"))
    return value.alias("tree")


keyword_query(
    "recursive_deep",
    {"properties": {"tree": {"$ref": "#/$defs/t"}}, "$defs": {"t": {"type": "object", "properties": {"digit": {"pattern": r"^[\p{L}0-6]$"}, "parts": {"items": {"$ref": "#/$defs/t"}}}, "unevaluatedProperties": False}}},
    " union all ".join(_AT.format(path="/tree" + "/parts/0" * i + "/digit", keyword="pattern", where=f"substr(lpad(o_orderkey::varchar, 12, '0'), {i + 1}, 1) > '6'") for i in range(12)),
    lambda: _nested(12),
)


def _levels(n: int) -> dict:
    """allOf in allOf, each level closed to what it has not spoken of."""
    names = ("number", "state", "urgency", "amount", "lines")
    schema: dict = {"properties": {"number": True}}
    for i in range(1, n + 1):
        schema = {"allOf": [schema, {"properties": {names[i % 5]: True}}], "unevaluatedProperties": False} if i == n else {"allOf": [schema, {"properties": {names[i % 5]: True}}]}
    return {**schema, "allOf": [*schema["allOf"], {"anyOf": [{"properties": {"state": {"const": "P"}, "due": True}, "required": ["due"]}, True]}]}


keyword_query("unevaluated_nested", _levels(10), _AT.format(path="", keyword="unevaluatedProperties", where="o_orderkey % 3 = 0"), lambda: F.when((F.col("o_orderstatus") == "P") | (F.col("o_orderkey") % 3 == 0), 1).alias("due"), lambda: F.when(F.col("o_orderkey") % 3 == 0, 1).alias("more"))


@query(f"""{_AT.format(path='/both', keyword='uniqueItems', where='o_orderkey % 3 <> 0')} union all {_AT.format(path='/state', keyword='const', where=_NOT_P)}""")
def validate_written_values(spark, sf_dir):
    """Numbers are equal by value, however deep and however written; of repeated keys the last one counts."""
    key = (F.col("o_orderkey") + 1).cast("string")
    power = F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("1")
    text = F.concat(F.lit('{"state": "none", "both": [[{"n": '), key, F.lit('0}], [{"n": '), key, F.lit("e"), power, F.lit('}]], "state": "'), F.col("o_orderstatus"), F.lit('"}'))
    payloads = spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("payload_id"), text.alias("payload"))
    return error_rows(validate(payloads, {"properties": {"both": {"uniqueItems": True}, "state": {"const": "P"}}}, READ), "payload_id").select("payload_id", "path", "keyword")


@query("select case when o_orderkey % 7 = 0 then 2 when o_totalprice > 200000 then 1 else 0 end as exit_code, count(*)::bigint as n_payloads from orders group by 1")
def validate_beyond_all_numbers(spark, sf_dir):
    """A number that no double holds makes a document invalid, whether the schema contains itself or not."""
    text = F.concat(F.lit('{"amount": '), F.when(F.col("o_orderkey") % 7 == 0, "1e400").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), F.lit(', "note": "1e400"}'))
    payloads = spread(table(spark, sf_dir, "orders")).select(text.alias("payload"))
    return exit_codes(validate(payloads, {"properties": {"amount": {"maximum": 200000}, "within": {"$ref": "#"}}}, READ))


def _rooted(spark, sf_dir, name: Column) -> DataFrame:
    """Orders that name the schema of their own root capability."""
    about = F.concat(F.lit(f'{{"{samples.ENVELOPE}": {{"capabilities": {{"{samples.TICKET}": [{{"version": "2026-02-01", "schema": "{samples.BASE}/'), name, F.lit('.json"}]}}, '))
    return samples.orders(spark, sf_dir).select("payload_id", F.concat(about, F.expr("substr(payload, 2)")).alias("payload"))


@query("select k, case when k in (0, 1, 2) then 2 else (o_totalprice > 200000)::int end as exit_code, count(*)::bigint as n from (select *, o_orderkey % 5 as k from orders) group by all")
def validate_bad_schema_isolated(spark, sf_dir):
    """Schemas that are none are the fault of the payloads that ask for them, and of no others."""
    files = ({"properties": {"amount": {"type": 5}}}, {"properties": {"number": {"pattern": "["}}}, {"properties": {"state": {"enum": "P"}}}, {"properties": {"amount": {"maximum": 200000}}}, {"allOf": [{"properties": {"amount": {"maximum": 200000}}}]})
    docs = Documents(fetch=lambda url: json.dumps(files[int(url.rpartition("/")[2].removesuffix(".json"))]))
    k = F.col("payload_id") % 5
    checked = validate_by_capabilities(_rooted(spark, sf_dir, k.cast("string")), docs, "read")
    return checked.groupBy(k.alias("k"), "exit_code").agg(F.count("*").alias("n"))


@query("select (o_totalprice > 100000 + o_orderkey % 5000 * 50)::int as exit_code, count(*)::bigint as n, count(distinct o_orderkey % 5000)::bigint as n_sets from orders group by 1")
def validate_many_signatures(spark, sf_dir):
    """Orders under 5,000 sets of capabilities, each with a limit of its own; rules are rows, so the plan is that of one set."""
    docs = Documents(fetch=lambda url: json.dumps({"type": "object", "properties": {"amount": {"type": "number", "maximum": 100000 + 50 * int(url.rpartition("/")[2].removesuffix(".json"))}}}))
    k = F.col("payload_id") % 5000
    checked = validate_by_capabilities(_rooted(spark, sf_dir, k.cast("string")), docs, "read")
    return checked.groupBy("exit_code").agg(F.count("*").alias("n"), F.count_distinct(k).alias("n_sets"))


# Resolution.


@query(_AT.format(path="", keyword="additionalProperties", where="o_orderkey % 3 <> 0"))
def resolve_omit_rejected(spark, sf_dir):
    """A create request must not send what is omitted from it: two of three orders send their id and status."""
    short = F.regexp_replace("payload", r'^\{"number":"[0-9]+","state":"[A-Z]",', "{")
    sent = samples.orders(spark, sf_dir).withColumn("payload", F.when(F.col("payload_id") % 3 == 0, short).otherwise(F.col("payload")))
    checked = validate(sent, samples.ORDER, CREATE)
    return error_rows(checked, "payload_id").where("keyword = 'additionalProperties' and path = ''").select("payload_id", "path", "keyword")


@query(_AT.format(path="", keyword="additionalProperties", where="o_orderstatus = 'P'") + """
union all select l_orderkey, '/lines/' || (row_number() over (partition by l_orderkey) - 1), 'additionalProperties' from lineitem where l_orderkey in (select o_orderkey from orders)""")
def resolve_strict(spark, sf_dir):
    """Strictly, objects that say nothing of further members allow none: neither orders nor their lines, which have a price."""
    line = {"type": "object", "properties": {"part": True, "units": True}}
    schema = {"type": "object", "properties": {**{k: True for k in ("number", "state", "urgency", "amount")}, "lines": {"type": "array", "items": line}}}
    checked = validate(samples.orders(spark, sf_dir, _due()), schema, ResolveOptions("response", "read", strict=True))
    return error_rows(checked, "payload_id").select("payload_id", "path", "keyword")


_T = {"description": "d"}
#: Annotations of a property, by a document's number.
_SAID = ("omit", "required", {"create": "omit", "update": "required"}, {"transition": {"from": "optional", "to": "omit", **_T}}, {"create": {"transition": {"from": "omit", "to": "optional", **_T}}}, None)


def _annotated(spark, sf_dir) -> DataFrame:
    texts = [json.dumps({"properties": {"f": {"type": "string", **({samples.REQUEST: x} if x else {})}}, "required": ["f"]}) for x in _SAID]
    return samples.part_corpus(spark, sf_dir, texts)


@query("""select op, visibility, becomes, count(*)::bigint as n from (
  select op, case p_partkey % 6 when 0 then 'omit' when 1 then 'required' when 2 then case op when 'create' then 'omit' when 'update' then 'required' else 'include' end
    when 3 then 'optional' when 4 then case op when 'create' then 'omit' else 'include' end else 'include' end as visibility,
    case when p_partkey % 6 = 3 then 'omit' when p_partkey % 6 = 4 and op = 'create' then 'optional' end as becomes
  from part, (values ('create'), ('update'), ('read')) o(op)) group by all""")
def resolve_visibility_matrix(spark, sf_dir):
    found = corpus_of.visibility_rows(_annotated(spark, sf_dir), ("create", "update", "read"), ("request",))
    return found.groupBy("op", "visibility", "becomes").agg(F.count("*").alias("n"))


def _fields(spark, sf_dir, future: bool) -> DataFrame:
    """Whether the field is there, required and on its way out, of each resolved document."""
    found = corpus_of.resolved(_annotated(spark, sf_dir), ResolveOptions("request", "create", include_future=future))
    v = F.parse_json("content")
    field = member(member(v, "properties"), "f")
    required = F.coalesce(F.array_contains(F.transform(elements(member(v, "required")), lambda x: F.try_variant_get(x, "$", "string")), "f"), F.lit(False))
    return found.select(F.lit(future).alias("future"), field.isNotNull().alias("there"), required.alias("required"), member(field, "deprecated").isNotNull().alias("leaving"))


@query("""select future, there, required, leaving, count(*)::bigint as n from (
  select future, k in (1, 3, 5) or k = 4 and future as there, k in (1, 5) as required, k = 3 as leaving from (select p_partkey % 6 as k from part), (values (false), (true)) f(future)) group by all""")
def include_future(spark, sf_dir):
    return _fields(spark, sf_dir, False).unionByName(_fields(spark, sf_dir, True)).groupBy("future", "there", "required", "leaving").agg(F.count("*").alias("n"))


@query("""select case p_partkey % 4 when 1 then 'MonotonicityViolation' when 3 then 'TypeConflict' else 'ok' end as status, p_partkey % 4 = 2 as there, count(*)::bigint as n from part group by all""")
def allof_rules(spark, sf_dir):
    """Of branches the last annotation counts; a required member may not be weakened, nor a type be contradicted."""

    def branches(*said: str | None, required: bool = False, types: tuple = ("string", "string")) -> str:
        branch = lambda a, t: {"properties": {"f": {"type": t, **({samples.REQUEST: a} if a else {})}}, **({"required": ["f"]} if required and not a else {})}
        return json.dumps({"allOf": [branch(a, t) for a, t in zip(said, types, strict=True)]})

    texts = [branches("omit", "required"), branches(None, "omit", required=True), branches(None, "required"), branches(None, None, types=("string", "number"))]
    found = corpus_of.resolved(samples.part_corpus(spark, sf_dir, texts), CREATE)
    there = F.coalesce(F.size(F.filter(elements(member(F.try_parse_json("content"), "allOf")), lambda b: member(member(b, "properties"), "f").isNotNull())) == 2, F.lit(False))
    return found.groupBy(F.coalesce("fault", F.lit("ok")).alias("status"), there.alias("there")).agg(F.count("*").alias("n"))


@query("""select p_partkey::varchar || '.json' as uri, target, least, most from part, (values (0, 'protocol', '2026-01-01', null), (1, 'protocol', '2026-01-01', '2026-06-01'), (1, 'a', '2026-02-01', null)) d(k, target, least, most) where p_partkey % 4 = k""")
def requires_parsed(spark, sf_dir):
    """Version demands of each document; malformed ones, wherever, make none of a document's demands count."""
    asked = ({"protocol": {"min": "2026-01-01"}}, {"protocol": {"min": "2026-01-01", "max": "2026-06-01"}, "capabilities": {"a": {"min": "2026-02-01"}}}, {"protocol": {"min": "2026-01-01"}, "capabilities": {"a": {"min": "soon"}}}, {"capabilities": {"a": {"min": "2026-01-01", "max": None}}})
    return corpus_of.demands(samples.part_corpus(spark, sf_dir, [json.dumps({"requires": x}) for x in asked]))


@query("select o_orderpriority as priority, count(*)::bigint as n from orders where o_orderpriority is not null group by 1")
def transition_deprecated_usage(spark, sf_dir):
    """Payloads that still send fields on their way out."""
    plain = resolve(samples.ORDER, CREATE)
    old = [k for k, v in plain["properties"].items() if v.get("deprecated")]
    v = F.try_parse_json("payload")
    sent = samples.orders(spark, sf_dir).select(F.explode(F.array(*(F.try_variant_get(v, f"$.{k}", "string") for k in old))).alias("priority"))
    return sent.where("priority is not null").groupBy("priority").agg(F.count("*").alias("n"))


@query("""select o_orderkey as payload_id, 'request' as direction, '/amount' as path, 'maximum' as keyword from orders where o_totalprice > 150000
union all select o_orderkey, 'response', '', 'required' from orders where o_orderstatus <> 'P'""")
def container_select(spark, sf_dir):
    """Orders against the shape that a container has for the operation in each direction."""
    found = [error_rows(validate(samples.orders(spark, sf_dir, _due()), samples.QUOTE, ResolveOptions(d, "price")), "payload_id").select("payload_id", F.lit(d).alias("direction"), "path", "keyword") for d in ("request", "response")]
    return found[0].unionByName(found[1])


@query("""select o_orderkey as payload_id, '/amount' as path, 'maximum' as keyword from orders where o_totalprice > 250000
union all select o_orderkey, '/amount', 'minimum' from orders where o_totalprice < 50000 union all select o_orderkey, '', 'required' from orders where o_orderstatus <> 'P'""")
def container_merge(spark, sf_dir):
    """What two extensions say of one shape of a container stands in its place, together."""
    schema = compose(parse_capabilities(samples.capabilities("2026-02-01", *samples.SHAPES[1:], root=samples.SHAPES[0])), samples.documents())
    return error_rows(validate(samples.orders(spark, sf_dir, _due()), schema, ResolveOptions("request", "price")), "payload_id").select("payload_id", "path", "keyword")


@query("""select * from (select l_orderkey as payload_id, '/lines/' || (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar, l_quantity, l_extendedprice) - 1) || '/units' as path, 'minimum' as keyword, l_quantity < 5 as bad
  from lineitem where l_orderkey in (select o_orderkey from orders)) where bad""".replace("select * from", "select payload_id, path, keyword from", 1))
def bundle_references(spark, sf_dir):
    """References to another document, and within it, are inlined before orders are held against the schema."""
    schema = {"properties": {"lines": {"items": {"$ref": "order.json#/$defs/line", "title": "a line"}}}}
    plain = samples.documents().bundle_remote(schema, f"{samples.BASE}/here.json")
    return error_rows(validate(samples.orders(spark, sf_dir), plain, READ), "payload_id").select("payload_id", "path", "keyword")


def _linked(spark, sf_dir) -> DataFrame:
    """A document for each part: chains over three documents, pairs that lead back to themselves, and references to nothing."""
    key, next_ = F.col("p_partkey"), lambda n: (F.col("p_partkey") + n).cast("string")
    ref = lambda n, fragment, more="": F.concat(F.lit('{"properties": {"f": {"$ref": "'), next_(n), F.lit(f'.json{fragment}"{more}}}}}}}'))
    text = (
        F.when(key % 7 == 0, ref(1, "#/properties/f", ', "title": "first"'))
        .when(key % 7 == 1, ref(1, "#/$defs/a~1b"))
        .when(key % 7 == 2, F.lit('{"$defs": {"a/b": {"$ref": "#/$defs/c", "description": "own"}, "c": {"type": "string", "title": "last", "description": "c", "x": {"$ref": "#"}}}}'))
        .when(key % 7 == 3, ref(1, ""))
        .when(key % 7 == 4, ref(-1, ""))
        .when(key % 7 == 5, F.lit('{"properties": {"f": {"$ref": "nothing.json"}}}'))
        .otherwise(F.lit('{"properties": {"f": {"$ref": "#/$defs/gone"}}}'))
    )
    return table(spark, sf_dir, "part").select(F.concat(key.cast("string"), F.lit(".json")).alias("uri"), text.alias("content"))


@query("""with k as (select p_partkey as key, p_partkey % 7 as k, (select max(p_partkey) from part) as m, (select min(p_partkey) from part) as least from part)
select key::varchar || '.json' as uri, k in (0, 1) and key + 2 - k <= m as found, case when k = 0 and key + 2 <= m then 'first' when k = 1 and key < m then 'last' end as title,
  case when k in (0, 1) and key + 2 - k <= m then 'own' end as description, case when k in (0, 1) and key + 2 - k <= m then '#' end as own_root,
  case when k = 2 then null when k in (0, 1) and key + 2 - k <= m then null when k in (3, 4) and key + 4 - k <= m and key + 3 - k >= least then 'circular' else 'missing' end as fault from k""")
def bundle_corpus(spark, sf_dir):
    """References over chains of documents, inlined by joins; what is circular or missing is a fault of its document."""
    v = F.try_parse_json("content")
    f = F.try_variant_get(v, "$.properties.f", "variant")
    part = lambda path: F.try_variant_get(f, path, "string")
    fault = F.when(F.col("fault").contains("circular"), "circular").when(F.col("fault").isNotNull(), "missing")
    return bundle.bundle_corpus(_linked(spark, sf_dir)).select("uri", F.coalesce(part("$.type") == "string", F.lit(False)).alias("found"), part("$.title").alias("title"), part("$.description").alias("description"), part("$.x['$ref']").alias("own_root"), fault.alias("fault"))


@query("""select k, case k when 5 then 3 when 4 then 3 when 3 then (o_orderstatus <> 'P' or o_totalprice > 150000)::int when 2 then 2 when 1 then (o_orderstatus = 'O' or o_totalprice > 200000)::int else (o_totalprice > 200000)::int end as exit_code, count(*)::bigint as n
from (select *, o_orderkey % 6 as k from orders) group by all""")
def compose_from_tables(spark, sf_dir):
    """Orders against schemas composed from a table of schemas, whose references are inlined by joins, and a table of profiles."""
    root, more = samples.TICKET, samples.REBATE
    limit = {"type": "object", "properties": {"amount": {"$ref": "limits.json#/$defs/most"}}}
    schemas = {
        "ticket": limit,
        "limits": {"$defs": {"most": {"maximum": 200000}, "least": {"maximum": 150000}}},
        "rebate": {"$defs": {root: {"properties": {"state": {"enum": ["P", "F"]}, "amount": {"$ref": "limits.json#/$defs/most"}}}}},
        "loop": {"$ref": "loop.json"},
        "asked": {"properties": {"state": {"const": "P"}, "amount": {"$ref": "limits.json#/$defs/least"}}},
    }
    profile = {samples.ENVELOPE: {"capabilities": {"com.example.schemas.order": [{"version": "2026-02-01", "schema": f"{samples.BASE}/asked.json"}]}}}
    of = lambda name: {"version": "2026-02-01", "schema": f"{samples.BASE}/{name}.json"}
    sets = [{root: [of("ticket")]}, {root: [of("ticket")], more: [of("rebate") | {"extends": root}]}, {root: [of("ticket")], more: [of("rebate") | {"extends": "com.example.none"}]}, None, {root: [of("loop")]}, {root: [of("gone")]}]
    texts = [f'{{"{samples.ENVELOPE}": {{"capabilities": {json.dumps(x)}}}, ' if x else '{"meta": {"profile": "' + samples.PROFILE + '"}, "order": {' for x in sets]
    key = F.col("payload_id")
    payloads = samples.orders(spark, sf_dir).select("payload_id", F.concat(samples.by_number(key, texts), F.expr("substr(payload, 2)"), F.when(key % 6 == 3, "}").otherwise("")).alias("payload"))
    here = lambda name: F.concat(F.lit(f"{samples.BASE}/"), name, F.lit(".json"))
    corpus = spark.createDataFrame([(n, json.dumps(v)) for n, v in schemas.items()], "name string, content string").select(here(F.col("name")).alias("uri"), "content")
    tables = Tables(corpus, spark.createDataFrame([(samples.PROFILE, json.dumps(profile))], "uri string, content string"))
    return validate_by_capabilities(payloads, tables, "read").groupBy((key % 6).alias("k"), "exit_code").agg(F.count("*").alias("n"))


# Lint.

_LINT = "lint as (select p_partkey::varchar || '.json' as file, unnest(codes) as code from part join (values " + ", ".join(f"({i}, {list(codes)}::varchar[])" for i, (_, codes) in enumerate(samples.KINDS)) + f") k(k, codes) on p_partkey % {len(samples.KINDS)} = k)"
_FILES = f"{_LINT}, files as (select p_partkey::varchar || '.json' as file, count(code) filter (code like 'E%') as e, count(code) filter (code like 'W%') as w from part left join lint on lint.file = p_partkey::varchar || '.json' group by 1)"


def _linted(spark, sf_dir) -> DataFrame:
    return samples.part_corpus(spark, sf_dir, [x if isinstance(x, str) else json.dumps(x) for x, _ in samples.KINDS])


@query(f"with {_LINT} select code, count(*)::bigint as n from lint group by code")
def lint_by_code(spark, sf_dir):
    return lint.diagnostics(_linted(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query(f"with {_FILES} select file, case when e > 0 then 'error' when w > 0 then 'warning' else 'ok' end as status from files")
def lint_file_status(spark, sf_dir):
    corpus = _linted(spark, sf_dir)
    return lint.file_results(corpus, lint.diagnostics(corpus)).select("file", "status")


@query(f"with {_FILES} select count(*)::bigint as files_checked, count(*) filter (e = 0 and w = 0)::bigint as passed, count(*) filter (e + w > 0)::bigint as failed, sum(e)::bigint as errors, sum(w)::bigint as warnings from files")
def lint_summary(spark, sf_dir):
    corpus = _linted(spark, sf_dir)
    return lint.summary(lint.file_results(corpus, lint.diagnostics(corpus)), strict=True)


# Reports.

_SUMMARY = """
  select 'enum' as keyword, '/state' as place from orders where o_orderstatus not in ('P', 'F')
  union all select 'minLength', '/number' from orders where length(o_orderkey::varchar) < 4
  union all select 'pattern', '/number' from orders where not regexp_matches(o_orderkey::varchar, '[02468]$')
  union all select 'maximum', '/amount' from orders where o_totalprice > 200000
  union all select 'required', '' from orders where o_orderkey not in (select l_orderkey from lineitem)
  union all select 'minimum', '/lines/*/units' from lineitem where l_quantity < 5 and l_orderkey in (select o_orderkey from orders)"""


@query(f"select keyword, place, count(*)::bigint as n_errors from ({_SUMMARY}) group by 1, 2")
def violation_summary_orders(spark, sf_dir):
    """The flagship: every order as a payload against the resolved order schema, errors by keyword and place."""
    return violation_summary(validate(samples.orders(spark, sf_dir), samples.ORDER, READ))


_BAD = """o_orderstatus not in ('P', 'F') or length(o_orderkey::varchar) < 4 or not regexp_matches(o_orderkey::varchar, '[02468]$') or o_totalprice > 200000
  or o_orderkey not in (select l_orderkey from lineitem) or o_orderkey in (select l_orderkey from lineitem where l_quantity < 5)"""


@query(f"select case when o_orderkey % 11 = 0 then 2 when {_BAD} then 1 else 0 end as exit_code, count(*)::bigint as n_payloads from orders group by 1")
def verdict_exit_code(spark, sf_dir):
    payloads = samples.orders(spark, sf_dir)
    spoilt = payloads.withColumn("payload", F.when(F.col("payload_id") % 11 == 0, F.expr("substr(payload, 1, length(payload) - 1)")).otherwise(F.col("payload")))
    return exit_codes(validate(spoilt, samples.ORDER, READ))


@query("""select o_orderkey as payload_id, case when o_orderstatus = 'P' then '{"valid":true}' else '{"valid":false,"errors":[{"path":"/state","message":"must be \\"P\\""}]}' end as verdict from orders""")
def verdict_as_json(spark, sf_dir):
    plain = _property("state", {"const": "P"})
    return verdict_json(with_verdict(samples.orders(spark, sf_dir), F.try_parse_json("payload"), plain), "payload_id")


def _self_described(spark, sf_dir) -> DataFrame:
    """Orders as payloads of five kinds: a root alone, with one extension or two, requests with a profile, and none."""
    sets = [json.dumps(samples.capabilities("2026-02-01", *x, root=samples.TICKET)) for x in ((), (samples.REBATE,), (samples.REBATE, samples.PERKS))]
    about, body = f'{{"{samples.ENVELOPE}": {{"capabilities": ', F.expr("substr(payload, 2)")
    kind = F.col("payload_id") % 5
    rebate = F.concat(F.lit('"rebate": '), (F.col("payload_id") % 100 / 1000).cast("string"), F.lit(", "))
    text = F.when(kind == 3, F.concat(F.lit('{"meta": {"profile": "' + samples.PROFILE + '"}, "order": '), F.col("payload"), F.lit("}"))).when(kind == 4, F.col("payload"))
    for i, caps in enumerate(sets):
        text = text.when(kind == i, F.concat(F.lit(about + caps + "}, "), rebate, body))
    return samples.orders(spark, sf_dir, _due()).select("payload_id", text.alias("payload"))


@query("""select k, direction, exit_code, count(*)::bigint as n from (
  select k, case k when 4 then 'none' when 3 then 'request' else 'response' end as direction,
    case k when 4 then 2 when 3 then 1 when 0 then (total > 200000)::int when 1 then (status = 'O' or rebate < 0.03)::int else (status <> 'P' or rebate < 0.03)::int end as exit_code
  from (select o_orderkey % 5 as k, o_orderstatus as status, o_totalprice as total, o_orderkey % 100 / 1000.0 as rebate from orders)) group by all""")
def validate_self_described(spark, sf_dir):
    """Each payload against what its own capabilities compose: extensions stand for the root, together. Requests send a status, which none may."""
    checked = validate_by_capabilities(_self_described(spark, sf_dir), samples.documents(), "read")
    return checked.groupBy((F.col("payload_id") % 5).alias("k"), F.coalesce("direction", F.lit("none")).alias("direction"), "exit_code").agg(F.count("*").alias("n"))
