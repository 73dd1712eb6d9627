"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value computed once, also where use() puts it into other functions' lambdas.

    An aggregate over nothing hands its first value to its last step. get(transform(array(value), use), 0) gives the same, but
    works out the type of all that use() holds again for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def joined(arrays: Column) -> Column:
    """Arrays in one; flatten() asks for the type of its argument for each row, which let() has at hand."""
    return let(arrays, F.flatten)


def count(array: Column) -> Column:
    """The size of an array that takes a long expression, of which size() would ask the type for each row."""
    return let(array, F.size)


#: Entries of an array that are added up at once.
_BLOCK = 64


def starts(sizes: Column) -> Column:
    """For each of an array of sizes, the sum of those before it; by blocks, so that long arrays take time in proportion."""
    add = lambda some: F.aggregate(some, F.lit(0), lambda t, n: t + n)

    def running(blocks: Column, n: Column) -> Column:
        before = F.transform(blocks, lambda _, b: add(F.slice(blocks, F.lit(1), b)))
        return let(before, lambda s: F.transform(n, lambda _, j: F.get(s, F.floor(j / _BLOCK).cast("int")) + add(F.slice(n, F.floor(j / _BLOCK).cast("int") * _BLOCK + 1, j % _BLOCK))))

    last = lambda n: F.floor((F.size(n) - 1) / _BLOCK).cast("int")
    return let(sizes, lambda n: F.when(F.size(n) == 0, n).otherwise(let(F.transform(F.sequence(F.lit(0), last(n)), lambda b: add(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK)))), lambda blocks: running(blocks, n))))


def quoted(name: str) -> str | None:
    """A name as a step of a variant path, which has no escapes; None for one with both quotes."""
    return next((f"[{quote}{name}{quote}]" for quote in "'\"" if quote not in name), None)


def member(v: Column, name: str) -> Column:
    """Member of a variant object: NULL only if it is missing; a JSON null is a variant null."""
    step = quoted(name)
    return F.try_variant_get(v, f"${step}", "variant") if step else F.try_element_at(members(v), F.lit(name))


def at_pointer(v: Column, pointer: str) -> Column:
    """Member at a JSON Pointer, as navigate() finds it: arrays are not entered."""
    for part in pointer.strip("/").split("/") if pointer.strip("/") else ():
        v = member(v, part.replace("~1", "/").replace("~0", "~"))
    return v


def members(v: Column) -> Column:
    """A variant object as a map, NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def keys(v: Column) -> Column:
    """Names of a variant object's members, which are not copied for it; NULL for anything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,struct<>>"))


def places(v: Column) -> Column:
    """An array as long as a variant array, whose items are not copied for it; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<struct<>>")


def elements(v: Column) -> Column:
    """A variant array as an array, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def json_type(v: Column) -> Column:
    """object, array, string, boolean, null or number; NULL for a missing value. Only values that hold none are asked for their schema, which takes all that is within."""

    def named(kind: Column) -> Column:
        return (
            F.when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean")
            .when(kind == "VOID", "null")
            .otherwise("number")
        )

    is_ = lambda x, shape: F.try_variant_get(x, "$", shape).isNotNull()
    inner = lambda x: F.when(is_(x, "struct<>"), "object").when(is_(x, "array<struct<>>"), "array").otherwise(let(F.schema_of_variant(x), named))
    return let(v, lambda x: F.when(x.isNotNull(), inner(x)))


_TOKEN = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def _canonical_number(token: Column) -> Column:
    """Digits without zeros at either end, and the power of ten of the last one."""

    def parts(p: Column) -> Column:
        digits = F.regexp_replace(F.concat(p["whole"], p["part"]), "^0+", "")
        bare = F.regexp_replace(digits, "0+$", "")
        power = F.coalesce(p["power"].try_cast("int"), F.lit(0))
        shift = power - F.length(p["part"]) + F.length(digits) - F.length(bare)
        return F.when(bare == "", "0").otherwise(F.concat(p["sign"], bare, F.lit("e"), shift.cast("string")))

    form = r"^(-?)([0-9]+)(?:\.([0-9]*))?(?:[eE]\+?(-?[0-9]+))?$"
    group = lambda i: F.regexp_extract(token, form, i)
    return let(F.struct(group(1).alias("sign"), group(2).alias("whole"), group(3).alias("part"), group(4).alias("power")), parts)


def canonical_text(json: Column) -> Column:
    """JSON text in which numbers are equal where their values are, at any depth and however they are written."""
    tokens = F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[-0-9]"), _canonical_number(t)).otherwise(t)), "")


def canonical(v: Column) -> Column:
    """Text of a variant that is equal for equal values: members in order, numbers by value; strings stay as they are."""
    return canonical_text(F.to_json(v))


_LARGE = r'"(?:[^"\\]|\\.)*+"|-?[0-9]+(?:\.[0-9]+)?[eE]\+?[0-9]{3,}|-?[0-9]{309,}'


def parsed(text: Column) -> Column:
    """A variant of JSON text; NULL for what is no JSON, and where a number is beyond all doubles."""
    beyond = F.exists(F.regexp_extract_all(text, F.lit(_LARGE), F.lit(0)), lambda t: ~t.startswith('"') & (F.abs(t.try_cast("double")) == float("inf")))
    return F.when(~(text.rlike("[0-9][eE][+]?[0-9]{3}|[0-9]{309}") & beyond), F.try_parse_json(text))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to all cores by keys. Checks take far longer than their bytes let Spark expect, which would leave small tables to one task."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def with_variant(rows: DataFrame, name: str, v: Column) -> DataFrame:
    """rows with a variant; where it is parsed in v, of repeated keys the last one counts."""
    conf, key = rows.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(key, "false")
    conf.set(key, "true")  # taken into the expression as it is analysed, which withColumn does
    try:
        return rows.withColumn(name, v)
    finally:
        conf.set(key, before)
