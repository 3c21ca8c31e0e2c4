"""Semi-structured records: gates, key discovery, JSON to tables and back, leaves, and fields to drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js_compat as js
from ..functions import json_text
from ..functions.names import distinct_names


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once for each row, also where rows are chosen by it: no filter passes a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def json_gate(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, ok, reason (null, syntax or depth), minified text, and bytes before and after.

    The grammar is checked strictly, by patterns over the raw text: what follows the value, single quotes, NaN and bare control
    characters are rejected, repeated keys are not. Minifying drops blanks only, so keys keep their order and numbers their
    spelling. Every row comes back; rejected ones have no minified text.
    """
    judged = df.select(F.col(key).alias("k"), F.col(col).alias("raw"), json_text.json_problem(F.col(col)).alias("reason"))
    minified = judged.withColumn("minified", F.when(F.col("reason").isNull(), json_text.json_minified(F.col("raw"))))
    return minified.select(
        F.col("k").alias(key), F.col("reason").isNull().alias("ok"), "reason", "minified", F.octet_length("raw").alias("bytes_before"), F.octet_length("minified").alias("bytes_after"),
    )


def _judged(df: DataFrame, key: str, col: str) -> DataFrame:
    """k, json, kind and reason, which is null where the text is an object with fields, or an array of objects that have some."""
    read = _once(df.select(F.col(key).alias("k"), F.col(col).alias("json")), "kind", json_text.json_kind(F.col("json")))
    bare = F.translate(json_text.json_minified(F.col("json")), "[]{},", "") == ""
    reason = (
        F.when(F.col("kind").startswith("?"), F.substring("kind", 2, 9)).when(F.col("kind").isin("string", "scalar"), "not_array").when(F.col("kind") == "array", "not_objects")
        .when(bare, "no_fields")
    )
    return read.withColumn("reason", reason)


def _objects(df: DataFrame, key: str, col: str) -> DataFrame:
    """k, item and json of each object: a text that is an object is its own, an array of objects has one for each item."""
    judged = _judged(df, key, col).where("reason is null")
    items = F.when(F.col("kind") == "object", F.array("json")).otherwise(F.from_json(json_text.json_minified(F.col("json")), "array<string>"))
    return judged.select("k", F.posexplode(items).alias("item", "json"))


def _fields(json: str) -> Column:
    """The fields of an object as text, numbers marked; a repeated key stands where it is first seen, with its last value."""
    read = F.from_json(json_text.with_marked_numbers(json_text.json_minified(F.col(json))), "map<string,string>")

    def last_ones(m: Column) -> Column:
        keys, entries = F.map_keys(m), F.map_entries(m)
        last = lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), m).otherwise(F.map_from_entries(F.transform(F.array_distinct(keys), last)))

    return F.get(F.transform(F.array(read), last_ones), F.lit(0))


def discover_keys(df: DataFrame, col: str, order: str) -> DataFrame:
    """key, first_row, first_pos and n_rows: the union of the objects' keys, in the order they are first seen. ``col`` holds objects
    or arrays of objects, whose keys count once for each item; other values and bad texts have no keys."""
    keys = _objects(df, order, col).select("k", "item", F.posexplode(F.json_object_keys("json")).alias("pos", "key"))
    found = keys.groupBy("key").agg(F.min(F.struct("k", "item", "pos")).alias("first"), F.count("*").alias("n_rows"))
    return found.select("key", F.col("first.k").alias("first_row"), F.col("first.pos").alias("first_pos"), "n_rows", F.col("first.item").alias("first_item"))


#: Keys that become columns; those found after them stay in one column of JSON text.
WIDEST = 1000


def json_to_wide(df: DataFrame, key: str, col: str, keys: Sequence[str] | None = None, widest: int = WIDEST) -> DataFrame:
    """key, item, a text column for each of ``keys``, and ``more``, the JSON text of all other fields, empty where there are none.

    ``col`` holds objects, or arrays of objects with a row for each item. Without ``keys`` they are discovered first, in the order
    they are first seen, ``widest`` of them. Missing and null fields are empty, nested ones JSON text, numbers spelled as
    JavaScript prints them; the last of repeated keys counts. A column's name that is taken, in any case of its letters, gets
    _2, _3, ... Texts that are neither are in ``wide_rejects``.
    """
    if keys is None:
        found = discover_keys(df, col, key).orderBy("first_row", "first_item", "first_pos").limit(widest)
        keys = [r.key for r in found.select("key").collect()]
    names = distinct_names([key, "item", *keys, "more"])
    parsed = _objects(df, key, col).select("k", "item", _fields("json").alias("m"))
    text = lambda v: F.coalesce(json_text.without_marks(v), F.lit(""))
    rest = F.map_filter("m", lambda k, v: ~k.isin(list(keys)))
    more = F.when(F.size(rest) > 0, F.to_json(F.transform_values(rest, lambda k, v: text(v)))).otherwise("")
    columns = [F.col("k"), F.col("item"), *(text(F.try_element_at("m", F.lit(k))) for k in keys), more]
    return parsed.select(*(c.alias(n) for c, n in zip(columns, names)))


def json_to_long(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, item, field and value of every field of the objects in ``col``, whatever their number; values are as in ``json_to_wide``."""
    long = _objects(df, key, col).select("k", "item", F.explode(_fields("json")).alias("field", "v"))
    return long.select(F.col("k").alias(key), "item", "field", F.coalesce(json_text.without_marks(F.col("v")), F.lit("")).alias("value"))


def wide_rejects(df: DataFrame, key: str, col: str) -> DataFrame:
    """key and reason of every text that gives ``json_to_wide`` no row: null, syntax, depth, not_array (a bare value), not_objects (an
    array with something else in it); and no_fields, of those whose objects are all empty or that are an empty array."""
    return _judged(df, key, col).where("reason is not null").select(F.col("k").alias(key), "reason")


def rows_to_json(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """key and a JSON object of ``cols``, all as text, in their order."""
    return df.select(key, F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols))).alias("json"))


def _path(parent: Column, name: Column, place: Column) -> Column:
    """The path of a member: dotted, quoted where it is no plain name, or in brackets where it has only a place."""
    quoted = F.when(name.rlike("^[A-Za-z0-9_-]+$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"')))
    dotted = F.when(parent == "", quoted).otherwise(F.concat(parent, F.lit("."), quoted))
    return F.when(name.isNull(), F.concat(parent, F.lit("["), place, F.lit("]"))).otherwise(dotted)


def leaf_paths(df: DataFrame, key: str, col: str, depth: int = 4) -> DataFrame:
    """key, path, kind, value and truncated of every leaf. Empty objects and arrays are leaves; what is nested deeper than
    ``depth`` is kept as JSON text and flagged.

    Texts that are not valid JSON, or that repeat a key within an object, have no leaves; ``leaf_rejects`` has them.
    The input is read once: each level opens what is still nested and lets leaves through, as one member of themselves.
    """
    kind = F.regexp_extract(F.expr("schema_of_variant(v)"), "^[A-Z]+", 0)
    nested = kind.isin("OBJECT", "ARRAY") & ~F.to_json("v").isin("{}", "[]")
    valid = F.when(json_text.json_problem(F.col("json")).isNull(), F.try_parse_json("json"))
    level = _once(df.select(F.col(key).alias("k"), F.lit("").alias("path"), F.col(col).alias("json")), "v", valid).drop("json").where("v is not null").withColumn("open", nested)
    for _ in range(depth):
        members = F.when(F.col("open"), F.col("v")).otherwise(F.parse_json(F.lit("[0]")))
        inner = level.withColumn("members", members).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("members").outer()))
        level = inner.select(
            "k", F.when(F.col("open"), _path(F.col("path"), F.col("key"), F.col("pos"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("open"), F.col("value")).otherwise(F.col("v")).alias("v"), "open",
        ).withColumn("open", F.col("open") & nested)
    value = F.when(F.col("kind").isin("OBJECT", "ARRAY"), F.to_json("v")).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
    named = F.when(F.col("kind") == "VOID", "null").otherwise(F.lower("kind"))
    return level.withColumn("kind", kind).select(F.col("k").alias(key), "path", named.alias("kind"), value.alias("value"), F.col("open").alias("truncated"))


def leaf_rejects(df: DataFrame, key: str, col: str) -> DataFrame:
    """key and reason of every text without leaves: null, syntax, depth or repeated_keys."""
    problem = F.coalesce(json_text.json_problem(F.col("json")), F.when(F.try_parse_json("json").isNull(), "repeated_keys"))
    judged = _once(df.select(F.col(key).alias("k"), F.col(col).alias("json")), "reason", problem)
    return judged.where("reason is not null").select(F.col("k").alias(key), "reason")


# fixed values: words that are read as truth values or nothing, in any case
TRUTH_WORDS = ("y", "n", "yes", "no", "on", "off", "true", "false", "null", "~")


def ambiguity(value: Column) -> Column:
    """Why a text would be read as something else if left unquoted: blank, marks, word or number; null if it would not."""
    edges = js.trim(value)
    marked = (edges != value) | (F.translate(value, ":#\r\n\t", "") != value)
    # a number by what it is made of and by whether it can be read as one
    numeric = (F.translate(value, "0123456789.eE+-", "") == "") & value.try_cast("double").isNotNull()
    return F.when(edges == "", "blank").when(marked, "marks").when(F.lower(value).isin(*TRUTH_WORDS), "word").when(numeric, "number")


def ambiguous_scalars(leaves: DataFrame) -> DataFrame:
    """path, rule, n and share of the path's texts, for each rule that fits first."""
    counted = leaves.where("value is not null").groupBy("path", ambiguity(F.col("value")).alias("rule")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("path"))
    return counted.withColumn("share", F.round(share, 9)).where("rule is not null").select("path", "rule", "n", "share")


def drop_sensitive(df: DataFrame, key: str, map_col: str, names: DataFrame | Sequence[str]) -> DataFrame:
    """key, cleaned JSON, number of dropped fields, and bytes before and after.

    ``names`` are the fields to drop: a table with a column ``name``, of any size, or a few values. Only names that occur as fields
    meet the exploded fields, in a join that Spark makes a broadcast where their size allows and else splits where a field is in
    most rows. Rows with the same key stay apart. A null map has null texts and nothing dropped; an empty one and one whose fields
    all go are ``{}``. Null and repeated names change nothing. The fields that stay keep their order.
    """
    if not isinstance(names, DataFrame):
        names = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    own = F.struct(F.monotonically_increasing_id().alias("at"), F.xxhash64(F.col(key)).alias("key"))
    rows = df.select(own.alias("row"), F.col(key).alias("k"), F.col(map_col).alias("m")).select("*", F.posexplode_outer("m").alias("at", "field", "value"))
    first = F.coalesce("at", F.lit(0)) == 0  # a row's key and text travel with one of its fields
    fields = rows.select("row", "at", "field", "value", F.when(first, F.struct("k", F.to_json("m").alias("before"))).alias("whole"))
    used = df.select(F.explode(F.map_keys(map_col)).alias("field")).distinct()  # of a long list, only what occurs goes on
    listed = names.select(F.col("name").alias("field")).distinct().join(used, "field", "left_semi").withColumn("listed", F.lit(True))
    kept = F.when(F.col("listed").isNull() & F.col("at").isNotNull(), F.struct("at", "field", "value"))
    met = fields.join(listed, "field", "left").groupBy("row").agg(F.max("whole").alias("whole"), F.count("listed").alias("dropped"), F.sort_array(F.collect_list(kept)).alias("kept"))
    clean = F.to_json(F.map_from_entries(F.transform("kept", lambda f: F.struct(f["field"], f["value"]))))
    named = met.select(F.col("whole.k").alias(key), F.when(F.col("whole.before").isNotNull(), clean).alias("cleaned"), F.col("dropped").cast("int").alias("dropped"), F.col("whole.before").alias("before"))
    return named.select(key, "cleaned", "dropped", F.octet_length("before").alias("bytes_before"), F.octet_length("cleaned").alias("bytes_after"))


def size_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """n, totals, ratio and how many did not become smaller, over (key, bytes) pairs."""
    both = before.select(key, F.col("bytes").alias("b")).join(after.select(key, F.col("bytes").alias("a")), key)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    report = both.agg(F.count("*").alias("n"), total("b")("total_before"), total("a")("total_after"), F.count_if(F.col("a") >= F.col("b")).alias("grew"))
    return report.withColumn("ratio", F.when(F.col("total_before") > 0, F.round(F.col("total_after") / F.col("total_before"), 6)))


def size_histogram(df: DataFrame, col: str) -> DataFrame:
    """unit, n, bytes and label of the bytes of each unit."""
    grouped = df.groupBy(js.size_unit(F.col(col)).alias("unit")).agg(F.count("*").alias("n"), F.sum(col).alias("bytes"))
    return grouped.select("unit", "n", "bytes", js.size_label(F.col("bytes")).alias("label"))
