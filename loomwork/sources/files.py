"""Tables of files: inventory, admission by limits, format by signature, names of exports, and outputs by kind."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_text
from . import delimited

LIMITS = "kind string, max_files int, max_size long, types array<string>, extensions array<string>"
#: MIME types that say nothing about a file.
UNKNOWN_MIME = ("", "application/octet-stream")
BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; the whole name if there is none."""
    return F.element_at(F.split(F.lower(name), r"\."), -1)


def file_inventory(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """path, name, ext, length, mtime and, if asked for, content. Without it no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumnRenamed("modificationTime", "mtime")
    return inventory_of(files).select("path", "name", "ext", "length", "mtime", *(["content"] if with_content else []))


def inventory_of(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with name, what follows the last slash, and ext."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"name": name, "ext": extension(name)})


#: What holds where a kind's limits leave a field null.
MOST_FILES, MOST_BYTES = 1, 25 << 20


def admit(files: DataFrame, limits: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """``files`` (batch_id, kind, name, mime, size) with ok and reason: kind, too_many, type, extension or size, in that order.

    Limits are a dimension table with a row for each kind; a kind without a row is rejected. A limit's null field is one file,
    25 MiB, any type or any extension. Every row comes back: one without a batch is a batch of its own, and one without a name or
    size does not pass their limits. ``batches`` (batch_id, kind) adds a row for batches without files.
    """
    sizes = files.groupBy("batch_id").agg(F.count("*").alias("in_batch"))
    held = files.join(sizes, "batch_id", "left").join(limits.withColumn("known", F.lit(True)), "kind", "left")
    mime, listed = F.coalesce("mime", F.lit("")), lambda c, x: F.col(c).isNull() | F.coalesce(F.array_contains(c, x), F.lit(False))
    reason = (
        F.when(F.col("known").isNull(), "kind")
        .when(F.coalesce("in_batch", F.lit(1)) > F.coalesce("max_files", F.lit(MOST_FILES)), "too_many")
        .when(~mime.isin(*UNKNOWN_MIME) & ~listed("types", mime), "type")
        .when(~listed("extensions", extension(F.col("name"))), "extension")
        .when(F.coalesce(F.col("size") > F.coalesce("max_size", F.lit(MOST_BYTES)), F.lit(True)), "size")
    )
    judged = held.select(*files.columns, reason.isNull().alias("ok"), reason.alias("reason"))
    if batches is None:
        return judged
    empty = batches.join(files.select("batch_id").distinct(), "batch_id", "left_anti").select("batch_id", "kind", F.lit(False).alias("ok"), F.lit("no_files").alias("reason"))
    return judged.unionByName(empty, allowMissingColumns=True)


# fixed values: signatures of image files and the formats of extensions
SIGNATURES = (("JPEG", "^FFD8"), ("PNG", "^89504E47"), ("WebP", "^52494646.{8}57454250"))
BY_NAME = (("JPEG", ("jpg", "jpeg")), ("PNG", ("png",)), ("WebP", ("webp",)))


def _by_name(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in BY_NAME:
        out = F.when(c.isin(*words), name).otherwise(out)
    return out


def sniff_format(files: DataFrame) -> DataFrame:
    """``files`` (name, mime, content) with format (by signature, else MIME type, else extension), ext_format and mismatch."""
    head, by_bytes = F.hex(F.substring("content", 1, 12)), F.lit(None).cast("string")
    for name, pattern in reversed(SIGNATURES):
        by_bytes = F.when(head.rlike(pattern), name).otherwise(by_bytes)
    by_ext = _by_name(extension(F.col("name")))
    by_mime = F.lit(None).cast("string")
    for name in ("WebP", "PNG", "JPEG"):
        by_mime = F.when(F.lower("mime").contains(name.lower()), name).otherwise(by_mime)
    found = F.coalesce(by_bytes, by_mime, by_ext, F.lit("Unknown"))
    return files.withColumns({"format": found, "ext_format": F.coalesce(by_ext, F.lit("Unknown")), "mismatch": found != F.coalesce(by_ext, F.lit("Unknown"))})


def safe_name(name: Column, fallback: str = "file", longest: int = 80) -> Column:
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), r"[/\\]"), -1)
    bare = F.regexp_replace(base, r"\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "").substr(1, longest)
    return F.when(clean == "", fallback).otherwise(clean)


def export_manifest(df: DataFrame, batch: str, order: str, name_col: str, ext: str, mode: str) -> DataFrame:
    """batch, order, out_name (ordinal of two digits or more, clean name, mode) and whether the name occurs twice."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(order)).cast("string")
    padded = F.when(F.length(place) < 2, F.lpad(place, 2, "0")).otherwise(place)
    named = df.select(batch, order, F.concat_ws("-", padded, safe_name(F.col(name_col)), F.lit(mode)).alias("stem")).select(batch, order, F.concat("stem", F.lit("." + ext)).alias("out_name"))
    twice = named.groupBy("out_name").agg((F.count("*") > 1).alias("collision"))
    return named.join(twice, "out_name").select(batch, order, "out_name", "collision")


# fixed values: kinds of outputs and their types
MIME = {"json": "application/json", "csv": "text/csv", "yaml": "text/yaml", "diff": "text/plain", "html": "text/html", "text": "text/plain"}
MANIFEST = "kind string, mime string, files long, bytes long, rejected long, run string, at timestamp"


def write_outputs(df: DataFrame, path: str, kind_col: str = "kind", name_col: str = "name", body_col: str = "body") -> DataFrame:
    """Writes named outputs by kind and returns the run's manifest: kind, mime, files, bytes, rejected, run and at.

    JSON goes to JSON lines, one minified value each, with its name; all other kinds to delimited records of name and body, which
    keep line ends and quotes. Each run writes a folder of its own for each kind, and its manifest last, so readers
    (``read_outputs``) see all of a run or the one before, and a run that failed or is repeated leaves one result. Rows of a kind
    that is not in MIME, null ones among them, and JSON that is not valid are counted as rejected and not written; a null name is
    empty, and so is a null body but of JSON. An empty table gives an empty manifest, which replaces what was there.
    """
    spark, run, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    known = F.coalesce(F.col(kind_col).isin(*MIME), F.lit(False))
    kind = F.when(known, F.col(kind_col))
    good = known & ((kind != "json") | json_text.json_problem(F.col(body_col)).isNull())
    body = F.when(kind == "json", json_text.json_minified(F.col(body_col))).otherwise(F.coalesce(F.col(body_col), F.lit("")))
    rows = df.select(kind.alias("kind"), F.coalesce(F.col(name_col).cast("string"), F.lit("")).alias("name"), body.alias("body"), good.alias("good"))
    own = {k: (F.col("kind") == k) if k else F.col("kind").isNull() for k in (*MIME, None)}
    told = [F.count_if(c & F.col("good")).alias(f"files_{k}") for k, c in own.items()] + [F.count_if(c & ~F.col("good")).alias(f"rejected_{k}") for k, c in own.items()]
    told += [F.sum(F.when(c & F.col("good"), F.octet_length("body"))).alias(f"bytes_{k}") for k, c in own.items()]
    named = F.to_json(F.struct("name"))
    json_line = F.concat(F.left(named, F.length(named) - 1), F.lit(',"value":'), F.col("body"), F.lit("}"))
    line = F.when(F.col("kind") == "json", json_line).otherwise(F.concat_ws(",", delimited.quoted(F.col("name")), delimited.quoted(F.col("body"))))
    rows.observe(seen, *told).where("good").select("kind", line.alias("value")).write.partitionBy("kind").text(f"{path}/runs/{run}")
    counts = [(k, MIME.get(k), *(seen.get[f"{c}_{k}"] or 0 for c in ("files", "bytes", "rejected")), run) for k in own]
    made = spark.createDataFrame(counts, MANIFEST.rsplit(", ", 1)[0]).withColumn("at", F.current_timestamp())
    made.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where((F.col("run") == run) & ((F.col("files") > 0) | (F.col("rejected") > 0)))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """kind, name and body of the outputs of the last run whose manifest is there; JSON bodies are minified."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = manifest.join(manifest.agg(F.max_by("run", F.struct("at", "run")).alias("run")), "run").where("files > 0")
    found = spark.createDataFrame([], "kind string, name string, body string")
    for r in last.select("kind", "run").collect():  # no more than there are kinds
        folder = f"{path}/runs/{r.run}/kind={r.kind}"
        if r.kind == "json":
            head = F.regexp_extract("value", rf'^\{{"name":{json_text.STRING},"value":', 0)
            name = F.get_json_object(F.concat(F.left(head, F.length(head) - len(',"value":')), F.lit("}")), "$.name")
            rows = spark.read.option("lineSep", "\n").text(folder).select(name.alias("name"), F.substring("value", F.length(head) + 1, F.length("value") - F.length(head) - 1).alias("body"))
        else:
            cells = delimited.cells(F.col("text"))
            rows = delimited.read_records(spark, folder).select(*(F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(("name", "body"))))
        found = found.unionByName(rows.select(F.lit(r.kind).alias("kind"), "name", "body"))
    return found
