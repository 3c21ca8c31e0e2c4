"""Page sets, and documents as rows of pages (doc_id, page_idx, rotation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js_compat as js


def expand_ranges(specs: DataFrame, key: str) -> DataFrame:
    """key, page_idx (from 0), ok and reason for specs such as ``1-3, 5`` over (key, spec, page_count).

    A good spec gives its sorted distinct pages, a bad one a single row with the reason: empty, bad_token, or out_of_range.
    """
    tokens = F.filter(F.transform(F.split(F.coalesce("spec", F.lit("")), ","), js.trim), lambda t: t != "")

    def parsed(t):
        one = F.regexp_extract(t, r"^(\d+)(?:\s*-\s*(\d+))?$", 1)
        two = F.regexp_extract(t, r"^(\d+)(?:\s*-\s*(\d+))?$", 2)
        a, b = one.try_cast("int"), F.when(two == "", one).otherwise(two).try_cast("int")
        bad = F.when(one == "", "bad_token").when(a.isNull() | b.isNull() | (a < 1) | (b < a) | (b > F.col("page_count")), "out_of_range")
        return F.struct(a.alias("a"), b.alias("b"), bad.alias("bad"))

    rows = specs.select(key, F.transform(tokens, parsed).alias("ranges"))
    reason = F.when(F.size("ranges") == 0, "empty").otherwise(F.element_at(F.concat(F.filter(F.col("ranges.bad"), lambda b: b.isNotNull()), F.array(F.lit(None).cast("string"))), 1))
    judged = rows.select(key, "ranges", reason.alias("reason"))
    # a sequence counts down where its end is smaller, so only judged ranges are expanded
    pages = F.when(F.col("reason").isNull(), F.array_sort(F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.when(r["bad"].isNull(), F.sequence(r["a"] - 1, r["b"] - 1)))))))
    return judged.select(key, F.explode_outer(pages).alias("page_idx"), F.col("reason").isNull().alias("ok"), "reason")


def _renumbered(pages: DataFrame, key: str) -> DataFrame:
    return pages.withColumn("new_idx", (F.row_number().over(Window.partitionBy(key).orderBy("page_idx")) - 1).cast("int"))


def select_pages(pages: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    return _renumbered(pages.join(picks.select(key, "page_idx"), [key, "page_idx"], "left_semi"), key)


def drop_pages(pages: DataFrame, picks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pages left, keys of documents that would lose all pages)."""
    left = _renumbered(pages.join(picks.select(key, "page_idx"), [key, "page_idx"], "left_anti"), key)
    return left, pages.select(key).distinct().join(left.select(key).distinct(), key, "left_anti")


def concat_documents(pages: DataFrame, bundle: DataFrame, key: str) -> DataFrame:
    """bundle, new_idx, key and page_idx: each bundle's documents one after another, by (bundle, key, ord)."""
    place = F.row_number().over(Window.partitionBy("bundle").orderBy("ord", key, "page_idx")) - 1
    return pages.join(bundle, key).select("bundle", place.cast("int").alias("new_idx"), key, "page_idx")


def number_pages(pages: DataFrame, key: str, prefix: str) -> DataFrame:
    return pages.select(key, "page_idx", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(key).orderBy("page_idx")).cast("string")).alias("label"))


def rotate_pages(pages: DataFrame, picks: DataFrame | None, key: str, degrees: int) -> DataFrame:
    """Adds ``degrees`` modulo 360 to the picked pages, to all without picks."""
    turned = F.pmod(F.col("rotation") + degrees, F.lit(360)).cast("int")
    if picks is None:
        return pages.withColumn("rotation", turned)
    marked = pages.join(picks.select(key, "page_idx").distinct().withColumn("picked", F.lit(True)), [key, "page_idx"], "left")
    return marked.withColumn("rotation", F.when(F.col("picked"), turned).otherwise(F.col("rotation"))).select(pages.columns)
