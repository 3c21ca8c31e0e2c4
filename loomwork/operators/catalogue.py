"""Search, ranking, paging and checks of a catalogue; recent lists; routes.

A catalogue has id, name, category, description, keywords (array) and ord, its fixed order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js_compat as js

# fixed values: points a search token earns by where it is found, best first
POINTS = {"equal": 100, "prefix": 60, "name": 40, "keywords": 20, "description": 10, "else": 5}


def _haystack(catalogue: DataFrame) -> Column:
    """All that is searched: names and texts, keywords, and badges and accepted types where the catalogue has them."""
    lists = [c for c in ("keywords", "badges", "accepted") if c in catalogue.columns]
    return F.lower(F.concat_ws(" ", "name", "category", "description", *lists))


def _score(catalogue: DataFrame, tokens: Sequence[str]) -> Column:
    """Sum of the tokens' points, null if one occurs nowhere."""
    haystack = _haystack(catalogue)
    name, words, about = F.lower("name"), F.lower(F.concat_ws(" ", "keywords")), F.lower("description")
    total = F.lit(0)
    for t in tokens:
        total = total + (
            F.when(~haystack.contains(t), None).when(name == t, POINTS["equal"]).when(name.startswith(t), POINTS["prefix"]).when(name.contains(t), POINTS["name"])
            .when(words.contains(t), POINTS["keywords"]).when(about.contains(t), POINTS["description"]).otherwise(POINTS["else"])
        )
    return total


def keyword_search(catalogue: DataFrame, queries: dict[int, str], k: int) -> DataFrame:
    """query_id, id, score and rank of each query's best ``k`` rows; ties keep catalogue order, a blank query all of it.

    The queries are a stated set, so each row scores itself against them in one pass: nothing is joined, and only hits are
    shuffled to be ranked.
    """
    scores = F.array(*(F.struct(F.lit(q).alias("query_id"), _score(catalogue, text.lower().split()).alias("score")) for q, text in queries.items()))
    hits = catalogue.select("id", "ord", F.explode(F.filter(scores, lambda s: s["score"].isNotNull())).alias("s")).select("s.query_id", "id", "ord", "s.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _grams(text: Column, n: int) -> Column:
    """All parts of ``n`` characters of a text."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))


#: Texts that hold the same part are scored in so many groups.
DEALT = 16


def search_table(catalogue: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and rank as ``keyword_search`` has them, for a table of ``queries`` (query_id, text) of any number.

    Queries of the same tokens are one, and so are rows of the same texts, of which no more than the first ``k`` can be in a result;
    so it is different queries that meet different texts. A row that holds a token holds all its parts of three characters (or the
    token, if it is shorter). Each query is led by the part that the fewest texts hold, whose texts are found by an equi-join, and
    all its tokens are then looked for in these alone. Null and blank queries rank the whole catalogue in its order. Repeated tokens
    count again.
    """
    split = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda t: t != "")
    asked = queries.select("query_id", F.array_sort(split).alias("tokens"))
    different = asked.where("size(tokens) > 0").select("tokens").distinct()
    parts = F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(_grams(t, 3)))))
    wanted = different.select("tokens", F.explode(parts).alias("part"))
    texts = {"name": F.lower("name"), "words": F.lower(F.concat_ws(" ", "keywords")), "about": F.lower("description"), "hay": _haystack(catalogue)}
    place = F.row_number().over(Window.partitionBy(*texts).orderBy("ord", "id"))
    rows = catalogue.select("id", "ord", *(c.alias(n) for n, c in texts.items())).withColumn("place", place).where(F.col("place") <= k)
    heads = rows.where("place = 1").drop("place")
    held = heads.select("*", F.explode(F.array_distinct(F.concat(*(_grams(F.col("hay"), n) for n in (1, 2, 3))))).alias("part"))
    posted = held.join(wanted.select("part").distinct(), "part", "left_semi")
    sizes = posted.groupBy("part").agg(F.count("*").alias("n"))
    # a part that no text holds leads its query to no candidates
    led = wanted.join(sizes, "part", "left").groupBy("tokens").agg(F.min_by("part", F.struct(F.coalesce("n", F.lit(0)), "part")).alias("part"))
    # texts of a part are dealt out, and every group meets the part's queries
    deal = F.pmod(F.xxhash64("hay"), F.lit(DEALT)).cast("int")
    # few bytes give many pairs, so neither side is broadcast from one task nor are tasks put together
    tasks = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking = led.select("tokens", "part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    candidates = posted.withColumn("deal", deal).repartition(tasks, "part", "deal").join(asking.hint("shuffle_hash"), ["part", "deal"])

    def points(t: Column) -> Column:
        name = F.col("name")
        return (
            F.when(~F.contains(F.col("hay"), t), None).when(name == t, POINTS["equal"]).when(F.startswith(name, t), POINTS["prefix"]).when(F.contains(name, t), POINTS["name"])
            .when(F.contains(F.col("words"), t), POINTS["keywords"]).when(F.contains(F.col("about"), t), POINTS["description"]).otherwise(POINTS["else"])
        )

    score = F.aggregate(F.transform("tokens", points), F.lit(0), lambda a, x: a + x)
    hits = candidates.select("tokens", "id", "ord", *texts, score.alias("score")).where("score is not null")
    rank = F.row_number().over(Window.partitionBy("tokens").orderBy(F.col("score").desc(), "ord", "id"))
    # a row among the first k has a text whose first row is among the first k of these
    leaders = hits.withColumn("rank", rank).where(F.col("rank") <= k).select("tokens", "score", *(F.col(c).alias(f"_{c}") for c in texts))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts]
    best = leaders.join(rows, same).withColumn("rank", rank).where(F.col("rank") <= k).select("tokens", "id", "score", "rank")
    found = asked.join(best, "tokens").select("query_id", "id", "score", "rank")
    # the first k rows, numbered, go to each blank query
    first = catalogue.select("id", "ord").orderBy("ord", "id").limit(k).select("id", F.row_number().over(Window.orderBy("ord", "id")).alias("rank"))
    blank = asked.where("size(tokens) = 0").select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).join(first, "rank")
    return found.unionByName(blank.select("query_id", "id", F.lit(0).alias("score"), "rank"))


def page_of(ranked: DataFrame, page: int, size: int = 10) -> DataFrame:
    """Rows of one page of each query's results, with total, total_pages, page (clamped), from_row and to_row."""
    totals = ranked.groupBy("query_id").agg(F.count("*").alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("int")
    at = F.least(F.greatest(F.lit(page), F.lit(1)), pages)
    known = totals.select("query_id", "total", pages.alias("total_pages"), at.alias("page"), ((at - 1) * size + 1).alias("from_row"), F.least(at * size, F.col("total")).alias("to_row"))
    return ranked.join(known, "query_id").where("rank between from_row and to_row")


def facet_page(page_rows: DataFrame, catalogue: DataFrame, categories: DataFrame) -> DataFrame:
    """query_id, category, n and ids of one page, in the categories' order; groups are made after paging."""
    joined = page_rows.join(catalogue.select("id", "category"), "id").join(categories, "category")
    return joined.groupBy("query_id", "category", "cat_ord").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


def category_counts(catalogue: DataFrame, categories: DataFrame) -> DataFrame:
    counts = catalogue.groupBy("category").agg(F.count("*").alias("n"))
    return categories.join(counts, "category", "left").select("category", "cat_ord", F.coalesce("n", F.lit(0)).alias("n"))


def category_filter(catalogue: DataFrame, category: str, query: str) -> DataFrame:
    """Rows of a category that hold the whole trimmed query."""
    return catalogue.where((F.col("category") == category) & _haystack(catalogue).contains(query.strip().lower()))


def related_items(catalogue: DataFrame, k: int = 6) -> DataFrame:
    """id, other and rank: the first ``k`` of an item's category but itself. The first k + 1 of each category are enough."""
    first = catalogue.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("ord", "id"))).where(F.col("place") <= k + 1)
    pairs = catalogue.select("id", "category").join(first.select(F.col("id").alias("other"), "category", "place"), "category").where("id <> other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "rank")


def recent_items(events: DataFrame, user: str, item: str, ts: str, tie: str, k: int = 6) -> DataFrame:
    """user, item and rank, newest first, each item once; the smaller ``tie`` comes later in a tie of times."""
    last = events.groupBy(user, item).agg(F.max(F.struct(ts, tie)).alias("last"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.col("last").desc(), item))
    return last.withColumn("rank", rank).where(F.col("rank") <= k).select(user, item, "rank")


def recent_not_popular(recent: DataFrame, popular: DataFrame, user: str, item: str, k: int = 4) -> DataFrame:
    left = recent.join(popular, item, "left_anti")
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.col("rank")))
    return left.select(user, item, rank.alias("rank")).where(F.col("rank") <= k)


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(c), "&", "and"), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def classify_routes(hits: DataFrame, catalogue: DataFrame, categories: DataFrame) -> DataFrame:
    """hit_id, type (dashboard, browse, category, item, missing) and target of routes such as ``#category-x`` or ``#/id``."""
    bare = F.regexp_replace(F.coalesce("hash", F.lit("")), "^#/?", "")
    rows = hits.select("hit_id", bare.alias("route"))
    cats = categories.select(F.concat(F.lit("category-"), slug(F.col("category"))).alias("route"), F.col("category").alias("cat")).dropDuplicates(["route"])
    items = catalogue.select(F.col("id").cast("string").alias("route"), F.col("id").cast("string").alias("item")).unionByName(catalogue.select("route", F.col("id").cast("string").alias("item"))).groupBy("route").agg(F.min("item").alias("item"))
    found = rows.join(cats, "route", "left").join(items, "route", "left")
    kind = F.when(F.col("route").isin("", "dashboard"), "dashboard").when(F.col("route") == "browse", "browse").when(F.col("cat").isNotNull(), "category").when(F.col("route").startswith("category-"), "missing").when(F.col("item").isNotNull(), "item").otherwise("missing")
    return found.select("hit_id", kind.alias("type"), F.when(kind == "category", F.col("cat")).when(kind == "item", F.col("item")).alias("target"))


def check_catalogue(catalogue: DataFrame, categories: DataFrame, banned: str) -> DataFrame:
    """rule and violations: unavailable items, repeated routes, unknown categories, names with a banned word."""
    rule = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return (
        rule("unavailable", catalogue.where("coalesce(status, '') <> 'available'"))
        .union(rule("repeated_route", catalogue.groupBy("route").count().where("count > 1")))
        .union(rule("unknown_category", catalogue.join(categories, "category", "left_anti")))
        .union(rule("banned_word", catalogue.where(F.lower("name").rlike(banned))))
    )
