import datetime as dt

from pyspark.sql import functions as F

from loomwork.operators import catalogue, pages
from tests.conftest import rows

ITEMS = [
    (1, "Merge", "Docs", "join files", ["pdf"], 1, "merge", "available"), (2, "Merge plus", "Docs", "more", ["x"], 2, "plus", "available"), (3, "Split", "Docs", "merge not", [], 3, "merge", "draft"),
    (4, "Crop", "Images", "cut", ["merge"], 4, "crop", "available"), (5, "Submerge", "Images", "", [], 5, "sub", "available"),
]
SCHEMA = "id long, name string, category string, description string, keywords array<string>, ord long, route string, status string"


def test_search_order(spark):
    got = rows(catalogue.keyword_search(spark.createDataFrame(ITEMS, SCHEMA), {1: "MERGE", 2: " ", 3: "merge docs"}, 10), "query_id", "rank")
    assert [(r[1], r[2]) for r in got if r[0] == 1] == [(1, 100), (2, 60), (5, 40), (4, 20), (3, 10)]
    assert [r[1] for r in got if r[0] == 2] == [1, 2, 3, 4, 5]
    assert [r[1] for r in got if r[0] == 3] == [1, 2, 3]


def test_paging_clamps(spark):
    ranked = spark.createDataFrame([(1, i, 0, i) for i in range(1, 13)], "query_id int, id long, score int, rank int")
    got = catalogue.page_of(ranked, 9, 5).collect()
    assert sorted(r.rank for r in got) == [11, 12] and {(r.page, r.total_pages, r.from_row, r.to_row) for r in got} == {(3, 3, 11, 12)}


def test_related_and_checks(spark):
    items = spark.createDataFrame(ITEMS, SCHEMA)
    got = rows(catalogue.related_items(items, 1))
    assert [(r[0], r[1]) for r in got] == [(1, 2), (2, 1), (3, 1), (4, 5), (5, 4)]
    cats = spark.createDataFrame([("Docs", 1)], "category string, cat_ord int")
    assert dict(rows(catalogue.check_catalogue(items, cats, "crop"))) == {"unavailable": 1, "repeated_route": 1, "unknown_category": 2, "banned_word": 1}


def test_routes(spark):
    items = spark.createDataFrame(ITEMS, SCHEMA)
    cats = spark.createDataFrame([("Docs & more", 1)], "category string, cat_ord int")
    hits = spark.createDataFrame([(1, "#"), (2, "#/browse"), (3, "#category-docs-and-more"), (4, "#4"), (5, "#/plus"), (6, "#nope"), (7, None)], "hit_id long, hash string")
    got = {r.hit_id: (r.type, r.target) for r in catalogue.classify_routes(hits, items, cats).collect()}
    assert got == {1: ("dashboard", None), 2: ("browse", None), 3: ("category", "Docs & more"), 4: ("item", "4"), 5: ("item", "2"), 6: ("missing", None), 7: ("dashboard", None)}


def test_recent(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, "a", t(1), 1), (1, "b", t(2), 2), (1, "a", t(3), 3), (1, "c", t(3), 4), (2, "z", t(0), 5)], "u long, i string, ts timestamp, e long")
    recent = catalogue.recent_items(events, "u", "i", "ts", "e", 2)
    assert rows(recent) == [(1, "a", 2), (1, "c", 1), (2, "z", 1)]
    popular = spark.createDataFrame([("c",)], "i string")
    assert rows(catalogue.recent_not_popular(recent, popular, "u", "i")) == [(1, "a", 1), (2, "z", 1)]


def test_ranges(spark):
    specs = [(1, "1-3, 5", 6), (2, "0", 6), (3, "", 6), (4, "3-1", 6), (5, "9", 6), (6, "99999999999", 6), (7, "a", 6), (8, "2,,2, 1", 6), (9, None, 6)]
    got: dict = {}
    for r in pages.expand_ranges(spark.createDataFrame(specs, "k long, spec string, page_count int"), "k").collect():
        got.setdefault(r.k, []).append(r.page_idx if r.ok else r.reason)
    assert got == {1: [0, 1, 2, 4], 2: ["out_of_range"], 3: ["empty"], 4: ["out_of_range"], 5: ["out_of_range"], 6: ["out_of_range"], 7: ["bad_token"], 8: [0, 1], 9: ["empty"]}


def test_page_sets(spark):
    table = spark.createDataFrame([(1, 0, 0), (1, 1, 180), (1, 2, 0), (2, 0, 90)], "d long, page_idx int, rotation int")
    picks = spark.createDataFrame([(1, 1), (2, 0)], "d long, page_idx int")
    chosen = pages.select_pages(table, picks, "d")
    left, rejected = pages.drop_pages(table, picks, "d")
    assert rows(chosen.select("d", "page_idx").union(left.select("d", "page_idx"))) == rows(table.select("d", "page_idx"))
    assert rows(rejected) == [(2,)] and rows(left.select("d", "page_idx", "new_idx")) == [(1, 0, 0), (1, 2, 1)]
    assert rows(pages.rotate_pages(table, picks, "d", 270)) == [(1, 0, 0), (1, 1, 90), (1, 2, 0), (2, 0, 0)]
    assert rows(pages.rotate_pages(pages.rotate_pages(table, None, "d", 90), None, "d", 90))[1] == (1, 1, 0)
    bundle = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "bundle long, d long, ord int")
    assert [r[2] for r in rows(pages.concat_documents(table, bundle, "d"), "new_idx")] == [2, 1, 1, 1]
    assert rows(pages.number_pages(table, "d", "p"))[3] == (2, 0, "p1")


def test_slug(spark):
    df = spark.createDataFrame([("  R & D -- x!",)], "n string")
    assert df.select(catalogue.slug(F.col("n"))).first()[0] == "r-and-d-x"


def test_search_by_a_table_of_queries(spark):
    """The same scores as a query at a time, and no join without an equal key."""
    import random

    rng = random.Random(2)
    words = ["Red", "redder", "blue", "é", "steel", "bolt-9", "x", "RED blue", "日本"]
    made = [(i, rng.choice(words) + " " + rng.choice(words), rng.choice("AB"), f"size {i % 7}", [rng.choice(words) for _ in range(2)], i % 5) for i in range(60)]
    catalogue_df = spark.createDataFrame(made, "id long, name string, category string, description string, keywords array<string>, ord long")
    texts = ["red", "e", "RED  red", "blue steel", "bolt-9 e", "日本", "é", "nothing here", "siz", "", "  ", "red zzz", "size 3", " red　", "b a"]
    asked = spark.createDataFrame([*enumerate(texts), (99, None)], "query_id int, text string")
    got = catalogue.search_table(catalogue_df, asked, 8)
    want = catalogue.keyword_search(catalogue_df, {**dict(enumerate(texts)), 99: ""}, 8)
    assert rows(got) == rows(want) and got.count() > 60
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert catalogue.search_table(catalogue_df, asked.where("false"), 8).count() == 0
    assert catalogue.search_table(catalogue_df.where("false"), asked, 8).count() == 0


def most_rows(df):
    """The most rows that an operator of the plan as it was run gave."""

    def walk(node):
        kind, given = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return max([given.get().value() if given.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_equal_queries_and_equal_rows_meet_once(spark):
    """Rows that are asked by 600 equal queries are not scored for each of them; repeated ids and queries keep their rows."""
    made = [(i // 2, "Red bolt", "Tools", "", [], i) for i in range(600)] + [(900, "Red bolt 7", None, None, ["x"], -1), (901, "bolt", None, None, [], 700)]
    catalogue_df = spark.createDataFrame(made, "id long, name string, category string, description string, keywords array<string>, ord long")
    asked = spark.createDataFrame([(i, ("bolt red", " RED  bolt ")[i % 2]) for i in range(600)] + [(1000, "bolt"), (1000, "7 x")], "query_id int, text string")
    got = catalogue.search_table(catalogue_df, asked, 3)
    found = rows(got, "query_id", "rank")
    assert found[:6] == [(0, 900, 100, 1), (0, 0, 100, 2), (0, 0, 100, 3), (1, 900, 100, 1), (1, 0, 100, 2), (1, 0, 100, 3)]
    assert len(found) == 600 * 3 + 3 + 1 and set(found[-4:]) == {(1000, 901, 100, 1), (1000, 900, 40, 2), (1000, 0, 40, 3), (1000, 900, 60, 1)}
    assert most_rows(got) < 50_000


def test_idle_users_leave_the_state(spark, tmp_path):
    """Late rows move nothing newer, a restart goes on where it was, and who is idle is forgotten."""
    import time

    from loomwork.streaming import streams

    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, streams.STATE_STORE)
    schema = "user_id long, item string, ts long, tie long"

    def feed(rows_of, idle_ms, want, seconds=60):
        """Runs the stream from its checkpoint until ``want`` has come out, or for so long; with timers it never ends by itself."""
        spark.createDataFrame(rows_of, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen: list[tuple] = []
        take = lambda batch, _: seen.extend(tuple(r) for r in batch.collect())
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        running = streams.stream_recent(events, 2, idle_ms=idle_ms).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
        end = time.time() + seconds
        while time.time() < end and not want <= set(seen) and running.isActive:
            time.sleep(0.2)
        running.stop()
        assert want <= set(seen), seen
        return sorted(set(seen), key=repr)

    try:
        assert feed([(1, "a", 10, 0), (1, "b", 20, 0), (2, "z", 5, 0)], 600_000, {(1, "a", 2), (1, "b", 1), (2, "z", 1)}) == [(1, "a", 2), (1, "b", 1), (2, "z", 1)]
        # a new run from the checkpoint: a late row changes nothing, a newer one does
        assert feed([(1, "c", 1, 0)], 600_000, {(1, "a", 2)}) == [(1, "a", 2), (1, "b", 1)]
        # the first user's time runs out: their state is gone, and what comes late starts a new list
        gone = feed([(1, "a", 30, 0)], 1000, {(1, "a", 1), (1, None, 0)})
        assert (1, "b", 2) in gone and not any(r[0] == 2 for r in gone)
        assert feed([(1, "late", 2, 0)], 600_000, {(1, "late", 1)}) == [(1, "late", 1)]
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
