from loomwork.operators import text
from tests.conftest import rows


def test_stats(spark):
    df = spark.createDataFrame([(1, "one two\nthree"), (2, ""), (3, None), (4, "a b"), (5, "\U0001f600 x"), (6, "a\r\nb"), (7, "  ")], "id long, text string")
    got = {r.id: tuple(r)[2:] for r in text.text_stats(df).collect()}
    assert got[1] == (3, 13, 11, 2, 1)
    assert got[2] == got[3] == (0, 0, 0, 0, 0)
    assert got[4] == (2, 3, 2, 1, 1)
    assert got[5] == (2, 4, 3, 1, 1)
    assert got[6][3] == 2
    assert got[7] == (0, 2, 0, 1, 0)


def test_line_diff_and_patch(spark):
    left = spark.createDataFrame([(1, "a\nb"), (2, "a"), (3, "x")], "k long, text string")
    right = spark.createDataFrame([(1, "a\nc\nd"), (2, "a"), (4, "y")], "k long, text string")
    diff = text.line_diff(left, right, "k")
    assert rows(diff.where("k = 1").select("line_no", "seq", "type", "left", "right")) == [(1, 0, "same", "a", "a"), (2, 0, "removed", "b", None), (2, 1, "added", None, "c"), (3, 1, "added", None, "d")]
    assert dict(rows(text.diff_text(diff, "k"))) == {1: "  a\n- b\n+ c\n+ d", 2: "  a", 3: "- x", 4: "+ y"}
    assert rows(text.diff_summary(diff, "k"))[0] == (1, 1, 1, 2, 3)


def test_diff_versions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x\ny"), ("b", 1, "q")], "k string, v int, text string")
    got = rows(text.diff_versions(df, "k", "v").select("k", "v", "line_no", "type"))
    assert got == [("a", 1, 1, "added"), ("a", 2, 1, "same"), ("a", 2, 2, "added"), ("b", 1, 1, "added")]


def test_blocks_and_runs(spark):
    df = spark.createDataFrame([(1, "# A\n## B\n### C\n- x\n- y\n\n- z\n<script>")], "k long, text string")
    blocks = text.markup_blocks(df, "k")
    assert [r.block for r in blocks.orderBy("line_no").collect()] == ["h1", "h2", "h3", "item", "item", "gap", "item", "paragraph"]
    assert [r.text for r in blocks.orderBy("line_no").collect()][2:4] == ["C", "x"]
    runs = rows(text.block_runs(blocks, "k").where("block = 'item'").select("first_line", "n_lines"))
    assert runs == [(4, 2), (7, 1)]


def test_encodability(spark):
    df = spark.createDataFrame([(1, "café € “q”"), (2, "你 ok"), (3, None)], "k long, text string")
    assert rows(text.encodability(df, "k")) == [(1, True, 0), (2, False, 1), (3, True, 0)]
    assert rows(text.bad_characters(df, "k")) == [(2, "你", 1)]


def wrap(paragraph: str, width: int) -> list[str]:
    done, line = [], ""
    for word in paragraph.split():
        for i in range(0, len(word), width):
            piece = word[i : i + width]
            joined = f"{line} {piece}" if line else piece
            if len(joined) <= width:
                line = joined
            else:
                done.append(line)
                line = piece
    return [*done, line]


def test_paginate_matches_a_plain_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    awkward = spark.createDataFrame([(-1, "a" * 200), (-2, ""), (-3, "x\n\ny"), (-4, None)], "doc_id long, text string")
    both = docs.union(awkward).cache()
    got: dict = {}
    for r in text.paginate(both, "doc_id", width=30, per_page=7).orderBy("doc_id", "line_no").collect():
        assert r.page_idx == r.line_no // 7
        got.setdefault(r.doc_id, []).append(r.line)
    for r in both.collect():
        assert got[r.doc_id] == [line for p in (r.text or "").split("\n") for line in wrap(p, 30)]


def test_extract_fields(spark):
    df = spark.createDataFrame([(1, "<title>T</title><h1>H</h1>"), (2, "none"), (3, None)], "k long, html string")
    got = rows(text.extract_fields(df, "k", [("Title", "<title>([^<]*)"), ("Heading", "<h1>([^<]*)")], "html"))
    assert got == [(1, "Heading", "H"), (1, "Title", "T"), (2, "present", ""), (3, "present", "")]


def test_quantiles_from_merged_sketches(spark):
    """Ranks of merged quantiles are within the stated error; small groups are exact; nulls group as a value of their own."""
    import bisect
    import random

    rng = random.Random(6)
    made = [(rng.choice(["a", "b", None]), rng.choice("xy"), "w " * int(rng.paretovariate(0.7) % 3000)) for _ in range(6000)] + [("c", "x", "one two three")] * 3
    df = spark.createDataFrame(made, "lang string, source string, text string").repartition(7)
    for grouping, levels in (("rollup", {0, 1, 3}), ("cube", {0, 1, 2, 3})):
        found = text.text_quantiles_by(text.text_sketches(df, ["lang", "source"]), ["lang", "source"], (0.1, 0.5, 0.99), grouping).collect()
        assert {r.level for r in found} == levels
        for r in found:
            own = sorted(len(t.split()) for lang, source, t in made if (r.level & 2 or lang == r.lang) and (r.level & 1 or source == r.source))
            assert r.texts == len(own)
            below, upto = bisect.bisect_left(own, r.quantile) / len(own), bisect.bisect_right(own, r.quantile) / len(own)
            assert below <= r.share + text.RANK_ERROR and upto >= r.share - text.RANK_ERROR
        assert {r.quantile for r in found if r.lang == "c"} == {3}
    assert text.text_quantiles_by(text.text_sketches(df.where("false"), ["lang"]), ["lang"]).count() == 0
