"""Statistics, diffs, markup and page layout of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js_compat as js

WORDS_A_MINUTE = 225
# fixed values: a page of text is 86 characters wide and 43 lines long
PAGE_WIDTH, PAGE_LINES = 86, 43
#: Characters of the WinAnsi encoding beyond printable Latin-1.
WIN_ANSI_EXTRAS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def text_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with words, characters (UTF-16 units), characters_no_spaces, lines and reading_minutes. Null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, characters = js.word_count(text), js.utf16_length(text)
    return df.withColumns({
        "words": words, "characters": characters, "characters_no_spaces": characters - js.space_count(text),
        "lines": F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1), "reading_minutes": F.ceil(words / F.lit(WORDS_A_MINUTE)).cast("int"),
    })


MEASURES = ("words", "characters", "characters_no_spaces", "lines", "reading_minutes")


def text_stats_by(df: DataFrame, dims: Sequence[str], text_col: str = "text", grouping: str = "rollup") -> DataFrame:
    """Totals and means of ``text_stats`` over a rollup or cube of ``dims``, with grouping_id."""
    grouped = getattr(text_stats(df, text_col), grouping)(*dims)
    sums = [F.sum(m).alias(m) for m in MEASURES]
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("texts"), *sums, F.round(F.avg("words"), 6).alias("mean_words"))


#: Size of quantile sketches: ranks are off by less than RANK_ERROR of a group's texts with 99 % confidence.
SKETCH, RANK_ERROR = 800, 0.005


def text_sketches(df: DataFrame, dims: Sequence[str], text_col: str = "text", measures: Sequence[str] = ("words",)) -> DataFrame:
    """``dims`` and a quantile sketch (KLL) of each measure of ``text_stats`` for each of their groups: a small table to keep, since
    sketches of parts and of days can be merged. A group of no more than some hundred texts is held exactly."""
    return text_stats(df, text_col).groupBy(*dims).agg(*(F.kll_sketch_agg_bigint(F.col(m).cast("long"), SKETCH).alias(m) for m in measures))


def text_quantiles_by(sketches: DataFrame, dims: Sequence[str], shares: Sequence[float] = (0.5, 0.9, 0.99), grouping: str = "rollup") -> DataFrame:
    """``dims``, level (grouping_id), measure, share, texts and quantile over a rollup or cube of ``text_sketches``.

    Sketches are merged by group; the texts are not read again. A quantile is a value of the group whose rank is off by less than
    RANK_ERROR of its texts. An empty table gives none.
    """
    measures = [c for c in sketches.columns if c not in dims]
    merged = getattr(sketches, grouping)(*dims).agg(F.grouping_id().cast("int").alias("level"), *(F.kll_merge_agg_bigint(m, SKETCH).alias(m) for m in measures))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("sketch")) for m in measures))).alias("s")
    long = merged.select(*dims, "level", each).where("s.sketch is not null")
    found = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("quantile")) for p in shares))).alias("q")
    rows = long.select(*dims, "level", "s.measure", "s.sketch").where(F.kll_sketch_get_n_bigint("sketch") > 0)
    return rows.select(*dims, "level", "measure", F.kll_sketch_get_n_bigint("sketch").alias("texts"), found).select(*dims, "level", "measure", "q.share", "texts", "q.quantile")


def line_diff(left: DataFrame, right: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, line_no, type, left, right, seq. Line i is compared with line i: equal, else removed and then added.

    The texts of a key are joined once, and their lines compared in the row, so lines are never shuffled. A key on one side
    only has all its lines removed or added.
    """
    joined = left.select(key, F.col(text_col).alias("a_text")).join(right.select(key, F.col(text_col).alias("b_text")), key, "full_outer")
    return exploded_diff(joined, key, "a_text", "b_text")


def exploded_diff(df: DataFrame, key: str | Sequence[str], left: str, right: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    zipped = df.select(*keys, F.arrays_zip(F.coalesce(js.lines(F.col(left)), F.array().cast("array<string>")).alias("a"), F.coalesce(js.lines(F.col(right)), F.array().cast("array<string>")).alias("b")).alias("pairs"))
    rows = zipped.select(*keys, F.posexplode("pairs").alias("at", "pair")).select(*keys, (F.col("at") + 1).alias("line_no"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    row = lambda kind, a, b, seq: F.struct(F.lit(kind).alias("type"), a.alias("left"), b.alias("right"), F.lit(seq).alias("seq"))
    a, b, none = F.col("a"), F.col("b"), F.lit(None).cast("string")
    options = F.array(F.when(a == b, row("same", a, b, 0)), F.when(a.isNotNull() & ~a.eqNullSafe(b), row("removed", a, none, 0)), F.when(b.isNotNull() & ~a.eqNullSafe(b), row("added", none, b, 1)))
    return rows.select(*keys, "line_no", F.explode(F.filter(options, lambda x: x.isNotNull())).alias("d")).select(*keys, "line_no", "d.type", "d.left", "d.right", "d.seq")


def diff_versions(df: DataFrame, key: str, order: str, text_col: str = "text") -> DataFrame:
    """Each version of an item against the one before it; the first is all added."""
    before = F.lag(text_col).over(Window.partitionBy(key).orderBy(order))
    return exploded_diff(df.select(key, order, before.alias("a_text"), F.col(text_col).alias("b_text")), [key, order], "a_text", "b_text")


def diff_summary(diff: DataFrame, key: str) -> DataFrame:
    count = lambda kind: F.count_if(F.col("type") == kind).alias(kind)
    return diff.groupBy(key).agg(count("same"), count("removed"), count("added"), F.count_if(F.col("type") != "same").alias("changed"))


def diff_text(diff: DataFrame, key: str) -> DataFrame:
    """key and patch: a line each, with two spaces, ``- `` or ``+ `` in front."""
    mark = F.when(F.col("type") == "same", "  ").when(F.col("type") == "removed", "- ").otherwise("+ ")
    lined = diff.select(key, F.struct("line_no", "seq", F.concat(mark, F.coalesce("left", "right")).alias("line")).alias("entry"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["line"]), "\n")  # as long as the key's two texts
    return lined.groupBy(key).agg(joined.alias("patch"))


# the order of the tests matters: ### before ## before #
BLOCK_MARKS = (("h3", "### "), ("h2", "## "), ("h1", "# "), ("item", "- "))


def markup_blocks(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, line_no, block and text of every line of marked-up texts."""
    lined = df.select(key, F.posexplode(js.lines(F.col(text_col))).alias("at", "line"))
    block, text = F.when(js.trim(F.col("line")) == "", "gap").otherwise("paragraph"), F.col("line")
    for name, mark in reversed(BLOCK_MARKS):
        fits = F.col("line").startswith(mark)
        block, text = F.when(fits, name).otherwise(block), F.when(fits, F.expr(f"substring(line, {len(mark) + 1})")).otherwise(text)
    return lined.select(key, (F.col("at") + 1).alias("line_no"), block.alias("block"), text.alias("text"))


def block_runs(blocks: DataFrame, key: str) -> DataFrame:
    """key, run_id, block, first_line and n_lines of consecutive lines of one kind."""
    w = Window.partitionBy(key).orderBy("line_no")
    new = F.when(F.lag("block").over(w).eqNullSafe(F.col("block")), 0).otherwise(1)
    runs = blocks.withColumn("new", new).withColumn("run_id", F.sum("new").over(w).cast("int"))
    return runs.groupBy(key, "run_id", "block").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def outside(allowed: str) -> str:
    """A pattern of one character beyond ``allowed``, the inside of a character class."""
    return f"[^{allowed}]"


WIN_ANSI = r"\t\n\r\x20-\x7E\x{A0}-\x{FF}" + WIN_ANSI_EXTRAS


def encodability(df: DataFrame, key: str, text_col: str = "text", allowed: str = WIN_ANSI) -> DataFrame:
    """key, ok and the number of characters that ``allowed`` lacks."""
    bad = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(outside(allowed)))
    return df.select(key, (bad == 0).alias("ok"), bad.alias("bad_chars"))


def bad_characters(df: DataFrame, by: str, text_col: str = "text", allowed: str = WIN_ANSI) -> DataFrame:
    found = df.select(by, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({outside(allowed)})"))).alias("char"))
    return found.groupBy(by, "char").agg(F.count("*").alias("n"))


def wrapped(paragraph: Column, width: int) -> Column:
    """Array of a paragraph's lines: words fill a line while they fit, longer words are cut."""
    words = F.filter(F.split(js.trim(paragraph), f"{js.SPACE}+"), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), ((F.length(w) - 1) / width).cast("int")), lambda i: F.substring(w, i * width + 1, F.lit(width)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        joined = F.when(acc["line"] == "", word).otherwise(F.concat_ws(" ", acc["line"], word))
        fits = F.length(joined) <= width
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, joined).otherwise(word).alias("line"))

    return F.aggregate(pieces, start, step, lambda acc: F.concat(acc["done"], F.array(acc["line"])))


def paginate(df: DataFrame, key: str, text_col: str = "text", width: int = PAGE_WIDTH, per_page: int = PAGE_LINES) -> DataFrame:
    """key, page_idx, line_no (from 0 in the text) and line. Paragraphs are wrapped one by one; a blank one is a blank line."""
    paragraphs = df.select(key, F.posexplode(js.lines(F.coalesce(F.col(text_col), F.lit("")))).alias("par", "paragraph"))
    lined = paragraphs.select(key, "par", F.posexplode(wrapped(F.col("paragraph"), width)).alias("at", "line"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("par", "at")) - 1
    return lined.withColumn("line_no", place).select(key, F.floor(F.col("line_no") / per_page).cast("int").alias("page_idx"), "line_no", "line")


def extract_fields(df: DataFrame, key: str, rules: Sequence[tuple[str, str]], text_col: str, otherwise: str = "present") -> DataFrame:
    """key, label and value of the first match of each (label, pattern); one row ``otherwise`` where nothing matched."""
    found = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), F.regexp_extract(F.coalesce(F.col(text_col), F.lit("")), pattern, 1).alias("value")) for label, pattern in rules)), lambda x: x["value"] != "")
    none = F.array(F.struct(F.lit(otherwise).alias("label"), F.lit("").alias("value")))
    return df.select(key, F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("f")).select(key, "f.label", "f.value")
