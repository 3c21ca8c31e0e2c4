"""Delimited text: reading large files in parallel with safe headers, and writing with as few quotes as needed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import distinct_names

LINES = "file string, start long, seq long, value string, quotes long, inside int, even long, odd long"


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Trimmed names; blank ones are column_N, and repeated ones get _2, _3, ... past any name that is taken in the same case."""
    names: list[str] = []
    for at, cell in enumerate(cells, 1):
        name = (cell or "").strip() or f"column_{at}"
        free, n = name, 1
        while free in names:
            n += 1
            free = f"{name}_{n}"
        names.append(free)
    return names


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with what is known within a split: file, start (of the split), seq (rising within it), value, quotes (in
    the line), inside (quotes before the line, modulo 2), and how many lines of the split up to this one start after an even or
    an odd number of quotes. Files are read in splits, and nothing is shuffled."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("seq"), "value"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parity, even, odd = None, 0, 0, 0
        for batch in batches:
            quotes = pc.count_substring(batch.column("value"), '"').to_numpy()
            file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
            split = np.stack((file.indices.to_numpy(), start))
            cuts = [0, *(np.flatnonzero((split[:, 1:] != split[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                here = (file[i].as_py(), int(start[i]))
                if here != held:
                    held, parity, even, odd = here, 0, 0, 0
                before = (parity + np.concatenate(([0], np.cumsum(quotes[i:j])))) % 2
                inside, parity = before[:-1], int(before[-1])
                evens, odds = even + np.cumsum(inside == 0), odd + np.cumsum(inside == 1)
                even, odd = int(evens[-1]), int(odds[-1])
                added = [pa.array(quotes[i:j], pa.int64()), pa.array(inside, pa.int32()), pa.array(evens, pa.int64()), pa.array(odds, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *added], [c.split()[0] for c in LINES.split(", ")])

    return lines.mapInArrow(run, LINES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1), part and text of the records of delimited text files, with line ends kept inside quotes. ``part`` counts
    records within one number, where carriage returns alone end them.

    A quote opens or closes wherever it stands, and a line end outside of quotes ends a record. Two passes find out which are: the
    first one counts the quotes of each split, whose running sum over a file says in which splits the first line is inside a
    quoted cell; in the second one each split numbers its records by itself. So a large file is read by many tasks, and only
    records of several lines are shuffled. An open quote takes in all that follows it in its file.
    """
    lines = scan_lines(spark, path)
    splits = lines.groupBy("file", "start").agg((F.sum("quotes") % 2).alias("parity"), F.max("even").alias("n_even"), F.max("odd").alias("n_odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = splits.withColumn("opened", (F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2).cast("int"))
    started = F.when(F.col("opened") == 0, F.col("n_even")).otherwise(F.col("n_odd"))
    before = opened.withColumn("before", F.coalesce(F.sum(started).over(earlier), F.lit(0))).select("file", "start", "opened", "before")
    number = F.col("before") + F.when(F.col("opened") == 0, F.col("even")).otherwise(F.col("odd"))
    numbered = lines.join(before, ["file", "start"]).select("file", "start", "seq", "value", number.alias("number"), (F.col("inside") == F.col("opened")).alias("first"), (F.col("quotes") % 2).alias("odd"))
    whole = F.col("first") & (F.col("odd") == 0)
    alone = numbered.where(whole).select("file", "number", F.col("value").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("start", "seq", "value")))
    joined = numbered.where(~whole).groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text"))
    return alone.unionByName(joined).select("file", "number", F.posexplode(_at_returns(F.col("text"))).alias("part", "text"))


def _closed(text: Column) -> Column:
    """The text with a quote more where its last one is left open, which changes no cell."""
    return F.when((F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1, F.concat(text, F.lit('"'))).otherwise(text)


def _outside_quotes(text: Column, mark: str) -> Column:
    """What stands between marks outside of quotes, of a text that ends with a mark."""
    m = rf"\x{{{ord(mark):x}}}"
    return F.regexp_extract_all(text, F.lit(rf'([^"{m}]*+(?:"[^"]*+"[^"{m}]*+)*+){m}'), F.lit(1))


def _at_returns(text: Column) -> Column:
    """Records that end with a carriage return alone; one before a line end belongs to that."""
    return F.when(text.contains("\r"), _outside_quotes(F.concat(F.regexp_replace(_closed(text), "\r$", ""), F.lit("\r")), "\r")).otherwise(F.array(text))


def cells(record: Column, sep: str = ",") -> Column:
    """The cells of a record: separators inside quotes are text, a doubled quote inside quotes is one, all other quotes go. A quote
    that is left open runs to the end of the record."""
    bare = lambda c: F.replace(F.regexp_replace(c, F.lit(r'"([^"]*+(?:""[^"]*+)*+)"'), F.lit("$1")), F.lit('""'), F.lit('"'))
    return F.transform(_outside_quotes(F.concat(_closed(record), F.lit(sep)), sep), bare)


def _head(spark: SparkSession, path: str) -> tuple[str | None, bool]:
    """The first record of one of the files, and whether another one follows; only some lines come to the driver. They are mostly
    found in a file's first split; where they are not, all splits are numbered."""
    lines = scan_lines(spark, path).where("start = 0").take(16)
    own = [r for r in lines if r.file == lines[0].file]
    ends = [at for at, r in enumerate(own, 1) if (r.inside + r.quotes) % 2 == 0]
    if ends and ends[0] < len(lines):
        return "\n".join(r.value for r in own[: ends[0]]), True
    records = read_records(spark, path)
    first = records.where("number = 1").orderBy("file", "part").select("text").take(1)
    return (first[0].text, not records.where("number > 1 or part > 0").isEmpty()) if first else (None, False)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header_path: str | None = None, raw_names: bool = True) -> DataFrame:
    """Rows as text columns named by the first row, of ``path`` or of a file of its own, ``header_path``.

    Quoted cells may hold separators, doubled quotes and line ends; short rows are filled with empty text, extra cells and
    all-empty rows are dropped. A file without a row below its header is an error. Only the header comes to the driver. Several
    files without a ``header_path`` must all start with the same header, each its own. The header alone says how many cells a row
    has, and it is left out by its place, so rows that repeat it stay. Large files are read by many tasks (``read_records``).

    Names are the header's own, also where they differ in case only; with ``raw_names=False`` such ones are told apart by _2, _3.
    """
    head, more = _head(spark, header_path or path)
    if head is None or not (more or header_path):
        raise ValueError("a header and a row are needed")
    first = spark.range(1).select(cells(F.get(_at_returns(F.lit(head)), F.lit(0)), sep).alias("c")).first().c
    names = header_names(first) if raw_names else distinct_names(header_names(first))
    records = read_records(spark, path)
    body = records if header_path else records.where("number > 1 or part > 0")
    rows = body.select(cells(F.col("text"), sep).alias("c")).where(F.array_join(F.slice("c", 1, len(names)), "") != "")
    return rows.select(*(F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def quoted(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def delimited_lines(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """key and line: cells joined by commas, quoted only where needed; nulls are empty."""
    return df.select(key, F.concat_ws(",", *(quoted(F.col(c)) for c in cols)).alias("line"))


def write_delimited(df: DataFrame, path: str, cols: Sequence[str]) -> str:
    """Writes the rows in parts and the header to a folder beside them; returns the header."""
    lines = df.select(F.concat_ws(",", *(quoted(F.col(c)) for c in cols)).alias("line"))
    lines.write.mode("overwrite").text(f"{path}/rows")
    header = df.sparkSession.range(1).select(F.concat_ws(",", *(quoted(F.lit(c)) for c in cols)).alias("line"))
    header.write.mode("overwrite").text(f"{path}/header")
    return header.first()[0]
