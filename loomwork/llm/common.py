"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group in a table of large rows, and of a batch of these that goes to Python.
ROW_GROUP, BATCH = 16 << 20, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def new_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have: ``wish``, or with as many underscores more as it takes. Case does not count."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a temporary one if Spark runs in this
    process alone; on a cluster that is an error, since no machine would see what another wrote."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/loomwork-{os.getpid()}"


def _settled_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/settled-{spark.sparkContext.applicationId}"


def forget_settled(spark: SparkSession) -> None:
    """Removes all that ``settled`` wrote in this application. To be called once the results that read it are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_settled_dir(spark))
    path.getFileSystem(conf).delete(path, True)


def settled(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: work done once, lineage cut, no loss with an executor.

    A writer first looks at the size of a row group after 100 rows, and 64 MB of rows go to Python at a time. With ``large_rows``,
    of megabytes each, the writer looks after every row, so that neither it nor a reader holds more than ROW_GROUP bytes and a row,
    and so does what goes to Python.
    """
    path = f"{_settled_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if large_rows else {}
    with _small_batches(df.sparkSession) if large_rows else nullcontext():
        df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, rows go to Python in batches of BATCH bytes, or fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    spark.conf.set(name, str(min(size, BATCH) if size > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most_bytes`` in each; one longer text stays whole in its own slice."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)) + 1
        part = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after another, and where each row starts and the last one ends. Null is empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]



def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting integers is many times faster than the hash table behind ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1]))]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1])))
    return values[first], np.diff(first, append=len(values))
