"""Token counts through a cache of content digests.

A count depends only on the tokenizer and on the content that it sees. So texts are named by a digest of their normalised
content, and counts are kept in a table for each digest of a tokenizer's version. A run joins its distinct digests to that
table, encodes one text for each digest that is missing, appends these counts, and joins the counts back to its rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_dir, text_slices
from .pieces import MARKER, ChunkTable

COUNTS = "digest binary, n_tokens long"
#: A long text is counted in parts of about so many characters.
PART = 1 << 20


def tokenizer_version(model_path: str) -> str:
    """A digest of all that a count depends on besides the text: the tokenizer's file, and the library and its release."""
    if model_path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(model_path, "rb") as f:
        body = f.read()
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + body).hexdigest()


def normalised(text: Column, model_path: str) -> Column:
    """The content that decides the count: null is empty, and for a model that reads its whitespace marker as a space, the
    marker is one. Nothing else is folded, since every other character may change the count."""
    content = F.coalesce(text, F.lit(""))
    if model_path.endswith(".json"):
        return content
    model = ChunkTable(model_path).model
    alike = all(model.encode(t) == model.encode(t.replace(MARKER, " ")) for t in (f"a{MARKER}b", MARKER, f"a {MARKER}b{MARKER} "))
    return F.translate(content, MARKER, " ") if alike else content


class Counter:
    """Counts tokens exactly as a tokenizer's library does, without begin, end or added special tokens."""

    def __init__(self, model_path: str):
        if model_path.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
            self.tokenizer = Tokenizer.from_file(model_path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.chunks = None
        else:
            self.chunks = ChunkTable(model_path)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.chunks is None:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return np.fromiter((len(e.ids) for e in found), np.int64, len(texts))
        if not self.chunks.independent:
            return self.chunks.encode(texts)[1]
        total = np.zeros(len(texts), np.int64)
        batch, of, size = [], [], 0
        for at, text in enumerate(texts):
            for part in parts(text):
                batch.append(part)
                of.append(at)
                size += len(part)
                if size > PART:
                    np.add.at(total, of, self.chunks.encode(batch)[1])
                    batch, of, size = [], [], 0
        if batch:
            np.add.at(total, of, self.chunks.encode(batch)[1])
        return total


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text cut at single spaces after other characters, where no piece crosses; the encoder puts each space back."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and text[cut - 1] in f" {MARKER}\n":
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 == len(text):
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """What the cache holds for a version. A digest that several runs have appended at a time has a row for each of them."""
    spark.createDataFrame([], COUNTS).write.mode("ignore").parquet(f"{cache}/{version}")  # the first run finds an empty table
    return spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(f"{cache}/{version}")


def count_tokens(df: DataFrame, model_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``digest`` and ``cached`` (the count was there before) of every row.

    ``cache`` is a folder that all executors see and that outlasts the run; without one the run has a cache of its own. It holds
    a table for each tokenizer version, so a changed model starts with an empty one. Runs may share it: what two of them append
    is the same, and a batch is seen once it is whole.

    Null and empty texts have no tokens. Repeated rows and ids give a row each, and equal contents are encoded once; an empty
    table gives an empty result and appends nothing. Other columns of ``df``, whatever their names, are left out. Texts are
    taken whole.
    """
    spark = df.sparkSession
    cache = (cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}").rstrip("/")
    version = tokenizer_version(model_path)
    content = normalised(F.col(text_col), model_path)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    keyed = settled(df.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), digest))

    held = cached_counts(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    asked = settled(keyed.groupBy("digest").agg(F.min("id").alias("id")).join(held, "digest", "left"))
    known = asked.where("n_tokens is not null").select("digest", "n_tokens", F.lit(True).alias("cached"))

    # one row stands for each missing digest; hashing the misses spares a sort of the texts
    misses = asked.where("n_tokens is null").select(F.col("digest").alias("miss"), F.col("id").alias("of")).hint("shuffle_hash")
    texts = df.select(F.col(id_col).alias("id"), content.alias("text"), digest)
    texts = texts.join(misses, (F.col("digest") == F.col("miss")) & F.col("id").eqNullSafe(F.col("of")), "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, done = Counter(model_path), set()
        for batch in text_slices(batches, "text", 2 << 20):
            digests = batch.column("digest").to_pylist()
            new = {d: i for i, d in enumerate(digests) if d not in done}  # repeated rows of one id stand side by side
            done.update(new)
            counts = counter(batch.column("text").take(pa.array(new.values(), pa.int64())).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(counts)], ["digest", "n_tokens"])

    batch = f"{cache}/{version}/batch-{uuid.uuid4().hex}"
    texts.select("text", "digest").mapInArrow(encode, COUNTS).write.parquet(batch)
    fresh = spark.read.schema(COUNTS).parquet(batch).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("cached", F.lit(False))
    counted = keyed.join(known.union(fresh), "digest")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", F.hex("digest").alias("digest"), "cached")
