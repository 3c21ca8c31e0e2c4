"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model holds a whitespace marker after another character, a merge never crosses from one marked word
to the next, so each distinct marked word needs to be segmented only once. A task keeps a table from distinct chunks to
their ids, sends only chunks it has not met to the library, and joins the ids back by position with array gathers.

The table is one per task, not one for the corpus: joining a corpus-wide table back by position would shuffle a row for
every word of every text, several times the input, while a task's own table already removes most of the library's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

MARKER = "▁"
#: A run of markers with the word after it, a bare run of markers, or a line end (which no longer piece may hold).
CHUNKS = re.compile(f"[ {MARKER}]*[^ {MARKER}\n]+|[ {MARKER}]+|\n")
#: Distinct chunks that a task keeps; beyond it the table is started afresh, which costs time and changes nothing else.
TABLE_SIZE = 200_000


class ChunkTable:
    """Distinct chunks and their ids. Raises ValueError for a model whose pieces may cross chunks."""

    def __init__(self, model_path: str, size: int = TABLE_SIZE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = size
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.independent = not any(re.search(f"[^{MARKER}]{MARKER}", p) or ("\n" in p and len(p) > 1) for p in pieces)
        probe = " a  b\t\nc  d"
        self.independent &= self.model.decode(self.model.encode(probe)) == probe
        self.marker_id = self.model.piece_to_id(MARKER)
        self.line_end = self.model.encode("\n")[1:]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        # what is learned is put at the end of arrays that grow by doubling, so that a slice costs what it has new
        self.flat, self.starts, self.used = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int64), 0

    def learn(self, new: list[str]) -> None:
        """The library puts one marker before a text, so a chunk's own first marker is left out; a chunk without one is
        encoded after a line end, whose ids are cut off again."""
        marked = [c[0] in " ▁" for c in new]
        ids = self.model.encode([c[1:] if m else "\n" + c for c, m in zip(new, marked)], num_threads=1)
        skip = 1 + len(self.line_end)
        found = [(f or [self.marker_id]) if m else self.line_end if c == "\n" else f[skip:] for c, m, f in zip(new, marked, ids)]
        first, n = len(self.index), len(self.index) + len(new)
        self.index.update(zip(new, range(first, n)))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(new))
        upto = self.used + np.cumsum(sizes)
        used = int(upto[-1]) if len(upto) else self.used
        self.flat, self.starts = self._grown(self.flat, used), self._grown(self.starts, n + 1)
        self.flat[self.used : used] = np.fromiter((i for f in found for i in f), dtype=np.int32, count=used - self.used)
        self.starts[first + 1 : n + 1], self.used = upto, used

    @staticmethod
    def _grown(values: np.ndarray, size: int) -> np.ndarray:
        return values if size <= len(values) else np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if not self.independent:
            each = self.model.encode([t or "" for t in texts], num_threads=1)
            return np.array([i for ids in each for i in ids], dtype=np.int32), np.array([len(x) for x in each], dtype=np.int64)
        if len(self.index) > self.size:
            self.clear()
        chunks = [CHUNKS.findall(" " + t) if t else [] for t in texts]
        new = set().union(*chunks).difference(self.index)
        self.learn(sorted(new))
        at = np.fromiter((self.index[c] for row in chunks for c in row), dtype=np.int64)
        per_text = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        first = self.starts[at]
        n = self.starts[at + 1] - first
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(first - (ends - n), n)
        ids = self.flat[places]
        upto = np.concatenate(([0], ends))
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        return ids, np.diff(upto[bounds])


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` (the library's decode of the ids) for every row of ``df``.

    Exactly the library's ``encode`` without begin or end ids and without sampling. Null and empty texts give no ids and
    an empty decoded text. Repeated rows and ids give a row each, an empty table an empty result; other columns of ``df``,
    whatever their names, are left out. Texts are taken whole. A model whose pieces may cross chunks is used text by text.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model_path, table_size)
        for batch in text_slices(batches, "text", 2 << 20):
            ids, counts = chunks.encode(batch.column("text").to_pylist())
            offsets = np.concatenate(([0], np.cumsum(counts)))
            listed = ids.tolist()
            decoded = chunks.model.decode([listed[a:b] for a, b in zip(offsets, offsets[1:])], num_threads=1)
            arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), arrays, pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
