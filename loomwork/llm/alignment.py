"""Alignment of two tokenizations of the same texts.

Tokens of both kinds that overlap form a group; a group ends where a token of either kind does. Groups are found by pointer
jumping: every token points to the token of the other kind that overlaps it and ends farthest to the right, or to itself if none
ends behind it. Replacing every pointer by its target's pointer, for all tokens at once, doubles the way each of them sees, until
all point to the last token of their group, which names it.

Both tokenizers start afresh at a space or a line end behind a visible character. There both kinds end, so no group crosses it,
and each distinct chunk between two such places is encoded and aligned once by a worker.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, text_slices
from .pieces import MARKER, ChunkTable

#: Distinct chunks that a worker keeps; beyond it the table is started afresh, which costs time and changes nothing else.
TABLE_SIZE = 250_000
#: What either tokenizer may read as white space, and those of it that start no chunk.
WHITE = " \n\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + MARKER
INNER = WHITE[2:]
CHUNKS = re.compile(f"[ \n][{WHITE}]*+(?:[^{WHITE}]++(?:[{INNER}][{WHITE}]*+[^{WHITE}]*+)*+)?+")


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: visible Latin-1 stands for itself, the others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(visible))
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the pairs of ids that can end together."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        table = ChunkTable(b_path)
        self.b, self.marker_id = table.model, table.marker_id
        alphabet = byte_alphabet()
        a_pieces = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet.get(c, 63) for c in p) for p in a_pieces]
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # chunks are safe if the first one splits words byte by byte as usual, and the second one's pieces do not cross them
        probe = "a  b\t\n\n c 12 d's\n"
        split = [s for s, _ in self.a.pre_tokenizer.pre_tokenize_str(probe)] if self.a.pre_tokenizer else []
        self.independent = table.independent and self.a.normalizer is None and split == [s.translate({32: "Ġ", 10: "Ċ", 9: "ĉ"}) for s in re.findall(r" ?[a-z]+| ?\d+|'s|\s+(?!\S)|\s+", probe)]
        self.pairs = self._pairs()
        # decimal ids with what may follow them in a group's text
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.written = np.array([[b"%d%c" % (i, end) for i in ids] for end in b",|;"], dtype=object)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARKER, " ").encode()

    def _pairs(self) -> np.ndarray:
        """All (a, b) one of whose bytes end with the other's, packed and sorted: no others can end together. There are at most
        as many as both vocabularies have bytes, times the ids that share the same bytes."""
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for held, tokens in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            for i, t in enumerate(tokens):
                held.setdefault(t, []).append(i)
        found = {a << 32 | b for t, ids in of_a.items() for k in range(len(t)) for b in of_b.get(t[k:], ()) for a in ids}
        found |= {a << 32 | b for t, ids in of_b.items() for k in range(len(t)) for a in of_a.get(t[k:], ()) for b in ids}
        return np.array(sorted(found), dtype=np.int64)


@functools.lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def last_of_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token of both kinds, the first kind's before the second's, the place of the last token of its group. Ends are
    ascending byte offsets, and the last ones are equal."""
    n = len(a_ends)
    over = np.searchsorted(a_ends, b_ends)  # the token that holds a token's last byte
    to = np.concatenate((n + np.searchsorted(b_ends, a_ends), np.where(a_ends[over] > b_ends, over, n + np.arange(len(b_ends)))))
    while True:
        farther = to[to]
        if (farther == to).all():
            return to
        to = farther


class Aligner:
    """A table of distinct chunks, with their tokens' numbers, links and groups."""

    def __init__(self, a_path: str, b_path: str, size: int = TABLE_SIZE):
        self.words, self.size = vocabularies(a_path, b_path), size
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        # tokens of both kinds, and links or, where the bytes differ, -1; where the links start; all links
        self.numbers, self.starts, self.links, self.used = np.zeros((1 << 10, 3), np.int32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), 0

    def _encoded(self, new: list[str]) -> list[list[list[int]]]:
        """The second library puts a marker before a text, so a chunk's own first space is left out; a chunk that starts with a
        line end is encoded behind that marker, which is cut off."""
        w = self.words
        a = [e.ids for e in w.a.encode_batch_fast(new, add_special_tokens=False)]
        b = w.b.encode([c[1:] if c[0] == " " else c for c in new], num_threads=1)
        return [a, [(ids or [w.marker_id]) if c[0] == " " else ids[1:] for c, ids in zip(new, b)]]

    def _same(self, new: list[str], encoded: list[list[list[int]]]) -> list[bool]:
        """Whether both kinds' bytes are the chunk's."""
        held = (self.words.a_bytes, self.words.b_bytes)
        spelled = [[b"".join([tokens[i] for i in ids]) for ids in each] for tokens, each in zip(held, encoded)]
        return [a == b == c.encode() for c, a, b in zip(new, *spelled)]

    def learn(self, new: list[str]) -> None:
        if not new:
            return
        w, first = self.words, len(self.groups)
        encoded = self._encoded(new)
        same = self._same(new, encoded)
        a, b = encoded if all(same) else ([ids for ids, ok in zip(each, same) if ok] for each in encoded)
        a_count, b_count = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids, b_ids = (np.fromiter(itertools.chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, a_count), (b, b_count)))
        a_ends, b_ends = np.cumsum(w.a_size[a_ids]), np.cumsum(w.b_size[b_ids])
        n = len(a_ids)
        last = last_of_groups(a_ends, b_ends) if n else np.zeros(0, np.int64)
        ending = np.flatnonzero(last[n:] == n + np.arange(len(b_ids)))  # tokens of the second kind where both kinds end
        linked = np.searchsorted(w.pairs, a_ids[np.searchsorted(a_ends, b_ends[ending])] << 32 | b_ids[ending])
        per_chunk = np.diff(np.searchsorted(ending, np.concatenate(([0], np.cumsum(b_count)))))
        # groups as text: both kinds in the order of their groups, each id with the mark that follows it
        side = np.arange(n + len(b_ids)) >= n
        key = np.searchsorted(ending, last - n) * 2 + side
        order = np.argsort(key, kind="stable")
        key = key[order]
        closes = np.concatenate((key[1:] != key[:-1], np.ones(min(len(key), 1), bool)))
        parts = w.written[np.where(closes, 1 + side[order], 0), np.concatenate((a_ids, b_ids))[order]].tolist()
        upto = np.concatenate(([0], np.cumsum(a_count + b_count))).tolist()
        texts = iter([b"".join(parts[i:j]) for i, j in zip(upto, upto[1:])])
        self.groups += [next(texts) if ok else b"" for ok in same]
        self.index.update(zip(new, range(first, first + len(new))))
        total = len(self.groups)
        self.numbers, self.starts, self.links = _grown(self.numbers, total), _grown(self.starts, total + 1), _grown(self.links, self.used + len(linked))
        rows = np.tile(np.array([0, 0, -1]), (len(new), 1))
        rows[np.array(same)] = np.stack((a_count, b_count, per_chunk), axis=1)
        self.numbers[first:total] = rows
        self.links[self.used : self.used + len(linked)] = linked
        self.starts[first + 1 : total + 1] = self.used + np.cumsum(np.maximum(rows[:, 2], 0))
        self.used += len(linked)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Tokens of both kinds and links, a row for each text; the groups as text; and all links, as places in ``pairs``."""
        if len(self.index) > self.size or not self.words.independent:
            self.clear()
        chunks = [(CHUNKS.findall(f" {t}") if self.words.independent else [f" {t}"]) if t else [] for t in texts]
        self.learn(list(set().union(*chunks).difference(self.index)))
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(chunks)), np.int64)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))))
        # a text with a chunk whose bytes differ has no tokens: its chunks are left out
        of = np.repeat(np.arange(len(chunks)), np.diff(bounds))
        broken = np.bincount(of[self.numbers[at, 2] < 0], minlength=len(chunks)) > 0
        at, of = at[~broken[of]], of[~broken[of]]
        bounds = np.searchsorted(of, np.arange(len(chunks) + 1))
        numbers = np.diff(np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(self.numbers[at], axis=0, dtype=np.int64)))[bounds], axis=0)
        first, n = self.starts[at], self.numbers[at, 2].astype(np.int64)
        ends = np.cumsum(n)
        links = self.links[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)]
        listed, bounds = at.tolist(), bounds.tolist()
        return numbers, [b"".join([self.groups[k] for k in listed[i:j]])[:-1].decode() for i, j in zip(bounds, bounds[1:])], links


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    return values if size <= len(values) else np.concatenate((values, np.zeros((max(size, 2 * len(values)) - len(values), *values.shape[1:]), values.dtype)))


@functools.lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str, size: int) -> Aligner:
    """One table for all tasks that a worker runs, one after another."""
    return Aligner(a_path, b_path, size)


def align_texts(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` and ``links`` of every row of ``df``.

    ``a_path`` is a byte-level tokenizer's .json, encoding a space and the text, and ``b_path`` a sentencepiece model, which puts
    the space before the text itself. ``groups`` is text such as ``a1,a2|b1;a3|b2,b3``. ``links`` has a place in
    ``vocabularies(a_path, b_path).pairs`` for each pair of tokens that end together.

    Null and empty texts, and those whose tokens' bytes are not the text's (a text with a literal marker), have zeros and nothing
    in the lists. Repeated rows and ids give a row each, an empty table an empty result; other columns of ``df``, whatever their
    names, are left out. Texts are taken whole. Tokenizers whose tokens may cross chunks are aligned text by text.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups"))]
    schema = T.StructType([*fields, T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path, table_size)
        for batch in text_slices(batches, "text", 1 << 20):
            numbers, groups, links = aligner.align(batch.column("text").to_pylist())
            offsets = np.concatenate(([0], np.cumsum(numbers[:, 2])))
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(links))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, numbers.T), pa.array(groups, pa.string()), listed], schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _link_slices(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many links; a row stays whole."""
    part = np.cumsum(batch.column("links").value_lengths().to_numpy().astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def pair_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of all rows hold each pair. There are no more of them than the vocabularies allow, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for part in _link_slices(batch):
                total += np.bincount(part.column("links").flatten().to_numpy(), minlength=n_pairs)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["pair", "n"])

    counted = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_pairs, np.int64)
    counts[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    return counts


def with_link_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of ``align_texts``, less ``links``, with ``n_links``, ``n_best`` (links whose pair is the most frequent of all rows
    for its second token, ties included) and ``count_sum`` (over links, how many of all rows' links hold the pair).

    ``aligned`` is read twice, so it should be written before. The counts of pairs, a table bounded by the vocabularies, are sent
    to every task; nothing is shuffled but each task's counts.
    """
    pairs = vocabularies(a_path, b_path).pairs
    counts = pair_counts(aligned, len(pairs))
    highest = np.zeros(int((pairs & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, pairs & 0xFFFFFFFF, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[pairs & 0xFFFFFFFF]))
    others = [f for f in aligned.schema.fields if f.name != "links"]
    added = ("n_links", "n_best", "count_sum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            for part in _link_slices(batch):
                links = part.column("links")
                flat, sizes = links.flatten().to_numpy(), links.value_lengths().to_numpy().astype(np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                sums = [np.diff(np.concatenate(([0], np.cumsum(x[flat], dtype=np.int64)))[offsets]) for x in (best, counts)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *map(pa.array, (sizes, *sums))], [*(f.name for f in others), *added])

    return aligned.select(*(f.name for f in others), "links").mapInArrow(run, T.StructType([*others, *(T.StructField(c, T.LongType()) for c in added)]))


def settled_digests(aligned: DataFrame) -> DataFrame:
    """The rows of ``align_texts`` with a SHA-256 of the groups in their place, written; without groups it is empty."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return settled(aligned.withColumn("groups_sha256", digest).drop("groups"))
