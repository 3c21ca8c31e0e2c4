"""Language-model scores by deleted interpolation.

P(w | h) mixes maximum-likelihood estimates of the bigram, the unigram and a uniform one. The weights depend on how often
the context h was seen (buckets of powers of two) and are learned by expectation-maximisation on counts that the estimates
have not seen: a fold of the training texts is held out for that, and then returned to the final counts.

Every word of the training texts is a context and a predicted word of its own, with its own counts. The CODED most frequent
ones have short codes, so that a bigram of two of them is 32 bits, exactly, and their counts fit a table of fixed size in
every task. Bigrams with another word are dealt by its 64-bit hash to where the word's own count is; for bigrams of two such
words the count of the first is fetched there before. All of that goes by shuffles of packed arrays: a task sends a row for
each bucket of keys that it has any of, with its keys sorted and delta-coded, and gets a row back with the sums of just those
texts that the keys came from. So what is sent grows with the keys, however many buckets there are.

The PAIRS most frequent bigrams, which alone can occur in very many documents each, are counted after combining in each task
and scored from a table of fixed size. A bigram that is sent document by document has about 1 / PAIRS of all tokens at most,
or 1 / CODED where one of its words has no code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, settled, text_slices
from .words import deltas, planes, undeltas, unplanes, word_hashes

#: Codes: 0 starts a text, 1 marks a word without a code of its own, then the words by frequency, among them the end of a text.
START, RARE, WORDS = 0, 1, 2
CODED, PAIRS = (1 << 16) - WORDS, 1 << 20
END = np.uint64(0x1D8E4E27C47D124F)
#: Parts of a corpus: counts are estimated on the first, weights learned on the second, and neither sees the third.
ESTIMATE, HELD, UNSEEN = 0, 1, 2
#: Kinds of packed rows: pairs of coded words, a slice's own sums, pairs by which of their words have no code, and counts of
#: words and of words before a bucket's.
BOTH_CODED, HEAD, RARE_FIRST, RARE_SECOND, RARE_BOTH, WORD_COUNTS, COUNTS_BEFORE = 0, 2, 3, 4, 5, 6, 7
#: Sums travel as whole multiples of 1 / FINE, so that they do not depend on the order in which they are added.
FINE = 1 << 36
BASE_ADD, EM_ROUNDS, KEYS_A_BUCKET, KEYS_A_TASK = 0.1, 15, 1_000_000, 6_000_000
_ODD, _BACK = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)


class Places:
    """Where each of many values is in an array of distinct ones, by a table of the top bits of their hashes.

    A value takes one look at the table and one more for each other that shares its slot, where a binary search takes some
    twenty in memory far apart."""

    def __init__(self, hashes: np.ndarray):
        self.shift = hashes.dtype.type(8 * hashes.itemsize - max(4, min(21, int(len(hashes)).bit_length() + 3)))
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]
        slots = 1 << (8 * hashes.itemsize - int(self.shift))
        held = np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=slots)
        self.deepest = int(held.max())
        self.first = np.concatenate(([0], np.cumsum(held))).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The place of each of ``h``, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        slot = (h >> self.shift).astype(np.int64)
        at = self.first[slot]
        here = np.minimum(at, len(self.hashes) - 1)
        out = np.where(self.hashes[here] == h, self.order[here], np.int32(-1)).astype(np.int64)
        left = np.flatnonzero((out < 0) & (at + 1 < self.first[slot + 1])) if self.deepest > 1 else np.zeros(0, np.int64)
        for deep in range(1, self.deepest):
            here = self.first[slot[left]] + deep
            hit = self.hashes[here] == h[left]
            out[left[hit]] = self.order[here[hit]]
            more = ~hit & (here + 1 < self.first[slot[left] + 1])
            left = left[more]
        return out


@dataclass
class Model:
    """The parts of the model that have a fixed size, sent to every task."""

    hashes: np.ndarray  # of the vocabulary, sorted
    classes: np.ndarray  # of each of them
    counts: np.ndarray  # of each class as a word, in all training texts
    contexts: np.ndarray  # of each class as a context
    tokens: int  # in training texts
    distinct: int
    weights: np.ndarray | None = None  # for each context bucket: bigram, unigram, uniform
    frequent: np.ndarray | None = None  # sorted keys of the most frequent pairs of classes
    times: np.ndarray | None = None  # and how often they occur

    def class_of(self, h: np.ndarray) -> np.ndarray:
        at = self._places.of(h)
        # the last one is what -1 stands for
        return np.append(self.classes, RARE)[at].astype(np.int64)

    @cached_property
    def _places(self) -> Places:
        return Places(self.hashes)

    def __getstate__(self) -> dict:
        """Without the table of places, which each task makes anew."""
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    @property
    def outcomes(self) -> int:
        """What the uniform estimate shares its mass among: all words and one that is not known."""
        return self.distinct + 1

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + BASE_ADD) / (self.tokens + BASE_ADD * (self.distinct + 1)))

    def bigram(self, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(second class | first class) from the pairs' counts."""
        one, two = keys >> 16, keys & 0xFFFF
        return self.mixed(self.contexts[one], self.counts[two], c)

    def mixed(self, before: np.ndarray, word: np.ndarray, both: np.ndarray) -> np.ndarray:
        """log10 P(second | first) from the counts of the first as a context, of the second, and of the pair."""
        w = self.weights[bucket_of(before)]
        return np.log10(w[:, 0] * both / np.maximum(before, 1) + w[:, 1] * word / max(self.tokens, 1) + w[:, 2] / self.outcomes)


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(count, 0) + 1.0)).astype(np.int64)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every token with each text's END, the text it is in, number of tokens of each text)."""
    words, bounds = word_hashes(batch.column("text"))
    n = np.diff(bounds) + 1
    ends = np.cumsum(n) - 1
    out = np.full(int(n.sum()), END, dtype=np.uint64)
    is_word = np.ones(len(out), dtype=bool)
    is_word[ends] = False
    out[is_word] = words
    return out, np.repeat(np.arange(len(n)), n), n


def _pairs(classes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each token's class with the one before it, as one key."""
    before = np.concatenate(([START], classes[:-1]))
    before[np.cumsum(n) - n] = START
    return before << 16 | classes


def _spread(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(_ODD)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _gathered(spread: np.ndarray) -> np.ndarray:
    return ((spread.astype(np.uint64) * np.uint64(_BACK)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _cuts(ascending: np.ndarray, buckets: int) -> list[int]:
    """Where each of ``buckets`` equal ranges of a 32- or 64-bit hash starts in a sorted array."""
    top = 8 * ascending.itemsize
    edges = np.array([(i << top) // buckets for i in range(1, buckets)], dtype=ascending.dtype)
    return [0, *np.searchsorted(ascending, edges).tolist(), len(ascending)]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The number of the range of ``_cuts`` that each 64-bit hash is in."""
    return np.searchsorted(np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64), h, side="right")


def _ranks(values: np.ndarray) -> np.ndarray:
    """For each of some 64-bit hashes how many distinct ones are smaller."""
    low = np.uint64(max(len(values) - 1, 0).bit_length())
    order = np.sort(values >> low << low | np.arange(len(values), dtype=np.uint64))
    order = (order & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
    ascending = values[order]
    if (ascending[1:] < ascending[:-1]).any():  # two that differ in their last bits only
        order = np.argsort(values, kind="stable")
        ascending = values[order]
    rank = np.zeros(len(values), dtype=np.uint64)
    rank[order[1:]] = np.cumsum(ascending[1:] != ascending[:-1])
    return rank


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the columns, the first one first, and where in it a new combination starts.

    Where columns without negative values and the place fit 64 bits, 64-bit ones by rank if need be, these are sorted as one
    number, many times faster."""
    n = len(columns[0])
    if len(columns) > 1:
        columns = tuple(_ranks(c) if c.dtype == np.uint64 else c for c in columns)
    bits = [int(c.max()).bit_length() if n and c.dtype.kind in "ui" else 0 for c in columns]
    low = max(n - 1, 0).bit_length()
    if n and sum(bits) + low <= 64 and all(c.dtype.kind == "u" or c.dtype.kind == "i" and c.min() >= 0 for c in columns):
        packed = columns[0].astype(np.uint64)
        for c, b in zip(columns[1:], bits[1:]):
            packed = packed << np.uint64(b) | c.astype(np.uint64)
        packed = packed << np.uint64(low) | np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
        packed >>= np.uint64(low)
        new = np.ones(n, dtype=bool)
        np.not_equal(packed[1:], packed[:-1], out=new[1:])
        return order, new
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, new


def _summed(parts: list[tuple[np.ndarray, np.ndarray]], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several (keys, counts) and their summed counts."""
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), dtype=bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_rows(keys: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """A row for each bucket that has any of the keys of the estimates or of the held-out texts."""
    cuts = [_cuts(k, buckets) for k, _ in keys]
    used = [b for b in range(buckets) if any(c[b + 1] > c[b] for c in cuts)]
    packed = [x for (k, n), c in zip(keys, cuts) for x in ([deltas(k[c[b] : c[b + 1]]) for b in used], [planes(n[c[b] : c[b + 1]].astype(np.uint32)) for b in used])]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", "k0", "n0", "k1", "n1"])


def _word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket of words of the training texts: their hashes, estimate and held counts, packed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = 0

        def rows() -> pa.RecordBatch:
            keys = [counted(np.concatenate(x)) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in held]
            return _count_rows(keys, buckets)

        for batch in text_slices(batches, "text", 2 << 20):
            h, doc, _ = _tokens(batch)
            part = np.asarray(batch.column("part"))[doc]
            for p in (ESTIMATE, HELD):
                held[p].append(h[part == p])
            size += len(h)
            if size > KEYS_A_TASK:
                yield rows()
                held, size = [[], []], 0
        if size:
            yield rows()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for p in ("0", "1"):
            parts = [(undeltas(k, "<u8"), unplanes(n, "<u4")) for k, n in zip(table.column("k" + p).to_pylist(), table.column("n" + p).to_pylist())]
            k, n = _summed(parts, "<u8")
            keys.append(k)
            counts.append(n)
        both, total = _summed(list(zip(keys, counts)), "<u8")
        found = [np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)]
        for p in (0, 1):
            found[p][np.searchsorted(both, keys[p])] = counts[p]
        return pa.table({"bucket": table.column("bucket")[:1], "keys": pa.array([deltas(both)], pa.binary()), **{c: pa.array([planes(f.astype(np.int64))], pa.binary()) for c, f in zip(("estimate", "held"), found)}})

    packed = texts.where(F.col("part") != UNSEEN).mapInArrow(count, "bucket int, k0 binary, n0 binary, k1 binary, n1 binary")
    return packed.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, estimate binary, held binary")


def _vocabulary(packed: DataFrame, size: int) -> tuple[Model, Model]:
    """The final model and the one of the estimates alone, over the same classes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, e, h in zip(*(batch.column(c).to_pylist() for c in ("keys", "estimate", "held"))):
                yield pa.RecordBatch.from_arrays([pa.array(undeltas(k, "<u8").view(np.int64)), *(pa.array(unplanes(x, "<i8")) for x in (e, h))], ["h", "estimate", "held"])

    words = packed.mapInArrow(unpack, "h long, estimate long, held long")
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("estimate"), F.lit(0)).alias("e"), F.coalesce(F.sum("held"), F.lit(0)).alias("h")).first()
    top = [tuple(r) for r in words.orderBy((F.col("estimate") + F.col("held")).desc(), "h").limit(size).collect()]
    end = int(END.astype(np.int64))
    # the end of a text has a class of its own, even in the unlikely case that other words push it out
    if total["v"] and all(r[0] != end for r in top):
        top[-1] = tuple(words.where(F.col("h") == end).first())
    h = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    models = []
    for counts, tokens in (([r[1] + r[2] for r in top], total["e"] + total["h"]), ([r[1] for r in top], total["e"])):
        c = np.zeros(WORDS + len(top), dtype=np.int64)
        c[WORDS:] = counts
        c[RARE] = tokens - c.sum()
        contexts = c.copy()
        at_end = WORDS + next((i for i, r in enumerate(top) if r[0] == end), 0)
        if top:
            contexts[START], contexts[at_end] = c[at_end], 0
        models.append(Model(h[order], WORDS + order, c, contexts, tokens, total["v"]))
    return models[0], models[1]


def _pair_counts(texts: DataFrame, final: Model, estimate: Model, buckets: int) -> DataFrame:
    """From counts of all pairs of coded words, held-out events for the weights (kind 0) and the most frequent pairs (kind 1).

    An event is a context bucket, the two estimates f12 and f1, and how often it was held out; events of pairs that the
    estimates have not seen differ only in f1 and are merged.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = 0

        def rows() -> pa.RecordBatch:
            keys = [counted(np.concatenate(x)) if x else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for x in held]
            return _count_rows(keys, buckets)

        for batch in text_slices(batches, "text", 2 << 20):
            h, doc, n = _tokens(batch)
            pairs, part = _pairs(final.class_of(h), n), np.asarray(batch.column("part"))[doc]
            known = (pairs >> 16 != RARE) & (pairs & 0xFFFF != RARE)  # the others are counted by ``_rare_events``
            pairs, part = pairs[known], part[known]
            keys = _spread(pairs)
            for p in (ESTIMATE, HELD):
                held[p].append(keys[part == p])
            size += len(h)
            if size > KEYS_A_TASK:
                yield rows()
                held, size = [[], []], 0
        if size:
            yield rows()

    def merge(table: pa.Table) -> pa.Table:
        got = []
        for p in ("0", "1"):
            got.append(_summed([(undeltas(k, "<u4"), unplanes(n, "<u4")) for k, n in zip(table.column("k" + p).to_pylist(), table.column("n" + p).to_pylist())], "<u4"))
        (ek, en), (hk, hn) = got
        at = np.minimum(np.searchsorted(ek, hk), max(len(ek) - 1, 0))
        seen = (ek[at] == hk) if len(ek) else np.zeros(len(hk), dtype=bool)
        keys = _gathered(hk)
        one, two = keys >> 16, keys & 0xFFFF
        b = bucket_of(estimate.contexts[one])
        fresh, times = _summed([((b << 16 | two)[~seen], hn[~seen])], "<i8")
        f12 = (en[at][seen] if len(ek) else en[:0]) / np.maximum(estimate.contexts[one[seen]], 1)
        n1 = max(estimate.tokens, 1)
        events = (
            np.concatenate((b[seen], fresh >> 16)).astype(np.uint8), np.concatenate((f12, np.zeros(len(fresh)))),
            np.concatenate((estimate.counts[two[seen]], estimate.counts[fresh & 0xFFFF])) / n1, np.concatenate((hn[seen], times)).astype(np.int64),
        )
        both, total = _summed(got, "<u4")
        keys = _gathered(both)
        # keys are dealt by hash, so each bucket's share of the table is made of its own most frequent ones
        often = np.lexsort((keys, -total))[: max(1, PAIRS // buckets)]
        none = np.zeros(0).tobytes()
        return pa.table({
            "kind": pa.array([0, 1], pa.int32()), "b": pa.array([events[0].tobytes(), none], pa.binary()), "f12": pa.array([events[1].tobytes(), none], pa.binary()),
            "f1": pa.array([events[2].tobytes(), keys[often].astype(np.int64).tobytes()], pa.binary()), "n": pa.array([events[3].tobytes(), total[often].tobytes()], pa.binary()),
        })

    packed = texts.where(F.col("part") != UNSEEN).mapInArrow(count, "bucket int, k0 binary, n0 binary, k1 binary, n1 binary")
    return packed.groupBy("bucket").applyInArrow(merge, "kind int, b binary, f12 binary, f1 binary, n binary")


def _rare_facts(texts: DataFrame, words: DataFrame, model: Model, buckets: int) -> DataFrame:
    """For each bucket the counts of its words (WORD_COUNTS) and those of the words without a class that come before
    words of the bucket without a class (COUNTS_BEFORE)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 8 << 20):
            h, _, n = _tokens(batch)
            classes = model.class_of(h)
            both = np.flatnonzero((classes == RARE) & (_pairs(classes, n) >> 16 == RARE))
            before, to = h[both - 1], _bucket(h[both], buckets)
            order, new = _groups(before, to)
            before, to = before[order][new], to[order][new].astype(np.uint32)
            cuts = _cuts(before, buckets)
            rows = [(b, deltas(before[i:j]), planes(to[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([COUNTS_BEFORE] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)), pa.array([b""] * len(rows), pa.binary())], ["bucket", "kind", "keys", "docs", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        counts = _known(table, WORD_COUNTS)
        asked = [(k, d) for kind, k, d in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "docs"))) if kind == COUNTS_BEFORE]
        h = np.concatenate([np.zeros(0, np.uint64), *(undeltas(k, "<u8") for k, _ in asked)])
        to = np.concatenate([np.zeros(0, np.uint32), *(unplanes(d, "<u4") for _, d in asked)])
        order, new = _groups(to, h)
        h, to = h[order][new], to[order][new]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(to), 1), dtype=bool), to[1:] != to[:-1])))
        rows = [(int(to[i]), h[i:j]) for i, j in zip(first, [*first[1:], len(to)])]
        found = [_looked_up(counts, x) for _, x in rows]
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([COUNTS_BEFORE] * len(rows), pa.int32()), "keys": pa.array([deltas(r[1]) for r in rows], pa.binary()),
            **{c: pa.array([planes(f[i].astype(np.int64)) for f in found], pa.binary()) for i, c in enumerate(("docs", "counts"))},
        })

    schema = "bucket int, kind int, keys binary, docs binary, counts binary"
    own = words.select("bucket", F.lit(WORD_COUNTS).alias("kind"), "keys", F.col("estimate").alias("docs"), F.col("held").alias("counts"))
    before = texts.mapInArrow(ask, schema).union(own).groupBy("bucket").applyInArrow(answer, schema)
    return own.union(settled(before))


def _known(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, estimate and held counts from a bucket's rows of facts of this kind."""
    rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "docs", "counts"))) if r[0] == kind]
    h = np.concatenate([np.zeros(0, np.uint64), *(undeltas(r[1], "<u8") for r in rows)])
    order = np.argsort(h, kind="stable")
    return h[order], *(np.concatenate([np.zeros(0, np.int64), *(unplanes(r[i], "<i8") for r in rows)])[order] for i in (2, 3))


def _looked_up(known: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and held counts of words; 0 where the training texts do not have them."""
    keys, *counts = known
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return tuple(np.where(keys[at] == h, c[at], 0) for c in counts)


def _rare_rows(h: np.ndarray, classes: np.ndarray, n: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
    """(kind, bucket, keys, others, docs, times) of the pairs with a word that has no class, distinct by document. The key
    is the second word's hash, or the first's where only that has no class; the other is the other word's hash or class."""
    before, one = np.concatenate((h[:1], h[:-1])), _pairs(classes, n) >> 16
    for kind, chosen, keys, others in (
        (RARE_FIRST, (one == RARE) & (classes != RARE), before, classes), (RARE_SECOND, (one != RARE) & (classes == RARE), h, one), (RARE_BOTH, (one == RARE) & (classes == RARE), h, before),
    ):
        keys, others, who = keys[chosen], others[chosen].astype(np.uint64 if kind == RARE_BOTH else np.uint16), docs[chosen].astype(np.uint32)
        order, new = _groups(keys, others, who)
        times = np.diff(np.flatnonzero(new), append=len(order)).astype(np.uint32)
        keys, others, who = keys[order][new], others[order][new], who[order][new]
        cuts = _cuts(keys, buckets)
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                yield kind, b, deltas(keys[i:j]), planes(others[i:j]), planes(who[i:j]), planes(times[i:j])


def _rare_counts(kind: int, keys: np.ndarray, others: np.ndarray, words: tuple, before: tuple, final: Model, estimate: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each pair's first word as a context and of its second word, of all training texts or of the estimates."""
    total = lambda found: found[0] if estimate else found[0] + found[1]
    model, own = estimate or final, total(_looked_up(words, keys))
    if kind == RARE_FIRST:
        return own, model.counts[others]
    return (model.contexts[others] if kind == RARE_SECOND else total(_looked_up(before, others))), own


def _rare_events(texts: DataFrame, final: Model, estimate: Model, facts: DataFrame, buckets: int) -> DataFrame:
    """Held-out events as of ``_pair_counts``, of the pairs with a word that has no class."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 8 << 20):
            h, doc, n = _tokens(batch)
            rows = list(_rare_rows(h, final.class_of(h), n, np.asarray(batch.column("part"))[doc], buckets))
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (2, 4, 5, 3))], ["bucket", "kind", "keys", "docs", "counts", "other"])

    def merge(table: pa.Table) -> pa.Table:
        words, before = _known(table, WORD_COUNTS), _known(table, COUNTS_BEFORE)
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "other", "docs", "counts"))))
        seen, fresh = [], []
        for kind in (RARE_FIRST, RARE_SECOND, RARE_BOTH):
            mine = [r for r in rows if r[0] == kind]
            if not mine:
                continue
            keys, others = np.concatenate([undeltas(r[1], "<u8") for r in mine]), np.concatenate([unplanes(r[2], "<u8" if kind == RARE_BOTH else "<u2") for r in mine])
            part, times = (np.concatenate([unplanes(r[i], "<u4") for r in mine]).astype(np.int64) for i in (3, 4))
            order, new = _groups(keys, others)
            which = np.cumsum(new) - 1
            part, times = part[order], times[order]
            held = np.bincount(which, times * (part == HELD)).astype(np.int64)
            events = np.flatnonzero(held)
            both = np.bincount(which, times * (part == ESTIMATE))[events]
            one, two = _rare_counts(kind, keys[order][new][events], others[order][new][events], words, before, final, estimate)
            b, n, has = bucket_of(one), held[events], both > 0
            seen.append((b[has], (both / np.maximum(one, 1))[has], two[has], n[has]))
            fresh.append(((b << 48 | two)[~has], n[~has]))
        b, f12, two, n = (np.concatenate([x[i] for x in seen]) if seen else np.zeros(0) for i in range(4))
        key, times = _summed(fresh, "<i8")
        columns = {"b": np.concatenate((b, key >> 48)).astype(np.uint8), "f12": np.concatenate((f12, np.zeros(len(key)))), "f1": np.concatenate((two, key & (1 << 48) - 1)) / max(estimate.tokens, 1), "n": np.concatenate((n, times)).astype(np.int64)}
        return pa.table({"kind": pa.array([0], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()}})

    sent = texts.where(F.col("part") != UNSEEN).mapInArrow(send, "bucket int, kind int, keys binary, docs binary, counts binary, other binary")
    return sent.unionByName(facts, allowMissingColumns=True).groupBy("bucket").applyInArrow(merge, "kind int, b binary, f12 binary, f1 binary, n binary")


def learn_weights(events: DataFrame, classes: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights of each context bucket by expectation-maximisation; a bucket without events has those of all."""
    buckets = 64
    weights = np.full((buckets + 1, 3), 1 / 3)

    for _ in range(rounds):
        now = weights.copy()

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((buckets + 1, 3))
            for batch in batches:
                for b, f12, f1, n in zip(*(batch.column(c).to_pylist() for c in ("b", "f12", "f1", "n"))):
                    b, n = np.frombuffer(b, np.uint8).astype(np.int64), np.frombuffer(n, np.int64)
                    parts = np.stack([np.frombuffer(f12), np.frombuffer(f1), np.full(len(b), 1 / classes)], axis=1)
                    for at, row in ((b, now[b]), (np.full(len(b), buckets), now[np.full(len(b), buckets)])):
                        got = parts * row
                        got *= (n / np.maximum(got.sum(axis=1), 1e-300))[:, None]
                        for j in range(3):
                            sums[:, j] += np.bincount(at, got[:, j], minlength=buckets + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 1), pa.int32()), *(pa.array(sums[:, j]) for j in range(3))], ["b", "s0", "s1", "s2"])

        rows = events.where("kind = 0").mapInArrow(expect, "b int, s0 double, s1 double, s2 double").groupBy("b").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(3))).collect()
        for b, *sums in rows:
            if sum(sums) > 0:
                weights[b] = np.array(sums) / sum(sums)
    seen = {r[0] for r in rows if sum(r[1:]) > 0} if rounds and rows else set()
    for b in range(buckets):
        if b not in seen:
            weights[b] = weights[buckets]
    # the uniform estimate keeps a trace of weight, so that nothing has probability 0
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)
    return weights / weights.sum(axis=1, keepdims=True)


def _scored(texts: DataFrame, model: Model, buckets: int, id_type: T.DataType, id_col: str, facts: DataFrame) -> DataFrame:
    """Sends each text's keys to where they are counted, and their sums back to the slice of texts they came from.

    A text is named by twice its place in the slice, and one more if it is a training text."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = model.base(model.counts), model.bigram(model.frequent, model.times)
        places = Places(_spread(model.frequent))
        for number, batch in enumerate(text_slices(batches, "text", 8 << 20)):
            h, doc, n = _tokens(batch)
            texts_here, classes = len(n), model.class_of(h)
            coded, pairs = classes != RARE, _pairs(classes, n)
            spread = _spread(pairs)
            at = places.of(spread)
            near = at >= 0
            far = ~near & coded & (pairs >> 16 != RARE)
            known = doc[coded]
            head = np.stack([
                np.bincount(doc[near], table[at[near]], minlength=texts_here), np.bincount(known, base[classes[coded]], minlength=texts_here),
                np.bincount(known, model.counts[classes[coded]] > 0, minlength=texts_here), n.astype(float),
            ])
            named = doc << 1 | (np.asarray(batch.column("part")) != UNSEEN)[doc]
            rows = [(HEAD, number % buckets, head.tobytes(), b"", b"", b"")]
            both, times = counted(spread[far].astype(np.uint64) << np.uint64(32) | named[far].astype(np.uint64))
            keys, who, times = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32), times.astype(np.uint32)
            cuts = _cuts(keys, buckets)
            rows += [(BOTH_CODED, b, deltas(keys[i:j]), b"", planes(who[i:j]), planes(times[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            rows += _rare_rows(h, classes, n, named, buckets)
            ids = pa.array([batch.column("id").to_pylist()] + [None] * (len(rows) - 1), pa.list_(batch.column("id").type))
            column = lambda i, kind: pa.array([r[i] for r in rows], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [column(1, pa.int32()), pa.array([TaskContext.get().partitionId() << 32 | number] * len(rows), pa.int64()), column(0, pa.int32()), *(column(i, pa.binary()) for i in (2, 4, 5)), ids, column(3, pa.binary())],
                ["bucket", "slice", "kind", "keys", "docs", "counts", "ids", "other"],
            )

    def count(table: pa.Table) -> pa.Table:
        slices, kinds = (table.column(c).to_pylist() for c in ("slice", "kind"))
        read = lambda c, i, width: unplanes(table.column(c)[i].as_py(), width)
        words, before = _known(table, WORD_COUNTS), _known(table, COUNTS_BEFORE)
        found: list[tuple] = []  # (slice's number, text's name, score, base, known) of every key and text
        asking = sorted({s for s, k in zip(slices, kinds) if k not in (HEAD, WORD_COUNTS, COUNTS_BEFORE)})
        number = {s: i for i, s in enumerate(asking)}
        for kind, width in ((BOTH_CODED, "<u4"), (RARE_FIRST, "<u8"), (RARE_SECOND, "<u8"), (RARE_BOTH, "<u8")):
            rows = [i for i, k in enumerate(kinds) if k == kind]
            if not rows:
                continue
            k = [undeltas(table.column("keys")[i].as_py(), width) for i in rows]
            place = np.repeat([number[slices[i]] for i in rows], [len(x) for x in k])
            k, who, times = np.concatenate(k), np.concatenate([read("docs", i, "<u4") for i in rows]), np.concatenate([read("counts", i, "<u4") for i in rows])
            others = np.zeros(0) if kind == BOTH_CODED else np.concatenate([read("other", i, "<u8" if kind == RARE_BOTH else "<u2") for i in rows])
            order, new = _groups(k) if kind == BOTH_CODED else _groups(k, others)
            which, first = np.cumsum(new) - 1, order[new]
            place, who, times = place[order], who[order], times[order].astype(np.int64)
            c = np.bincount(which, times * (who & 1))
            base = known = np.zeros(len(first))
            if kind == BOTH_CODED:
                score = model.bigram(_gathered(k[first]), c)
            else:
                one, two = _rare_counts(kind, k[first], others[first], words, before, model, None)
                score = model.mixed(one, two, c)
                if kind != RARE_FIRST:  # the coded word's own sums are in its slice's head
                    base, known = model.base(two), (two > 0).astype(float)
            fine = lambda v: (np.rint(v * FINE).astype(np.int64))[which] * times  # noqa: B023, E731
            found.append((place, who, fine(score), fine(base), known[which].astype(np.int64) * times))
        out = []
        if found:
            place, who, *values = (np.concatenate([f[i] for f in found]) for i in range(5))
            order, new = _groups(place, who)
            starts = np.flatnonzero(new)
            sums = [np.add.reduceat(v[order], starts) for v in values]
            place, who = place[order][starts], who[order][starts] >> 1
            cuts = np.searchsorted(place, np.arange(len(asking) + 1))
            for s, i, j in zip(asking, cuts, cuts[1:]):
                out.append((s, deltas(who[i:j]), planes(-sums[0][i:j]), planes(-sums[1][i:j]), planes(sums[2][i:j].astype(np.uint32)), None))
        out += [(slices[i], table.column("keys")[i].as_py(), None, None, None, table.column("ids")[i].as_py()) for i, k in enumerate(kinds) if k == HEAD]
        kinds_out = (pa.int64(), *[pa.binary()] * 4, table.schema.field("ids").type)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds_out)], ["slice", "texts", "score", "base", "known", "ids"])

    def finish(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("texts", "score", "base", "known", "ids"))))
        head, ids = next((r[0], r[4]) for r in rows if r[4] is not None)
        n = len(ids)
        own, added = np.frombuffer(head).reshape(4, n), np.zeros((3, n), dtype=np.int64)
        for texts_of, score, base, known, _ in (r for r in rows if r[4] is None):
            at = undeltas(texts_of, "<u4")
            added[0, at] -= unplanes(score, "<i8")
            added[1, at] -= unplanes(base, "<i8")
            added[2, at] += unplanes(known, "<u4")
        return pa.table({
            id_col: pa.array(ids, table.schema.field("ids").type.value_type), "n_tokens": own[3].astype(np.int64), "n_known": np.rint(own[2]).astype(np.int64) + added[2],
            "train_tokens": np.full(n, model.tokens, dtype=np.int64), "base_score": own[1] + added[1] / FINE, "score": own[0] + added[0] / FINE,
        })

    binary = lambda *names: [T.StructField(c, T.BinaryType()) for c in names]
    ids_field = T.StructField("ids", T.ArrayType(id_type))
    sent_schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("slice", T.LongType()), T.StructField("kind", T.IntegerType()), *binary("keys", "docs", "counts"), ids_field, *binary("other")])
    back_schema = T.StructType([T.StructField("slice", T.LongType()), *binary("texts", "score", "base", "known"), ids_field])
    out_schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    sent = texts.mapInArrow(send, sent_schema).unionByName(facts, allowMissingColumns=True)
    back = sent.groupBy("bucket").applyInArrow(count, back_schema)
    return back.groupBy("slice").applyInArrow(finish, out_schema)


def score_texts(df: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", coded: int = CODED) -> DataFrame:
    """id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for every row of ``df``.

    ``part`` says for each row whether the estimates (ESTIMATE), the weights (HELD) or neither (UNSEEN) learn from it; the
    final counts are of both. Tokens are the lower-cased (A-Z) words and one end of the text, so null and empty texts have
    one token. ``base_score`` is the additively smoothed unigram score, ``score`` the model's log10 probability of the
    text, and ``n_known`` counts tokens that the training texts have. Repeated rows and ids count and give a row each. With no
    training rows every token has the uniform probability; an empty table gives an empty result. Other columns of ``df``,
    whatever their names, are left out. Texts are taken whole. Words are told apart by 64-bit hashes. The ``coded`` most
    frequent words have a short code, which changes no result.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), part.cast("int").alias("part"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(size / 7 / KEYS_A_BUCKET))  # words are about seven bytes; this only sets how finely keys are dealt
    words = settled(_word_counts(texts, buckets))
    final, estimate = _vocabulary(words, coded)
    facts = _rare_facts(texts, words, final, buckets)
    pairs = settled(_pair_counts(texts, final, estimate, buckets).union(_rare_events(texts, final, estimate, facts, buckets)))
    final.weights = learn_weights(pairs, final.outcomes)
    table = [(np.frombuffer(k, np.int64), np.frombuffer(n, np.int64)) for k, n in pairs.where("kind = 1").select("f1", "n").collect()]
    keys, times = (np.concatenate([np.zeros(0, np.int64), *(t[i] for t in table)]) for i in (0, 1))
    order = np.argsort(keys)
    final.frequent, final.times = keys[order], times[order]
    return _scored(texts, final, buckets, df.schema[id_col].dataType, id_col, facts)
