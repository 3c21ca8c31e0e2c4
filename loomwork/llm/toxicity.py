"""Toxicity scores from a factorization machine over hashed terms.

Terms are words (runs of letters, lower-cased, of any length), their beginnings, and, in scripts that do not put spaces
between words, all runs of two and three letters; they are hashed to buckets. Every bucket that at least LEAST learned
documents have is a feature. Its value says how much is known of it: near 1 if the labels of its documents are surely not
those of all documents, and small, but never 0, if they could well be, so that the many terms that say nothing stay quiet
while terms that are neutral alone can still act in pairs. The machine has a weight for each feature and a vector for each,
so that pairs of features add what neither adds alone.

It is learned by stochastic gradients from a bounded sample of labelled documents (SAMPLE), the only part of the corpus that
one task ever holds; what is counted and scored is spread over all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, settled, text_slices

#: Buckets of hashed terms, labelled rows (those of smallest hashed id) that are learned from, documents a feature needs.
BUCKETS, SAMPLE, LEAST = 1 << 18, 30_000, 3
#: Characters hashed at a time, and learned documents whose terms are looked up at a time.
PART, ROWS = 1 << 19, 1_000
#: Letters of a word's beginnings that are terms too.
BEGINNINGS = (4, 6)
#: The evidence (twice a log-likelihood ratio) that makes a feature's value a half, and the value and number of documents of
#: a feature without any: NEUTRAL times documents / (documents + SETTLED).
HALF, NEUTRAL, SETTLED = 12.0, 0.05, 200.0
#: Vectors' length, passes over the sample, documents of a step, rates of the weights and of the vectors, and penalties.
FACTORS, EPOCHS, BATCH, RATE, VECTOR_RATE, L1, L2, DECAY = 4, 8, 128, 1.0, 0.05, 1.0, 0.1, 1e-4
#: fixed values: blocks of scripts that are written without spaces between words
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_P = 0x100000001B3


@dataclass(frozen=True)
class Machine:
    """What was learned: ``feature`` of each bucket (-1: none) and the weights. ``constant`` replaces all of it where the
    labels hold one class only, or none."""

    feature: np.ndarray | None
    bias: float
    linear: np.ndarray | None
    factors: np.ndarray | None
    constant: float | None = None

    def score(self, docs: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents from their distinct (document, feature) pairs."""
        if self.constant is not None:
            return np.full(n, self.constant)
        raw = self.bias + np.bincount(docs, self.linear[features], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[features, f]
            raw += (np.bincount(docs, v, minlength=n) ** 2 - np.bincount(docs, v * v, minlength=n)) / 2
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 0 no letter, 1 a letter, 2 a letter of an unspaced script."""
    kinds = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)], dtype=np.int8)
    for a, b in UNSPACED:
        kinds[a : b + 1] *= 2
    return kinds


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of every text, repeated as often as it occurs. Texts are hashed PART characters at a
    time, so that many of them take no more memory than the longest one; a longer text stays whole."""
    part = np.cumsum([len(t or "") + 1 for t in texts]) // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    found = [(a, *_terms(texts[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(docs + a for a, docs, _ in found)]), np.concatenate([none, *(buckets for _, _, buckets in found)])


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(((t or "").lower() + "\0").encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    cp = np.concatenate([np.zeros(1, np.uint32), *parts]).astype(np.uint64)
    ends_of_texts = np.cumsum([1 + len(p) if i == 0 else len(p) for i, p in enumerate(parts)])
    kind = _kinds()[cp.astype(np.int64)]
    # a run's hash is a difference of running sums over all texts, so that words of any length cost the same
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((cp + np.uint64(1)) * _powers(_P, len(cp)))))
    back = _powers(pow(_P, -1, 1 << 64), len(cp) + 1)
    hash_of = lambda a, b: (sums[b] - sums[a]) * back[a]
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    word = kind[edges] == 1
    at, to = edges[word], np.append(edges[1:], len(cp))[word]
    found = [(at, _mixed(hash_of(at, to), 0))]
    for n in BEGINNINGS:
        a = at[to - at > n]
        found.append((a, _mixed(hash_of(a, a + n), n)))
    for n in (2, 3):
        inside = np.lib.stride_tricks.sliding_window_view(kind == 2, n).all(axis=1) if len(kind) >= n else np.zeros(0, bool)
        a = np.flatnonzero(inside)
        found.append((a, _mixed(hash_of(a, a + n), 32 + n)))
    places = np.concatenate([a for a, _ in found])
    return np.searchsorted(ends_of_texts, places, side="right"), np.concatenate([b for _, b in found])


def _pairs(docs: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = distinct(docs * width + values)
    return both // width, both % width


def _labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """Texts of at most ``sample`` labelled ids. Of an id's several labels the largest counts; null labels do not."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = settled(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id")  # of at most ``sample`` rows


def values_of(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """A feature's value from how many toxic and clean learned documents have it; 0 under LEAST documents.

    The evidence is that of the term's documents but one, taken from the side that makes the term stand out."""
    n, share = toxic + clean, all_toxic / (all_toxic + all_clean)
    over = toxic * all_clean > clean * all_toxic
    t, c = np.maximum(toxic - over, 0), np.maximum(clean - ~over, 0)
    of = np.maximum(t + c, 1)
    part = lambda a, p: np.where(a > 0, a * np.log(np.maximum(a, 1) / (of * p)), 0.0)
    evidence = np.maximum(2 * (part(t, share) + part(c, 1 - share)), 0)
    return np.where(n >= LEAST, np.maximum(evidence / (evidence + HALF), NEUTRAL * n / (n + SETTLED)), 0.0)


def gathered(batches: Iterator[pa.RecordBatch], feature: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each document's features start, how many it has, the features of all, and labels, in the order of ``h``.

    ``room`` is the number of all terms. Features are written once to where they stay, and documents put in order without
    moving them, so a document takes four bytes a term and those of its batch."""
    features, used = np.empty(room, dtype=np.int32), 0
    sizes, marks, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for rows in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
            found = feature[np.asarray(rows.column("terms").flatten())]
            has = found >= 0
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(rows.column("terms"))))
            sizes.append(np.diff(np.concatenate(([0], np.cumsum(has)))[np.concatenate(([0], ends))]))
            marks.append(np.asarray(rows.column("h")))
            labels.append(np.asarray(rows.column("label")))
            features[used : used + sizes[-1].sum()] = found[has]
            used += sizes[-1].sum()
    sizes, marks, labels = (np.concatenate(x) for x in (sizes, marks, labels))
    order = np.lexsort((labels, marks))
    return (np.cumsum(sizes) - sizes)[order], sizes[order], features, labels[order]


def fitted(starts: np.ndarray, lengths: np.ndarray, features: np.ndarray, labels: np.ndarray, values: np.ndarray, factors: int, epochs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors, with the features' values worked in. Document i has ``lengths[i]``
    of ``features`` from ``starts[i]`` on.

    Weights follow the proximal gradient with an L1 penalty, under which a feature needs more than noise to move off 0."""
    rng, size = np.random.default_rng(7), len(values)
    share = labels.mean()
    bias, bias_seen = float(np.log(share / (1 - share))), 0.0
    pull, seen = np.zeros(size), np.zeros(size)
    vectors, vectors_seen = rng.normal(size=(size, factors)) * 0.01, np.zeros((size, factors))
    weights = lambda at: np.where(np.abs(pull[at]) <= L1, 0, (np.sign(pull[at]) * L1 - pull[at]) / ((1 + np.sqrt(seen[at])) / RATE + L2))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            n, sizes = len(rows), lengths[rows]
            doc = np.repeat(np.arange(n), sizes)
            mine = features[np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(doc))]
            used, at = np.unique(mine, return_inverse=True)
            x, w = values[used], weights(used)
            v = vectors[used] * x[:, None]
            sums = np.stack([np.bincount(doc, v[at, f], minlength=n) for f in range(factors)], axis=1)
            raw = bias + np.bincount(doc, (w * x)[at], minlength=n) + ((sums**2).sum(axis=1) - np.bincount(doc, (v * v).sum(axis=1)[at], minlength=n)) / 2
            off = 1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels[rows]
            plain = np.bincount(at, off[doc], minlength=len(used))
            step = plain * x
            pull[used] += step - (np.sqrt(seen[used] + step * step) - np.sqrt(seen[used])) / RATE * w
            seen[used] += step * step
            for f in range(factors):
                turn = x * np.bincount(at, (off * sums[:, f])[doc], minlength=len(used)) - plain * x * v[:, f] + DECAY * vectors[used, f]
                vectors_seen[used, f] += turn * turn
                vectors[used, f] -= VECTOR_RATE * turn / (1 + np.sqrt(vectors_seen[used, f]))
            bias_seen += off.sum() ** 2
            bias -= 0.1 * off.sum() / (1 + np.sqrt(bias_seen))
    return float(bias), weights(np.arange(size)) * values, vectors * values[:, None]


def train(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, factors: int = FACTORS, epochs: int = EPOCHS,
) -> Machine:
    """A machine learned from the whole texts of ``df`` whose ids ``labels`` has, at most ``sample`` of them.

    Of an id's several labels the largest counts; null ids and null labels do not. Null and empty texts are documents without
    terms. Of an id's several rows the one with the smallest hash of its text counts, whatever their number, so that ``sample``
    bounds the documents too. Where the labelled rows are all clean, or there are none, every score will
    be 0; where all are toxic, 1. Other columns of either table, whatever their names, do not matter.
    """
    rows = _labelled(df, labels, id_col, text_col, label_col, sample)

    def list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            docs, buckets = _pairs(*terms(batch.column("text").to_pylist()), BUCKETS)
            offsets = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("h"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets.astype(np.int32)))], ["id", "label", "h", "terms"])

    hashed = rows.select(F.xxhash64("id").alias("id"), "text", "label", F.xxhash64("id", "text").alias("h"))
    named = hashed.mapInArrow(list_terms, "id long, label int, h long, terms array<int>")
    # Spark keeps the first row of an id in each task before it sends rows
    place = F.row_number().over(Window.partitionBy("id").orderBy("h"))
    listed = settled(named.withColumn("place", place).where("place = 1").select("label", "h", "terms", F.lit(0).alias("sample")))
    totals = {r.label: r for r in listed.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).collect()}
    clean, toxic = (totals[c].n if c in totals else 0 for c in (0, 1))
    room = sum(r.terms for r in totals.values())
    if not clean or not toxic:
        return Machine(None, 0.0, None, None, 1.0 if toxic else 0.0)
    # a row for each bucket at most
    counted = listed.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy("bucket").toArrow()
    bucket, with_toxic, with_any = (np.asarray(counted.column(c)).astype(np.int64) for c in ("bucket", "toxic", "n"))
    values = values_of(with_toxic, with_any - with_toxic, toxic, clean)
    feature = np.full(BUCKETS, -1, dtype=np.int32)
    feature[bucket] = np.arange(len(bucket))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths, features, labels = gathered(batches, feature, room)
        bias, linear, vectors = fitted(starts, lengths, features, labels, values, factors, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v, dtype=np.float32).tobytes()], pa.binary()) for v in (bias, linear, vectors)], ["bias", "linear", "vectors"])

    # the sample of at most ``sample`` documents is one group
    learned = listed.groupBy("sample").applyInArrow(fit, "bias binary, linear binary, vectors binary").first()
    bias, linear, vectors = (np.frombuffer(learned[c], np.float32) for c in ("bias", "linear", "vectors"))
    return Machine(feature, float(bias[0]), linear, vectors.reshape(-1, factors))


def features_of(texts: list[str | None], feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs."""
    docs, buckets = terms(texts)
    found = feature[buckets]
    has = found >= 0
    return _pairs(docs[has], found[has], BUCKETS)


def _scores(batch: pa.RecordBatch, column: str, machine: Machine) -> np.ndarray:
    none = np.zeros(0, np.int64)
    docs, found = (none, none) if machine.constant is not None else features_of(batch.column(column).to_pylist(), machine.feature)
    return machine.score(docs, found, batch.num_rows)


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1, higher: likelier toxic) for every row of ``df``, from its whole text.

    Null and empty texts have no terms and get the score of the bias alone. With no labels, or clean ones only, every score
    is 0; with toxic ones only, 1. Repeated rows give a row each; an empty table gives an empty result; other columns of
    ``df``, whatever their names, are left out.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(batch, "text", machine))], [id_col, "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def clean_rows(df: DataFrame, machine: Machine, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``df``, all their columns, whose score is under ``below``, in one pass without a join.

    Null and empty texts have the score of the bias alone and repeated rows that of each other; an empty table stays empty,
    and columns of any name stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            yield batch.filter(pa.array(_scores(batch, text_col, machine) < below))

    return df.mapInArrow(run, df.schema)
