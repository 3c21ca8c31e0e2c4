"""Language identification by rank-order profiles.

A language's profile is the order of its most frequent letter n-grams (one to three letters, with a mark at word edges). A
document's own most frequent n-grams are compared to each profile: the out-of-place distance adds up how far each n-gram's
rank is from its rank in the profile, and the profile's length where it is missing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, text_slices

#: Ranks in a language's profile, and most frequent n-grams of a document that are compared.
PROFILE, COMPARED = 400, 300
UNDETERMINED = "und"
#: Characters of a text that are worked on at a time; a longer text is counted in such parts.
PART = 1 << 20
EDGE = 1  # stands for anything between words; no letter has this code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, each run of non-letters as one EDGE; and where each text starts and ends.

    Every text starts with an EDGE, and so ends before the next one's.
    """
    parts = [np.frombuffer(("\0" + (t or "").lower()).encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    cp = np.concatenate([*parts, np.zeros(1, np.uint32)]).astype(np.int64)
    letter = _letters()[cp]
    start = np.zeros(len(cp), dtype=bool)
    start[bounds] = True
    keep = letter | start
    keep[1:] |= letter[:-1] & ~letter[1:]
    upto = np.concatenate(([0], np.cumsum(keep)))
    return np.where(letter, cp, EDGE)[keep], upto[bounds]


def grams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position) of all n-grams: one letter, two and three with edges, 21 bits a code point."""
    edge = cp == EDGE
    one = np.flatnonzero(~edge)
    two = np.flatnonzero(~(edge[:-1] & edge[1:])) if len(cp) > 1 else one[:0]
    three = np.flatnonzero(~edge[1:-1]) if len(cp) > 2 else one[:0]
    keys = (cp[one], cp[two] << 21 | cp[two + 1], cp[three] << 42 | cp[three + 1] << 21 | cp[three + 2])
    return np.concatenate(keys), np.concatenate((one, two, three))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts, those of 0 left out."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), keys[1:] != keys[:-1])))
    sums = np.add.reduceat(counts, first)
    return keys[first][sums > 0], sums[sums > 0]


def counted_in_parts(text: str, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of one text in order and their counts, as ``_counted`` finds them, in room for ``part`` characters.

    From part to part go the last two letters or edges. The n-grams within these are counted again and so taken off."""
    lower = text.lower()
    tail, keys, counts = np.array([EDGE], np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for s in range(0, len(lower) + 1, part):
        closes = s + part > len(lower)
        raw = np.frombuffer(lower[s : s + part].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        cp = np.where(_letters()[raw], raw, EDGE)
        cp = np.concatenate((tail, cp, np.full(int(closes), EDGE)))
        keep = np.ones(len(cp), dtype=bool)
        keep[1:] = (cp[1:] != EDGE) | (cp[:-1] != EDGE)
        cp = cp[keep]
        (new, n), (old, m) = _counted(cp), counted(grams(tail)[0])
        keys, counts = _summed(np.concatenate((keys, new, old)), np.concatenate((counts, n, -m)))
        tail = cp[-2:]
    return keys, counts


def gram_text(key: int) -> str:
    """An n-gram as text, with _ at word edges."""
    points = [key >> s & (1 << 21) - 1 for s in (42, 21, 0)]
    return "".join("_" if p == EDGE else chr(p) for p in points if p)


def _counted(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys and their counts. Over a small alphabet they are counted in a dense table, not sorted."""
    used = np.bincount(cp) > 0
    alphabet = np.flatnonzero(used)
    code = (np.cumsum(used) - 1)[cp]
    a = len(alphabet)
    if len(cp) < 3 or a**3 > 1 << 21:
        return counted(grams(cp)[0])
    keys, counts = [], []
    edge = cp == EDGE
    for n in (1, 2, 3):
        m = len(cp) - n + 1
        index = np.zeros(m, np.int64)
        for j in range(n):
            index = index * a + code[j : j + m]
        valid = ~edge if n == 1 else ~(edge[:-1] & edge[1:]) if n == 2 else ~edge[1:-1]
        found = np.bincount(index[valid], minlength=a**n)
        at = np.flatnonzero(found)
        packed, rest = np.zeros(len(at), np.int64), at
        for j in range(n):
            packed |= alphabet[rest % a] << (21 * j)
            rest = rest // a
        keys.append(packed)
        counts.append(found[at])
    return np.concatenate(keys), np.concatenate(counts)


def profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams in order, counted over every row with a text and a language.

    Ties are in the order of the n-grams' code points. Null and empty texts and null languages count for nothing, repeated rows
    once each; a language without a letter has no profile, and an empty table gives none. Texts are read whole; other columns
    of ``df``, whatever their names, do not matter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in text_slices(batches, "text", 4 << 20):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                cp, _ = letters_of([t for t in own if len(t) <= PART])
                mine = held.setdefault(lang, {})
                for keys, counts in (_counted(cp), *(counted_in_parts(t) for t in own if len(t) > PART)):
                    for k, n in zip(keys.tolist(), counts.tolist()):
                        mine[k] = mine.get(k, 0) + n
            if sum(map(len, held.values())) > 500_000:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    def _rows(held: dict[str, dict[int, int]]) -> pa.RecordBatch:
        flat = [(lang, k, n) for lang, mine in held.items() for k, n in mine.items()]
        langs, keys, counts = zip(*flat) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    usable = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    totalled = usable.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # every task keeps the first ``size`` of each language before they meet
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = totalled.withColumn("place", place).where(F.col("place") <= size).select("lang", "place", "gram").collect()
    found: dict[str, list] = {}
    for lang, place_of, gram in rows:
        found.setdefault(lang, []).append((place_of, gram))
    return {lang: [g for _, g in sorted(found[lang])] for lang in sorted(found)}


def distances(keys: np.ndarray, counts: np.ndarray, ranked: list[tuple[np.ndarray, np.ndarray]], size: int, compared: int) -> tuple[np.ndarray, int]:
    """Out-of-place distance of one text's n-grams, in order, to each profile, and the largest possible one."""
    top = keys[np.argsort(-counts, kind="stable")[:compared]]
    rank = np.arange(len(top))
    out = np.empty(len(ranked))
    for i, (known, place) in enumerate(ranked):
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        out[i] = np.where(known[at] == top, np.abs(place[at] - rank), size).sum()
    return out, size * len(top)


class Identifier:
    """Names the nearest profile of each text."""

    def __init__(self, learned: dict[str, list[int]], compared: int = COMPARED):
        self.names = sorted(k for k, v in learned.items() if v)
        self.size = max((len(learned[k]) for k in self.names), default=1)
        self.compared, self.ranked = compared, []
        for k in self.names:
            keys = np.array(learned[k], dtype=np.int64)
            by = np.argsort(keys)
            self.ranked.append((keys[by], by))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, fit) of each text."""
        cp, bounds = letters_of([t if t and len(t) <= PART else "" for t in texts])
        langs, scores, fits = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if texts[i] and len(texts[i]) > PART:
                keys, counts = counted_in_parts(texts[i])
            else:
                own = cp[a : b + 1]  # with the next text's first EDGE, which closes this one's last word
                keys, counts = counted(grams(own[:-1] if own[-2] == EDGE else own)[0])
            if not len(keys) or not self.names:
                continue
            d, most = distances(keys, counts, self.ranked, self.size, self.compared)
            best = int(d.argmin())
            second = np.delete(d, best).min() if len(d) > 1 else most
            langs[i] = self.names[best]
            scores[i] = (second - d[best]) / second if second > 0 else 0.0
            fits[i] = 1 - d[best] / most
        return langs, scores, fits


def identify(df: DataFrame, learned: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", compared: int = COMPARED) -> DataFrame:
    """id, ``lang_pred``, ``score`` and ``fit`` for every row of ``df``, from the text alone.

    The nearest profile wins, the first by name in a tie. ``score`` is how much nearer it is than the next one, ``fit`` how
    near it is at all, both 0 to 1. A text that is null or has no letter, and any text where nothing was learned, is ``und``
    with score and fit 0. Whole texts are used. Repeated rows give a row each; an empty table gives an empty result; other
    columns of ``df``, whatever their names, are left out.
    """
    name = Identifier(learned, compared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            langs, scores, fits = name(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(fits)], [id_col, "lang_pred", "score", "fit"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def identified_rows(df: DataFrame, learned: dict[str, list[int]], text_col: str = "text", least_fit: float = 0.25) -> DataFrame:
    """The rows of ``df``, all their columns, whose language is determined and whose text fits it at all: those with a fit
    of at least ``least_fit``, in one pass without a join. Null and empty texts go; repeated rows stay or go together; an empty
    table stays empty, and columns of any name stay as they are."""
    name = Identifier(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col, 2 << 20):
            langs, _, fits = name(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED and f >= least_fit for x, f in zip(langs, fits)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
