"""Phrase collocations mined from occurrence relations (SETM).

The relation of length k has a row for each place where a frequent phrase of k words starts. It is kept sorted by piece and
position and written, in blocks that hold some megabytes of texts of one language. Joining it with itself on the same piece and
the next position gives the occurrences of phrases of k + 1 words; these are counted by phrase, and a semi-join with the frequent
ones leaves the next relation. A phrase is named by the numbers of its first and its last k words, so no hash stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted as distinct_counts
from .common import settled, text_bytes, text_slices
from .words import deltas, mixed, planes, undeltas, unplanes, word_hashes

#: Bytes of text that a block is cut from, occurrences of the whole corpus that a counting task has a share of, and groups of
#: ranked phrases that are merged at a time.
BLOCK, BUCKET, MERGE = 16 << 20, 2_000_000, 32
_BLANK, _END = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_END[[*b".,;:!?\n\x0b\x0c\r"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BLOCKS = "block long, lang string, words array<string>, n array<long>, total long, places binary, ids binary"
WORD_PARTS = "bucket int, block long, lang string, at array<int>, words array<string>, n array<long>"
PAIR_PARTS = "bucket int, block long, keys binary, n binary"
#: What counting tells: a frequent phrase (id, and lang and phrase of a word or the ids a and b of its parts), the frequent ones
#: of a block (at or keys, and ids), or the number of all words of a language.
COUNTED = "kind string, block long, lang string, id long, phrase string, a long, b long, n long, at binary, ids binary"
RELATION = "block long, places binary, ids binary"


def occurrences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, A-Z lower-cased, and their places: 1 apart within a piece, 2 apart between pieces."""
    raw, offsets = text_bytes(texts)
    raw = _LOWER[raw]
    ends = _END[raw]
    inside = ~(ends | _BLANK[raw])
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    start[first] = inside[first]  # a text's last word does not run on into the next text
    at = np.flatnonzero(start)
    sizes = np.add.reduceat(inside, at, dtype=np.int32) if len(at) else np.zeros(0, np.int32)
    piece = np.searchsorted(np.flatnonzero(ends), at) + np.searchsorted(offsets, at, side="right")
    places = np.arange(len(at)) + np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1])))[: len(at)]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(raw[inside]))), places


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, where each bucket starts in it and the last one ends, and the buckets."""
    order = np.argsort(bucket, kind="stable")
    found = bucket[order]
    cuts = np.concatenate((np.flatnonzero(np.diff(found, prepend=-1)), [len(found)]))
    return order, cuts, found[cuts[:-1]]


def _number(bucket: int, buckets: int, n: int) -> np.ndarray:
    """Numbers for a bucket's ``n`` frequent phrases, which no other bucket gives."""
    ids = bucket + buckets * np.arange(n, dtype=np.int64)
    if n and ids[-1] >> 32:
        raise ValueError("over 4,294,967,295 frequent phrases of one length: raise the least frequency")
    return ids


def _answers(blocks: np.ndarray, at: np.ndarray, ids: np.ndarray, pack) -> list[dict]:
    """What is frequent of each block, ``at`` ascending within it."""
    cuts = np.concatenate((np.flatnonzero(np.diff(blocks, prepend=-1)), [len(blocks)]))
    return [{"kind": "answer", "block": int(blocks[i]), "at": pack(at[i:j]), "ids": planes(ids[i:j].astype(np.uint32))} for i, j in zip(cuts, cuts[1:])]


def _told(rows: list[dict], groups: dict[str, np.ndarray | pa.Array]) -> pa.Table:
    names = [c.split()[0] for c in COUNTED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))
    n = len(groups["id"])
    table = pa.table([pa.array(groups[c], k) if c in groups else pa.array(["group"] * n) if c == "kind" else pa.nulls(n, k) for c, k in zip(names, kinds)], schema)
    return pa.concat_tables([table, pa.Table.from_pylist(rows, schema)])


def word_blocks(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """The relation of all words, in blocks of one language with a list of their distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, "text", BLOCK):
            for lang in pc.unique(batch.column("lang")):
                words, places = occurrences(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))
                if not len(words):
                    continue
                found = words.dictionary_encode()
                codes = found.indices.to_numpy().astype(np.uint32)
                n = np.bincount(codes, minlength=len(found.dictionary))
                cuts = np.array([0, len(n)])
                columns = [pa.array([made]), pa.array([lang.as_py()]), _lists(cuts, found.dictionary), _lists(cuts, pa.array(n)), pa.array([len(words)])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([deltas(places.astype(np.uint32))]), pa.array([planes(codes)])], [c.split()[0] for c in BLOCKS.split(", ")])
                made += 1

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return settled(df.select(lang.alias("lang"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, BLOCKS), large_rows=True)


def frequent_words(blocks: DataFrame, least: int, buckets: int) -> DataFrame:
    """Counts of all words of all blocks, as COUNTED says."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                words = row.column("words").flatten()
                order, cuts, bucket = _dealt((word_hashes(words)[0] % np.uint64(buckets)).astype(np.int32))
                take = pa.array(order)
                same = [pa.array([row.column(c)[0].as_py()] * len(bucket), t) for c, t in (("block", pa.int64()), ("lang", pa.string()))]
                parts = [_lists(cuts, pa.array(order, pa.int32())), _lists(cuts, words.take(take)), _lists(cuts, row.column("n").flatten().take(take))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *same, *parts], [c.split()[0] for c in WORD_PARTS.split(", ")])

    def count(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        flat = {c: part.column(c).combine_chunks().flatten() for c in ("at", "words", "n")}
        of = np.repeat(np.arange(part.num_rows), part.column("words").combine_chunks().value_lengths().to_numpy())
        words, langs = flat["words"].dictionary_encode(), part.column("lang").combine_chunks().dictionary_encode()
        key = langs.indices.to_numpy().astype(np.int64)[of] * len(words.dictionary) + words.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        sums = np.add.reduceat(flat["n"].to_numpy()[order], first)
        keys = key[order][first]
        frequent = sums >= least
        ids = _number(part.column("bucket")[0].as_py(), buckets, int(frequent.sum()))
        lang_of, word_of = (keys // len(words.dictionary)), keys % len(words.dictionary)
        totals = [{"kind": "total", "lang": x, "n": int(sums[lang_of == i].sum())} for i, x in enumerate(langs.dictionary.to_pylist())]
        # each block's own: the group of every row, where it is frequent
        numbered = np.full(len(keys), -1, np.int64)
        numbered[frequent] = ids
        given = np.empty(len(key), np.int64)
        given[order] = np.repeat(numbered, np.diff(first, append=len(key)))
        blocks, at = part.column("block").to_numpy()[of], flat["at"].to_numpy()
        kept = np.flatnonzero(given >= 0)
        kept = kept[np.lexsort((at[kept], blocks[kept]))]
        rows = _answers(blocks[kept], at[kept], given[kept], lambda x: deltas(x.astype(np.uint32)))
        groups = {"id": ids, "lang": langs.dictionary.take(pa.array(lang_of[frequent])), "phrase": words.dictionary.take(pa.array(word_of[frequent])), "n": sums[frequent]}
        return _told(rows + totals, groups)

    return settled(blocks.select("block", "lang", "words", "n").mapInArrow(deal, WORD_PARTS).groupBy("bucket").applyInArrow(count, COUNTED), large_rows=True)


def _joined(relation: DataFrame, told: DataFrame) -> DataFrame:
    """Blocks with what is frequent of them; a block without anything is gone."""
    answers = told.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("at", "ids")).alias("answers"))
    return relation.select("block", "places", "ids").join(answers, "block")


def _numbers_of(answers: pa.Array, unpack) -> tuple[np.ndarray, np.ndarray]:
    parts = answers.flatten()
    at = np.concatenate([unpack(x.as_py()) for x in parts.field("at")])
    ids = np.concatenate([unplanes(x.as_py(), "u4") for x in parts.field("ids")])
    order = np.argsort(at)
    return at[order], ids[order]


def word_relation(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """The blocks' places of frequent words, with these words' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                at, ids = _numbers_of(row.column("answers"), lambda x: undeltas(x, "u4"))
                codes = unplanes(row.column("ids")[0].as_py(), "u4")
                known = np.full(int(codes.max()) + 1, -1, np.int64)
                known[at] = ids
                found = known[codes]
                kept = found >= 0
                yield _relation_row(row, undeltas(row.column("places")[0].as_py(), "u4")[kept], found[kept])

    return settled(_joined(blocks, told).mapInArrow(run, RELATION), large_rows=True)


def _relation_row(row: pa.RecordBatch, places: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row.column("block"), pa.array([deltas(places)]), pa.array([planes(ids.astype(np.uint32))])], ["block", "places", "ids"])


def _next_pairs(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The relation merged with itself one place further on: where both start, and the two numbers packed."""
    places, ids = undeltas(row.column("places")[0].as_py(), "u4"), unplanes(row.column("ids")[0].as_py(), "u4").astype(np.uint64)
    follows = np.flatnonzero(places[1:] == places[:-1] + np.uint32(1))
    return places[follows], ids[follows] << np.uint64(32) | ids[follows + 1]


def frequent_pairs(relation: DataFrame, least: int, buckets: int) -> DataFrame:
    """Counts of phrases one word longer than the relation's, as COUNTED says."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n = distinct_counts(_next_pairs(batch.slice(i, 1))[1])
                order, cuts, bucket = _dealt((mixed(keys) % np.uint64(buckets)).astype(np.int32))
                keys, n = keys[order], n[order]
                packed = [[deltas(keys[a:b]) for a, b in zip(cuts, cuts[1:])], [planes(n[a:b].astype(np.uint32)) for a, b in zip(cuts, cuts[1:])]]
                block = pa.array([batch.column("block")[i].as_py()] * len(bucket), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket), block, *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "block", "keys", "n"])

    def count(part: pa.Table) -> pa.Table:
        each = [undeltas(x.as_py(), "u8") for x in part.column("keys")]
        keys, n = np.concatenate(each), np.concatenate([unplanes(x.as_py(), "u4") for x in part.column("n")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) > 0)))
        sums = np.add.reduceat(n[order], first)
        frequent = sums >= least
        ids, named = _number(part.column("bucket")[0].as_py(), buckets, int(frequent.sum())), keys[order][first][frequent]
        rows = []
        if len(named):
            for block, own in zip(part.column("block").to_pylist(), each):
                at = np.minimum(np.searchsorted(named, own), len(named) - 1)
                held = named[at] == own
                if held.any():
                    rows.append({"kind": "answer", "block": block, "at": deltas(own[held]), "ids": planes(ids[at[held]].astype(np.uint32))})
        return _told(rows, {"id": ids, "a": (named >> np.uint64(32)).astype(np.int64), "b": (named & np.uint64(0xFFFFFFFF)).astype(np.int64), "n": sums[frequent]})

    return settled(relation.mapInArrow(deal, PAIR_PARTS).groupBy("bucket").applyInArrow(count, COUNTED), large_rows=True)


def longer_relation(relation: DataFrame, told: DataFrame) -> DataFrame:
    """The blocks' places of frequent phrases one word longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, ids = _numbers_of(row.column("answers"), lambda x: undeltas(x, "u8"))
                places, pairs = _next_pairs(row)
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                kept = keys[at] == pairs
                yield _relation_row(row, places[kept], ids[at[kept]])

    return settled(_joined(relation, told).mapInArrow(run, RELATION), large_rows=True)


def frequent_phrases(df: DataFrame, least: int, longest: int, lang_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame], int]:
    """The number of words of each language (lang, n); for each length the frequent phrases: id, lang, phrase, f, last (word), pre
    and suf (f of its first and last 1, 2, ... words), and from two words on a and b, the ids of its parts; and in how many buckets
    phrases were counted."""
    blocks = word_blocks(df, lang_col, text_col)
    buckets = max(8, (blocks.agg(F.sum("total")).first()[0] or 0) // BUCKET)
    told = frequent_words(blocks, least, buckets)
    totals = told.where("kind = 'total'").groupBy("lang").agg(F.sum("n").alias("n"))
    alone = F.array(F.col("n"))
    found = [told.where("kind = 'group'").select("id", "lang", "phrase", F.col("n").alias("f"), F.col("phrase").alias("last"), alone.alias("pre"), alone.alias("suf"))]
    relation = word_relation(blocks, told)
    for k in range(2, longest + 1):
        told = frequent_pairs(relation, least, buckets)
        if k < longest:
            relation = longer_relation(relation, told)
        head = found[-1].select(F.col("id").alias("a"), "lang", "phrase", "pre")
        tail = found[-1].select(F.col("id").alias("b"), "last", "suf")
        own = F.array(F.col("n"))
        longer = told.where("kind = 'group'").select("id", "a", "b", "n").join(head, "a").join(tail, "b")
        found.append(settled(longer.select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), F.col("n").alias("f"), "last", F.concat("pre", own).alias("pre"), F.concat("suf", own).alias("suf"), "a", "b",
        )))
    return totals, found, buckets


def _best(scored: DataFrame, top: int, groups: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank. A language may hold most of the rows, so its phrases are dealt to
    ``groups``, then to a MERGE-th of them and so on, and each keeps its own first ones only."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    while groups > 1:
        dealt = scored.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
        place = F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))
        scored = dealt.withColumn("rank", place).where(F.col("rank") <= top).drop("group", "rank")
        groups //= MERGE
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(df: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of two to ``longest`` words that occur ``least``
    times and more.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. ``a`` counts all
    occurrences within pieces, overlaps included, ``n`` all words of the language. Of the cuts of a phrase in two, with counts l and
    r, the one with the lowest floor(2000000 a / (l + r)) counts, the first of several. A phrase that a longer frequent one holds is
    dropped if that occurs in 80 of 100 cases or more. Order: score, then a, descending, then the phrase's bytes.

    A null language is ``und``, null and empty texts have no words, repeated rows count each time, an empty table gives an empty
    result; other columns of ``df``, whatever their names, are left out. Texts are taken whole.
    """
    totals, found, buckets = frequent_phrases(df, least, longest, lang_col, text_col)
    big = "cast({} as decimal(20,0))".format  # products of counts may pass 64 bits
    phrases = []
    for k in range(2, longest + 1):
        this = found[k - 1]
        cuts = []
        for j in range(1, k):
            left, right = f"pre[{j - 1}]", f"suf[{k - j - 1}]"
            score = F.expr(f"2000000 * {big('f')} div ({big(left)} + {big(right)})")
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), F.expr(left).alias("l"), F.expr(right).alias("r")))
        best = F.array_min(F.array(*cuts))
        if k < longest:
            # a phrase two words longer is no more frequent than the one between them, so one more word is enough to look at
            over = found[k].select(F.col("a").alias("id"), "f").union(found[k].select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("over"))
            this = this.join(over, "id", "left").where(F.expr(f"over is null or 100 * {big('over')} < 80 * {big('f')}"))
        phrases.append(this.select("lang", "phrase", F.col("f").alias("a"), best.alias("best")))
    all_phrases = phrases[0]
    for more in phrases[1:]:
        all_phrases = all_phrases.union(more)
    flat = all_phrases.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    ranked = _best(flat, top, buckets)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
