"""Similarity join on word shingles by adaptive multi-match prefixes.

Shingles have one global order, rare ones first. Two sets that are similar enough must share at least k of the first
n - o + k shingles of each, for every k, where o is the overlap that a set of n needs. Each document picks its own k by the
estimated cost of its candidates: where its prefix holds frequent shingles, a longer prefix that must match more often.

Most documents are done before any list is made: one with n - o + 1 shingles that no other document has, however the rest
is ordered, has a prefix without candidates. To count such shingles, tasks send each of their distinct shingles once, packed
and cut to a few bits more than the number of shingles needs; a collision can only make a shingle look shared.

Groups of near copies would give all pairs of their members. So candidates are met in two ways. First every document of a
posting list is compared to one leader of the list; what links is one component. Then only lists that still span several
components are looked at again. Short ones are joined with themselves, between components. Long ones are cut by the sizes
that can link at all, and met block by block, which makes no row for a pair: first by their prefixes, to see who has a
candidate in another component, and only those documents by their whole sets. No pair of documents that are linked stays
unconnected, since each pair that shares enough of its prefixes is either in one component by then or is compared.

The order's frequencies come from a summary of bounded size, in which every shingle with more than a fixed share of all
occurrences is found (those that a task sees once count as rare). Any order gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, new_name, settled, text_slices
from .components import components, roots
from .words import deltas, mixed, planes, undeltas, unplanes, word_hashes

#: Frequent shingles that a task reports, that are kept of all, and the frequency from which one is not rare.
TASK_SUMMARY, SUMMARY, NOT_RARE = 1 << 16, 1 << 17, 4
#: Largest number of matches that a document asks for; the cost of verifying a candidate in scanned postings; and how many
#: other holders a rare shingle is expected to have.
MOST_MATCHES, VERIFY_COST, RARE_HOLDERS = 4, 8, 0.25
#: Holders up to which a list is joined with itself, and documents in a block of a longer one: of whole sets, and of prefixes.
SHORT, BLOCK, PREFIXES = 64, 256, 1536
#: Sets of a block that are looked at together with all others of it, and hashes.
STRIP, HASHES = 256, 1024
#: Parts in which the copies of one set, and the documents of one long list, are dealt out; and those of any list while it
#: meets what is known of it, of which a short list has no more than it has documents.
SALTS, PARTS = 32, 256
#: Shingles a task holds before it sends them, and shingles counted at a time.
CHUNK, BUCKET = 2_000_000, 750_000


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted hashes, one text after another, and where each starts and the last ends.

    A text with fewer words has its whole sequence as one; one without words has none."""
    w, bounds = word_hashes(column)
    n = np.diff(bounds)
    if not len(w):
        return w, np.zeros(len(bounds), np.int64)
    h = w.copy()
    for j in range(1, words):
        h[:-j] = mixed(h[:-j] * np.uint64(0x9E3779B97F4A7C15) + w[j:])
    keep = np.ones(len(w), dtype=bool)
    full = n >= words
    for j in range(1, words):  # the last words of a text start no whole shingle
        keep[bounds[1:][full] - j] = False
    for i in np.flatnonzero((n > 0) & ~full):
        a, b = bounds[i], bounds[i + 1]
        one = np.full(1, int(b - a), dtype=np.uint64)
        for x in w[a:b]:
            one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + x)
        h[a], keep[a + 1 : b] = one[0], False
    h = h[keep]
    starts = np.concatenate(([0], np.cumsum(keep)))[bounds]
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[starts[:-1][n > 0]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[starts]


def _surveyed(texts: DataFrame, words: int, buckets: int, bits: int) -> DataFrame:
    """Every row's id, set size n, two fingerprints x, y of the set, and how many of its shingles no other row has."""
    kept = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = number = 0

        def rows() -> pa.RecordBatch:
            ids = [i for part in held for i in part[0].to_pylist()]
            n, x, y = (np.concatenate([part[j] for part in held]) for j in (1, 2, 3))
            short = np.concatenate([part[4] for part in held])
            low = np.uint64(24)  # a chunk's texts fit: bits is at most 40
            pairs = short << low
            del short
            pairs |= np.repeat(np.arange(len(n), dtype=np.uint64), n)
            pairs.sort()
            keys = pairs >> low
            docs = np.bitwise_and(pairs, (np.uint64(1) << low) - np.uint64(1), out=pairs)
            first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), dtype=bool), keys[1:] != keys[:-1])))
            once = np.diff(first, append=len(keys)) == 1
            keys = keys[first]
            # 0: met more than once here, so shared whoever else has it; else the text's place plus 1
            place = np.where(once, docs[first] + np.uint64(1), 0).astype(np.uint32)
            cuts = np.searchsorted(keys, np.array([(i << bits) // buckets for i in range(buckets + 1)], dtype=np.uint64))
            chunk = TaskContext.get().partitionId() << 24 | number
            head = np.concatenate((n, x.view(np.int64), y.view(np.int64))).tobytes()
            out = [(b, chunk, deltas(keys[i:j]), planes(place[i:j]), None, None) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            out.append((number % buckets, chunk, None, None, head, ids))
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["bucket", "chunk", "keys", "places", "head", "ids"])

        for batch in text_slices(batches, "text", 2 << 20):
            h, starts = shingle_sets(batch.column("text"), words)
            n = np.diff(starts)
            x, y = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(h):
                x[n > 0] = np.add.reduceat(h, starts[:-1][n > 0])
                y[n > 0] = np.bitwise_xor.reduceat(mixed(h + np.uint64(0x2545F4914F6CDD1D)), starts[:-1][n > 0])
            held.append((batch.column("id"), n, x, y, h >> kept))
            size += len(h) + len(n)
            if size > CHUNK:
                yield rows()
                held, size, number = [], 0, number + 1
        if held:
            yield rows()

    def count(table: pa.Table) -> pa.Table:
        keys, places, heads = (table.column(c).to_pylist() for c in ("keys", "places", "head"))
        full = [i for i, k in enumerate(keys) if k is not None]
        out = []
        if full:
            k = [undeltas(keys[i], "<u8") for i in full]
            size = [len(v) for v in k]
            k, place = np.concatenate(k), np.concatenate([unplanes(places[i], "<u4") for i in full])
            order = np.argsort(k, kind="stable")
            k = k[order]
            alone = np.ones(len(k), dtype=bool)
            alone[1:] &= k[1:] != k[:-1]
            alone[:-1] &= k[1:] != k[:-1]
            unique = np.zeros(len(k), dtype=bool)
            unique[order] = alone
            unique &= place > 0
            ends = np.cumsum(size)
            for i, a, b in zip(full, ends - size, ends):
                mine, n = counted(place[a:b][unique[a:b]] - np.uint32(1))
                if len(mine):
                    out.append((table.column("chunk")[i].as_py(), deltas(mine), planes(n.astype(np.uint32)), None, None))
        out += [(table.column("chunk")[i].as_py(), None, None, heads[i], table.column("ids")[i].as_py()) for i, h in enumerate(heads) if h is not None]
        return pa.table([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["chunk", "places", "unique", "head", "ids"])

    def finish(table: pa.Table) -> pa.Table:
        head = next(h for h in table.column("head").to_pylist() if h is not None)
        ids = next(i for i in table.column("ids").to_pylist() if i is not None)
        n, x, y = np.frombuffer(head, np.int64).reshape(3, -1)
        unique = np.zeros(len(n), dtype=np.int64)
        for at, u in zip(table.column("places").to_pylist(), table.column("unique").to_pylist()):
            if u is not None:
                unique[undeltas(at, "<u4")] += unplanes(u, "<u4")
        return pa.table({"id": pa.array(ids, pa.int64()), "n": n, "x": x, "y": y, "own": unique})

    sent = texts.mapInArrow(send, "bucket int, chunk long, keys binary, places binary, head binary, ids array<long>")
    back = sent.groupBy("bucket").applyInArrow(count, "chunk long, places binary, unique binary, head binary, ids array<long>")
    return back.groupBy("chunk").applyInArrow(finish, "id long, n long, x long, y long, own long")


def _summary(texts: DataFrame, words: int) -> DataFrame:
    """Shingles that tasks saw more than once, and how many of the texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            keys, counts = counted(np.concatenate(seen))
            top = np.flatnonzero(counts > 1)
            if len(top) > TASK_SUMMARY:
                top = top[np.argsort(-counts[top], kind="stable")[:TASK_SUMMARY]]
            return pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], ["token", "n"])

        for batch in text_slices(batches, "text", 2 << 20):
            h, _ = shingle_sets(batch.column("text"), words)
            seen.append(h)
            size += len(h)
            if size > CHUNK:
                yield rows()
                seen, size = [], 0
        if size:
            yield rows()

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _prefixes(texts: DataFrame, frequent: np.ndarray, times: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """id, n, matches wanted k, a band of similar sizes, and the prefix of every non-empty set."""
    # a little more than what separates the sizes of two sets that can link, so that these are in one band or in neighbours
    width = -np.log(num / den) * (1 + 1e-6) if num < den else 1.0

    def prefix(own: np.ndarray) -> tuple[int, np.ndarray]:
        n = len(own)
        overlap = -(-num * n // den)
        at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
        hit = frequent[at] == own if len(frequent) else np.zeros(n, dtype=bool)
        rare, common, f = own[~hit], own[hit], times[at[hit]]
        order = np.argsort(f, kind="stable")
        common, f = common[order], f[order]
        scanned = np.concatenate(([0], np.cumsum(f - 1)))
        best, cost = 1, None
        for k in range(1, min(MOST_MATCHES, overlap) + 1):
            length = n - overlap + k
            scan = RARE_HOLDERS * min(length, len(rare)) + int(scanned[max(length - len(rare), 0)])
            now = length + scan + VERIFY_COST * scan / k
            if cost is None or now < cost:
                best, cost = k, now
        length = n - overlap + best
        return best, np.concatenate((rare[:length], common[: max(length - len(rare), 0)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            h, starts = shingle_sets(batch.column("text"), words)
            n = np.diff(starts)
            rows = np.flatnonzero(n > 0)
            found = [prefix(h[starts[i] : starts[i + 1]]) for i in rows]
            offsets = np.concatenate(([0], np.cumsum([len(p) for _, p in found]))).astype(np.int32)
            flat = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(n[rows], pa.int32()), pa.array([k for k, _ in found], pa.int32()), pa.array(np.floor(np.log(n[rows]) / width), pa.int32(), safe=False), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                ["id", "n", "k", "band", "prefix"],
            )

    return texts.mapInArrow(run, "id long, n int, k int, band int, prefix array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, whether some texts of the two ids are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(text_slices(batches, "text_a", 4 << 20), "text_b", 4 << 20):
            sides = []
            for side in ("text_a", "text_b"):
                coded = batch.column(side).dictionary_encode()
                h, starts = shingle_sets(coded.dictionary, words)
                sides.append((h, starts, np.asarray(coded.indices)))
            (ha, sa, ia), (hb, sb, ib) = sides
            linked = np.zeros(batch.num_rows, dtype=bool)
            for r, (i, j) in enumerate(zip(ia.tolist(), ib.tolist())):
                x, y = ha[sa[i] : sa[i + 1]], hb[sb[j] : sb[j + 1]]
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[r] = den * common >= num * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def _told(lists: DataFrame, keys: list[str], found: dict[str, tuple[Column, Column]], where: Column | None = None) -> DataFrame:
    """``lists`` with a column for each of ``found``, an aggregate over the rows of equal ``keys``: how a part of these is
    summed up, and how the parts are. Rows of keys for which ``where`` does not hold go.

    A shingle may be held by a third of all documents, so the rows of a key are dealt out by their ids, and each part that has
    rows meets its own copy of what was found: no more copies than there are rows, and no task with all rows of a key.
    """
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy(*keys, "part").agg(*(one.alias(name) for name, (one, _) in found.items()))
    whole = parts.groupBy(*keys).agg(*(both.alias(name) for name, (_, both) in found.items()), F.collect_set("part").alias("parts"))
    if where is not None:
        whole = whole.where(where)
    return dealt.join(whole.withColumn("part", F.explode("parts")).drop("parts"), [*keys, "part"]).drop("part")


def _near_sizes(num: int, den: int):
    return F.least("na", "nb") * den >= F.greatest("na", "nb") * num


def link_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100,
) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` for every row of ``df``.

    Documents link when den * intersection >= num * union of their sets of ``words``-word shingles (words lower-cased, A-Z);
    a text with fewer words is one shingle of all of them. ``component_id`` is the smallest id reachable by links. Null and
    empty texts and those without words have no shingles and link with nothing; rows without an id neither, and their
    component is null. Equal sets always link. Rows of one id are one document: it links if any of its texts does. An empty
    table gives an empty result; other columns of ``df``, whatever their names, are left out. Texts are taken whole. Shingles
    are told apart by 64-bit hashes.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    about = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 6  # a shingle a word, of six bytes
    sets = settled(_surveyed(texts, words, max(1, math.ceil(about / BUCKET)), min(40, max(32, math.ceil(math.log2(about + 2)) + 5))))
    left = sets.where("n > 0 and id is not null").where((F.col("n") - F.col("own")) * den >= F.col("n") * num)
    classes = left.groupBy("x", "y", "n").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    # a class may hold a third of all rows, so its copies meet their first under several salts
    firsts = classes.where("rows > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = salted.join(firsts, ["x", "y", "n", "salt"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    needed = settled(texts.join(classes.select(F.col("first").alias("id")).distinct(), "id", "left_semi"))

    top = _summary(needed, words).where(F.col("n") >= NOT_RARE).orderBy(F.col("n").desc(), "token").limit(SUMMARY).collect()
    frequent = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, times = frequent[order], np.array([r[1] for r in top], dtype=np.int64)[order]
    prefixed = settled(_prefixes(needed, frequent, times, words, num, den))
    postings = prefixed.select("id", "n", "k", "band", F.explode("prefix").alias("token"))
    holders = {"holders": (F.count("*"), F.sum("holders"))}
    lists = settled(_told(postings, ["token"], holders, F.col("holders") > 1).select("token", "id", "n", "k", "band"))

    found = settled(_verified(_leader_pairs(lists, num, den), needed, words, num, den)).where("linked").select("a", "b")
    links = copies.union(found)
    grouped = components(links)
    known = lists.join(grouped, "id", "left").select("token", "id", "n", "k", "band", F.coalesce("component", "id").alias("component"))
    ends = {"low": (F.min("component"), F.min("low")), "high": (F.max("component"), F.max("high"))}
    open_ = settled(_told(settled(known), ["token"], holders | ends, F.col("low") < F.col("high")).drop("low", "high"))
    short = _verified(_all_pairs(open_.where(F.col("holders") <= SHORT), num, den), needed, words, num, den).where("linked").select("a", "b")
    long = _compared(open_.where(F.col("holders") > SHORT), prefixed, needed, words, num, den)
    more = settled(short.union(long))
    grouped = components(grouped.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    return sets.join(grouped, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _in_common(row: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """How many hashes each two of ``size`` sets share, from the (set, hash) pairs of all of them, as whole 32-bit floats.

    Beside the result it holds STRIP rows of it and HASHES columns of who has what."""
    keys, times = counted(h)
    keys = keys[times > 1]  # what one set alone has is in no intersection
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    hit = keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)
    row, at = row[hit], at[hit]
    common = np.zeros((size, size), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    strips = [(a, min(a + STRIP, size)) for a in range(0, size, STRIP)]
    for s in range(0, len(keys), HASHES):
        i, j = np.searchsorted(at, (s, s + HASHES))
        has = np.zeros((size, min(HASHES, len(keys) - s)), dtype=np.float32)
        has[row[i:j], at[i:j] - s] = 1
        for a, b in strips:
            common[a:b, a:] += has[a:b] @ has[a:].T
    for a, b in strips:
        common[b:, a:b] = common[a:b, b:].T
    return common


def _in_blocks(lists: DataFrame, payload: DataFrame, on: list[str], block: int) -> DataFrame:
    """The documents of each (token, at) that still spans several components, in pairs of blocks low and high, with payload.

    ``at`` is a band of sizes: documents of the band meet each other and those of the band below.
    """
    spans = lists.groupBy("token", "at").agg(F.count("*").alias("holders"), F.min("component").alias("least"), F.max("component").alias("most"), F.max("band").alias("top"))
    many = F.ceil(F.col("holders") / block).cast("int")
    # a list may hold a third of all rows, so its documents meet its size under several salts; long lists are few to their rows
    sizes = spans.where("least < most and top = at").select("token", "at", many.alias("many"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lists.withColumn("salt", F.pmod(F.xxhash64("id", "token"), F.lit(SALTS)).cast("int")).join(sizes, ["token", "at", "salt"])
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("many")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    blocks = dealt.select("token", "at", "id", "n", "k", "band", "component", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    return blocks.join(payload, on)


def _compared(lists: DataFrame, prefixed: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between components among the documents of each list; enough of them to connect what is linked.

    Two documents that share several lists are candidates in the first of these only."""
    near = lists.select("token", "id", "n", "k", "band", "component", F.explode(F.array("band", F.col("band") + 1)).alias("at"))

    def may_meet(table: pa.Table, some: slice) -> np.ndarray:
        """Which two rows, the first one of ``some``, are of different components, and of different blocks if two meet here."""
        groups, mine = (np.asarray(table.column(c)) for c in ("component", "mine"))
        apart = groups[some, None] != groups[None, :]
        if table.column("low")[0].as_py() != table.column("high")[0].as_py():
            apart &= mine[some, None] != mine[None, :]
        return apart

    def contend(table: pa.Table) -> pa.Table:
        n, k, band = (np.asarray(table.column(c)).astype(np.int64) for c in ("n", "k", "band"))
        own = band == table.column("at")[0].as_py()
        prefix = table.column("prefix").combine_chunks()
        size = np.asarray(pa.compute.list_value_length(prefix)).astype(np.int64)
        h = np.asarray(prefix.flatten()).view(np.uint64)
        matches = _in_common(np.repeat(np.arange(len(n)), size), h, len(n))
        held = table.column("lists").combine_chunks()
        row, token = np.repeat(np.arange(len(n)), np.asarray(pa.compute.list_value_length(held)).astype(np.int64)), np.asarray(held.flatten())
        before = token < table.column("token")[0].as_py()
        matches[_in_common(row[before], token[before].view(np.uint64), len(n)) > 0] = 0  # they met in an earlier list; all want a match
        found = np.zeros(len(n), dtype=bool)
        for some in (slice(a, a + STRIP) for a in range(0, len(n), STRIP)):
            fits = (matches[some] >= np.minimum(k[some, None], k[None, :])) & (np.minimum(n[some, None], n[None, :]) * den >= np.maximum(n[some, None], n[None, :]) * num)
            found[some] = (fits & (own[some, None] | own[None, :]) & may_meet(table, some)).any(axis=1)
        return table.select(["token", "at", "id", "n", "k", "band", "component"]).take(pa.array(np.flatnonzero(found)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        groups = np.asarray(table.column("component"))
        sets = [shingle_sets(part.column("text"), words) for part in text_slices(iter(table.select(["text"]).to_batches()), "text", 2 << 20)]
        h, n = (np.concatenate([f(x) for x in sets]) for f in (lambda x: x[0], lambda x: np.diff(x[1])))
        shared = _in_common(np.repeat(np.arange(len(n)), n), h, len(n)).astype(np.int64)
        linked = den * shared >= num * (n[:, None] + n[None, :] - shared)
        linked &= (n > 0)[:, None] & (n > 0)[None, :] & may_meet(table, slice(None))
        a, b = np.nonzero(linked)
        # a forest over the components met here says as much as all links
        names = np.unique(groups)
        label = roots(len(names), np.searchsorted(names, groups[a]), np.searchsorted(names, groups[b]))
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[label[moved]]})

    blocks = ["token", "at", "low", "high"]
    one = ["id", "n", "k", "band"]
    held = lists.groupBy(*one).agg(F.collect_set("token").alias("lists"))  # no more than a prefix has
    met = _in_blocks(near, prefixed.join(held, one).select(*one, "prefix", "lists"), one, PREFIXES).select(*blocks, "mine", *one, "component", "prefix", "lists")
    contenders = settled(met.groupBy(*blocks).applyInArrow(contend, "token long, at int, id long, n int, k int, band int, component long").distinct())
    whole = _in_blocks(contenders, texts, ["id"], BLOCK).select(*blocks, "mine", "id", "component", "text")
    return whole.groupBy(*blocks).applyInArrow(compare, "a long, b long")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df``, all their columns, of the smallest id of each component of ``link_texts``.

    Rows without an id or without words stay. Of several rows with one id, the first in the order of all columns stays. Null
    and empty texts, ties and repeated rows are as in ``link_texts``; an empty table stays empty, and columns of any name stay.
    """
    linked = link_texts(df, id_col, text_col, words, num, den)
    gone = linked.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = df.join(gone, id_col, "left_anti").select(*df.columns)
    # maps and variants have no order of their own
    order = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes if c != id_col]
    place = new_name(df, "row_of_id")
    # Spark keeps the first row of an id in each task before it sends rows, however many an id has
    # a row without an id is alone, whatever others there are
    alone, named = kept.where(F.col(id_col).isNull()), kept.where(F.col(id_col).isNotNull())
    firsts = named.withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(*(order or [F.lit(0)])))).where(F.col(place) == 1)
    return firsts.drop(place).union(alone)


def _leader_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Each document of a list with the list's leader among those of about its size."""
    met = _told(lists, ["token", "band"], {"leader": (F.min(F.struct("id", "n", "k")), F.min("leader"))}).where("id <> leader.id")
    pairs = met.select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b"), F.col("n").alias("na"), F.col("leader.n").alias("nb"), F.least("k", "leader.k").alias("k"))
    return pairs.where(_near_sizes(num, den)).groupBy("a", "b").agg(F.count("*").alias("matches"), F.min("k").alias("k")).where("matches >= k").select("a", "b")


def _all_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share as many of their prefixes as the less demanding one of them asks for."""
    one = lists.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"), F.col("component").alias("ca"))
    two = lists.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"), F.col("component").alias("cb"))
    pairs = one.join(two, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near_sizes(num, den))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("matches"), F.min(F.least("ka", "kb")).alias("k")).where("matches >= k").select("a", "b")
