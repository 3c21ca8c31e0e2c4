"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors at random directions, sending those near a split to both sides; vectors that share a leaf of
any tree are compared, exactly and in double precision, and linked at the threshold. Trees are fitted on a bounded sample
and then route every vector. A leaf that more than a block of all vectors reach is split further, each level at the median of
the leaf's own sample along one more direction, as many levels as its count asks for: leaves stay of bounded size however
many vectors there are, and the forest does not grow. A vector travels once for each part of a tree, some thousand vectors under
one node, and is compared there leaf by leaf. What is too tight to split, a group of near copies, is compared block by block, in
as many tasks, so that no group has to be cut or dropped; identical vectors are one vector with a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, distinct, settled
from .components import components, roots

#: Vectors (those of smallest hashed id) the trees are fitted on; vectors a leaf should hold; vectors compared at a time.
SAMPLE, LEAF, BLOCK = 32_768, 256, 1024
TREES, DIRECTIONS, DEPTH = 10, 24, 24
#: Half-width of the overlap at a split, in standard deviations of a projected pair at the threshold; and the share of a
#: node's vectors in the overlap above which it is too tight to split and stays a leaf.
SPILL, TIGHT = 0.5, 0.5
#: Levels a leaf can be split further by, and the share in the overlap above which a direction would add more comparisons
#: than it saves.
FURTHER, FURTHER_TIGHT = 20, 0.25
#: Vectors a part should hold (one with twice as many goes leaf by leaf, as does one with a leaf of over LARGE blocks), and
#: vectors routed at a time.
PART, LARGE, SLICE = 8192, 4, 512


@dataclass
class Tree:
    """Nodes by number: direction (-1 for a leaf), threshold and left child; the right child is the next number. A leaf's ``part``
    is the node it is compared under, and ``part_levels`` are the further levels by which that is split.

    A leaf's directions for further levels are in ``further``, the one with least overlap first (-1: none), their medians in
    ``at``, and the share of the leaf that should be left after each in ``share``; ``levels`` of them are in use.
    """

    direction: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    part: np.ndarray
    part_levels: np.ndarray
    further: np.ndarray
    at: np.ndarray
    share: np.ndarray
    levels: np.ndarray


@dataclass
class Forest:
    directions: np.ndarray  # columns, DIRECTIONS for each tree
    trees: list[Tree]
    margin: float

    @property
    def width(self) -> int:
        return max(len(t.direction) for t in self.trees)

    @property
    def bits(self) -> int:
        """Further levels in use: the bits of a code after its node."""
        return int(max(t.levels.max() for t in self.trees))

    @property
    def kind(self) -> str:
        """The smallest type that holds all codes."""
        return "u4" if (len(self.trees) * self.width) << self.bits < 1 << 32 else "i8"

    def bare(self) -> Forest:
        """The same trees without levels that are not in use."""
        none = np.zeros((0, 0))
        return replace(self, trees=[t if t.levels.any() else replace(t, further=none, at=none, share=none) for t in self.trees])

    def deepen(self, sizes: dict[int, int], most: int) -> bool:
        """Splits leaves further, given the vectors that reach each code, towards ``most`` in a leaf. False if none can be."""
        bits, width = self.bits, self.width
        for code, n in sizes.items():
            t, node = divmod(code >> bits, width)
            tree = self.trees[t]
            usable = int((tree.further[node] >= 0).sum())
            left = n * np.concatenate(([1.0], tree.share[node, :usable]))
            tree.levels[node] = min(usable, int((left > most).sum()))
            tree.part_levels[node] = min(tree.levels[node], int((left > PART).sum())) if tree.part[node] == node else 0
        for tree in self.trees:  # what is not in use is not sent to tasks
            tree.further[tree.levels == 0], tree.at[tree.levels == 0] = -1, 0.0
            deepest = max(1, int(tree.levels.max()))
            tree.further, tree.at, tree.share = tree.further[:, :deepest].copy(), tree.at[:, :deepest].copy(), tree.share[:0]
        return any(tree.levels.any() for tree in self.trees)

    def leaves(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tree (vector, code of a leaf) pairs; a vector near splits has several. Codes of earlier trees are smaller."""
        projected = unit @ self.directions
        width, bits, found = self.width, self.bits, []
        for t, tree in enumerate(self.trees):
            rows, nodes = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
            done: list[tuple[np.ndarray, np.ndarray]] = []
            while len(rows):
                d = tree.direction[nodes]
                leaf = d < 0
                done.append((rows[leaf], nodes[leaf]))
                rows, nodes, d = rows[~leaf], nodes[~leaf], d[~leaf]
                off = projected[rows, t * DIRECTIONS + d] - tree.threshold[nodes]
                low, high = off <= self.margin, off > -self.margin
                rows, nodes = np.concatenate((rows[low], rows[high])), np.concatenate((tree.left[nodes[low]], tree.left[nodes[high]] + 1))
            rows, nodes = np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])
            cells = np.zeros(len(rows), dtype=np.int64)
            for level in range(int(tree.levels.max())):
                more = tree.levels[nodes] > level
                off = projected[rows, t * DIRECTIONS + tree.further[nodes, level]] - tree.at[nodes, level]
                low, high = ~more | (off <= self.margin), more & (off > -self.margin)
                rows, nodes = np.concatenate((rows[low], rows[high])), np.concatenate((nodes[low], nodes[high]))
                cells = np.concatenate((cells[low], cells[high] | 1 << level))
            found.append((rows, (t * width + nodes) << bits | cells))
        return found

    def part_table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node of all trees the code of its part, and the bits of a code that tell parts of that node apart."""
        part, mask = np.zeros((2, len(self.trees), self.width), dtype=np.int64)
        for t, tree in enumerate(self.trees):
            part[t, : len(tree.part)] = (t * self.width + tree.part) << self.bits
            mask[t, : len(tree.part)] = (1 << tree.part_levels) - 1
        return part.reshape(-1), mask.reshape(-1)

    def parts(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from codes of leaves to those of their parts, which are negative."""
        (part, mask), bits = self.part_table(), self.bits
        return lambda codes: -1 - (part[codes >> bits] | codes & mask[codes >> bits])


def fit_forest(sample: np.ndarray, total: int, threshold: float, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Trees over unit vectors ``sample`` of ``total`` vectors, with leaves of about ``leaf`` of all vectors."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    directions = rng.normal(size=(dim, DIRECTIONS * trees))
    directions /= np.linalg.norm(directions, axis=0)
    margin = SPILL * np.sqrt(2 * (1 - threshold) / dim)
    smallest, whole = max(16, leaf * len(sample) / max(total, 1)), PART * len(sample) / max(total, 1)
    projected = sample @ directions
    grown = []
    for t in range(trees):
        direction, cut, left, part, ends = [-1], [0.0], [0], [-1], []
        open_ = [(0, np.arange(len(sample)), 0)]
        while open_:
            node, rows, depth = open_.pop()
            if part[node] < 0 and len(rows) <= whole:
                part[node] = node
            for _ in range(3 if len(rows) > smallest and depth < DEPTH else 0):  # a tight node may still split well along another direction
                d = int(rng.integers(DIRECTIONS))
                p = projected[rows, t * DIRECTIONS + d]
                at = float(np.quantile(p, rng.uniform(0.35, 0.65)))
                if (np.abs(p - at) <= margin).mean() <= TIGHT:
                    direction[node], cut[node], left[node] = d, at, len(direction)
                    direction += [-1, -1]
                    cut += [0.0, 0.0]
                    left += [0, 0]
                    part += [part[node]] * 2
                    open_ += [(left[node], rows[p - at <= margin], depth + 1), (left[node] + 1, rows[p - at > -margin], depth + 1)]
                    break
            else:
                part[node] = node if part[node] < 0 else part[node]
                ends.append((node, rows))
        further, (at, share) = np.full((len(direction), FURTHER), -1, dtype=np.int16), np.zeros((2, len(direction), FURTHER))
        for node, rows in ends:
            p = projected[rows, t * DIRECTIONS : (t + 1) * DIRECTIONS]
            median = np.median(p, axis=0)
            overlap = (np.abs(p - median) <= margin).mean(axis=0)
            best = np.argsort(overlap, kind="stable")[:FURTHER]
            best = best[overlap[best] <= FURTHER_TIGHT]
            further[node, : len(best)], at[node, : len(best)] = best, median[best]
            share[node, : len(best)] = np.cumprod((1 + overlap[best]) / 2)
        levels = np.zeros(len(direction), dtype=np.int64)
        grown.append(Tree(np.array(direction), np.array(cut), np.array(left), np.array(part), levels.copy(), further, at, share, levels))
    return Forest(directions, grown, margin)


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column in its own precision; shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
    out = np.zeros((len(size), dim), dtype=flat.dtype)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    out = rows.astype(np.float64)
    return out / np.linalg.norm(out / np.abs(out).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(out).max(axis=1, keepdims=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector has some hundred leaves and parts, so few are routed at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _codes(vectors: DataFrame, forest: Forest, dim: int) -> DataFrame:
    """``code`` and ``n`` vectors of each leaf and of each part."""
    forest, parts = forest.bare(), forest.parts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, codes = (np.concatenate(x) for x in zip(*forest.leaves(_unit(_padded(batch.column("vector"), dim)))))
            _, once = _once(rows, parts(codes))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in counted(np.concatenate((codes, once)))], ["code", "n"])

    return vectors.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _once(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of a row and a key once, in order."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[first], keys[first]


def _route(vectors: DataFrame, forest: Forest, dim: int, large: np.ndarray) -> DataFrame:
    """A row for each vector and part, and instead of a part in ``large`` for each of its leaves that the vector is in: ``code`` of
    the part or leaf, the vector's values, and ``codes``, all leaves of the vector."""
    forest, parts, kind = forest.bare(), forest.parts(), forest.kind
    names = ["id", "h", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            padded = _padded(batch.column("vector"), dim)
            rows, codes = _once(*(np.concatenate(x) for x in zip(*forest.leaves(_unit(padded)))))
            own = np.split(codes.astype(kind), np.searchsorted(rows, np.arange(1, batch.num_rows)))
            packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (padded, own)]
            part = parts(codes)
            rows, keys = _once(rows, np.where(np.isin(part, large), codes, part))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), pa.array(keys), *(c.take(take) for c in packed)], [*names, "code", "vector", "codes"])

    return vectors.mapInArrow(run, "id long, h long, copies long, code long, vector binary, codes binary")


def _in_blocks(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each pair of blocks (low, high) of its leaf that a vector is in; a leaf of one block, or a part, has one pair."""
    many = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))
    spread = routed.join(sizes.where("code >= 0"), "code", "left").withColumn("mine", F.shiftright("h", 1).bitwiseAND((1 << 40) - 1) % many)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return spread.select("code", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "id", "h", "copies", "vector", "codes")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _first(flat: np.ndarray, bounds: np.ndarray, code: int, own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs (a, b) of places in ``own``, whether the rows there share no code below ``code``; the codes of row i are in ``flat``
    from bounds[i] to bounds[i + 1]."""
    sizes = bounds[own + 1] - bounds[own]
    codes, row = flat[_spans(bounds[own], sizes)], np.repeat(np.arange(len(own)), sizes)
    row, codes = row[codes < code], codes[codes < code]
    names, n = counted(codes)
    names = names[n > 1]
    out = np.ones(len(a), dtype=bool)
    if len(names):
        at = np.minimum(np.searchsorted(names, codes), len(names) - 1)
        held = names[at] == codes
        has = np.zeros((len(own), len(names)), dtype=bool)
        has[row[held], at[held]] = True
        step = max(1, (1 << 23) // len(names))
        for s in range(0, len(a), step):
            out[s : s + step] = ~(has[a[s : s + step]] & has[b[s : s + step]]).any(axis=1)
    return out


def _compare(threshold: float, dim: int, forest: Forest, value: str):
    parts, kind, block = forest.parts(), forest.kind, BLOCK

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).combine_chunks()
        ids, hashes, copies, mine = (np.asarray(column(c)) for c in ("id", "h", "copies", "mine"))
        code, low, high = (int(table.column(c)[0].as_py()) for c in ("code", "low", "high"))
        unit = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), value).reshape(-1, dim))
        lists = table.column("codes").to_pylist()
        bounds = np.concatenate(([0], np.cumsum([len(x) // np.dtype(kind).itemsize for x in lists])))
        flat = np.frombuffer(b"".join(lists), kind).astype(np.int64)
        links, edges = np.zeros(len(ids), dtype=np.int64), []

        def meet(leaf: int, x: np.ndarray, y: np.ndarray | None = None) -> None:
            """Links of the rows x of a leaf among each other, or with the rows y."""
            near = unit[x] @ unit[x if y is None else y].T >= threshold
            i, j = np.nonzero(np.triu(near, 1) if y is None else near)
            if len(i):
                own, place = np.unique(np.concatenate((x[i], (x if y is None else y)[j])), return_inverse=True)
                a, b = place[: len(i)], place[len(i) :]
                first = _first(flat, bounds, leaf, own, a, b)  # a pair is counted in the first leaf that both vectors have
                a_first, b_first = a[first], b[first]
                links[own] += np.bincount(a_first, copies[own[b_first]], len(own)).astype(np.int64) + np.bincount(b_first, copies[own[a_first]], len(own)).astype(np.int64)
                edges.append((own, own[roots(len(own), a, b)]))

        if code >= 0:
            meet(code, *([np.arange(len(ids))] if low == high else [np.flatnonzero(mine == low), np.flatnonzero(mine == high)]))
        else:
            here = np.flatnonzero(parts(flat) == code)
            order = here[np.argsort(flat[here], kind="stable")]
            members, leaves = np.repeat(np.arange(len(ids)), np.diff(bounds))[order], flat[order]
            cuts = np.flatnonzero(np.diff(leaves, prepend=-1, append=-1))
            for s, e in zip(cuts, cuts[1:]):
                blocks = [members[i : min(i + block, e)] for i in range(s, e, block)]
                for i, x in enumerate(blocks):
                    meet(int(leaves[s]), x)
                    for y in blocks[:i]:
                        meet(int(leaves[s]), x, y)
        a, b = np.concatenate([np.zeros((2, 0), dtype=np.int64), *edges], axis=1)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][roots(len(ids), place[a], place[b])][place]
        out = np.zeros(len(ids), dtype=bool)
        out[a] = True
        return pa.table({"id": ids[out], "h": hashes[out], "links": links[out], "root": root[out]})

    return run


def link_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES) -> DataFrame:
    """id, ``n_links``, ``component_id`` and ``kept`` for every row of ``df``.

    ``n_links`` counts the other rows linked directly, found with cosine at or above ``threshold``; never one below it.
    ``component_id`` is the smallest id reachable by links. Vectors that are null, empty, all zero, or hold a null or a
    non-finite number link with nothing, as do rows without an id (their component is null). Shorter vectors count as padded
    with zeros. Repeated rows and equal vectors link with each other. Rows of one id with different vectors have the links of
    their own vector each, and one component, that of the id. An empty table gives an empty result; other columns of ``df``,
    whatever their names, are left out.
    """
    value = "float" if df.schema[vector_col].dataType == T.ArrayType(T.FloatType(), df.schema[vector_col].dataType.containsNull) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{value}>").alias("vector"))
    good = F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = rows.where(good)
    vectors = settled(usable.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", "vector", F.xxhash64("id", F.col("vector").cast("array<double>")).alias("h")))
    total, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    sample = vectors.orderBy("h", "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    schema = "id long, h long, links long, root long"
    if total:
        forest = fit_forest(_unit(_padded(sample, dim)), total, threshold, trees)
        sizes = settled(_codes(vectors, forest, dim).where(F.col("n") > BLOCK))
        over = sizes.where("code >= 0").toArrow()  # at most all leaves of the forest, which does not grow
        if forest.deepen(dict(zip(over.column("code").to_pylist(), over.column("n").to_pylist())), BLOCK):
            sizes = settled(_codes(vectors, forest, dim).where(F.col("n") > BLOCK))
        over = sizes.where(F.col("n") > F.when(F.col("code") < 0, 2 * PART).otherwise(LARGE * BLOCK)).select("code").toArrow().column("code").to_numpy()
        large = distinct(np.where(over < 0, over, forest.parts()(np.maximum(over, 0))))
        routed = _in_blocks(_route(vectors, forest, dim, large), sizes)
        found = settled(routed.groupBy("code", "low", "high").applyInArrow(_compare(threshold, dim, forest, "f4" if value == "float" else "f8"), schema))
    else:
        found = df.sparkSession.createDataFrame([], schema)
    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = vectors.join(links, ["id", "h"], "left").join(grouped, "id", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component")
    )
    linked = usable.join(classes, "vector").select("id", "links", "component")
    alone = rows.where(~good | good.isNull()).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
