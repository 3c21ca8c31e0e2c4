"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in ``edges`` (a, b: long) but the smallest ones.

    Repeated edges and loops change nothing; an empty table gives an empty result. Raises an error if ``most_rounds`` do not
    suffice, rather than return what is not finished. Each round hangs every node, and every larger neighbour of a node, under the smallest neighbour; edges never increase
    and a few rounds flatten any tree. Minima are aggregated before they are joined, so a hub costs one row per neighbour.
    """
    flat, stamp = _noted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):  # a logarithmic number of them is enough
        both = flat.union(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large, _ = _noted(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        flat, now = _noted(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
        if now == stamp:
            return flat.select(F.col("u").alias("id"), F.col("v").alias("component"))
        stamp = now
    raise RuntimeError(f"components are not found after {most_rounds} rounds")


def _noted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges settled, and a stamp of them that is taken while they are written."""
    seen = Observation()
    noted = settled(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return noted, (seen.get["n"], seen.get["x"])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is linked to through pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new
