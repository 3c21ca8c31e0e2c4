"""Mixing a corpus to target weights.

Token weights of the cells (source, language, topic) are raked to target marginals by iterative proportional fitting, and
documents are drawn with probabilities proportional to their cell's weight per token, calibrated to a budget of tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_name, settled

WORDS = r"[^\x20\x09-\x0D]+"
MISSING = "(missing)"
#: Cells that are raked on the driver, a few numbers each. Categories are the operator's vocabulary (sources, languages,
#: topics), not data; group rare sources before mixing if there are more.
MOST_CELLS = 1_000_000


def tempered(cells: list[tuple], dimension: int, tokens: np.ndarray, alpha: float) -> dict[str, float]:
    """Target shares of a dimension's categories, in proportion to their tokens to the power ``alpha``."""
    sums: dict[str, float] = {}
    for cell, n in zip(cells, tokens.tolist()):
        sums[cell[dimension]] = sums.get(cell[dimension], 0.0) + n
    powered = {k: v**alpha for k, v in sums.items() if v > 0}
    total = sum(powered.values())
    return {k: v / total for k, v in powered.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: Sequence[dict[str, float]], rounds: int, tolerance: float = 0.0) -> np.ndarray:
    """Token weights of the cells after ``rounds`` of fitting to each dimension's target shares in turn.

    A category that a dimension's targets lack keeps weight 0; targets of categories without tokens are shared out among
    the others. It ends early once no margin is off by more than ``tolerance`` of the total.
    """
    weights, total = tokens.astype(float).copy(), float(tokens.sum())
    codes, goals = [], []
    for d, target in enumerate(targets):
        names = sorted({c[d] for c in cells})
        at = {n: i for i, n in enumerate(names)}
        codes.append(np.array([at[c[d]] for c in cells], dtype=np.int64))
        present = np.bincount(codes[-1], weights, minlength=len(names)) > 0
        goal = np.array([target.get(n, 0.0) for n in names]) * present
        goals.append(goal * (total / goal.sum()) if goal.sum() > 0 else goal)
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals):
            sums = np.bincount(code, weights, minlength=len(goal))
            worst = max(worst, float(np.abs(sums - goal).max(initial=0.0)))
            weights *= np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[code]
        if worst <= tolerance * total:
            break
    return weights


def calibrated(tokens: np.ndarray, ratios: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, s * ratio) with s such that the expected tokens are ``budget``, or all there are if fewer."""
    order = np.argsort(-ratios, kind="stable")
    t, r = tokens[order].astype(float), ratios[order]
    before = np.cumsum(t) - t
    rest = np.cumsum((t * r)[::-1])[::-1]
    scale = np.divide(budget - before, rest, out=np.full(len(t), np.inf), where=rest > 0)
    fits = np.flatnonzero(scale * r <= 1)
    s = scale[fits[0]] if len(fits) else np.inf
    with np.errstate(invalid="ignore"):
        return np.clip(np.where(ratios > 0, s * ratios, 0.0), 0.0, 1.0)


def uniform(id_col: str, seed: str) -> Column:
    """A number in [0, 1) for each id, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def mix(
    df: DataFrame, dimensions: dict[str, Column], share: float, alpha: float = 0.5, targets: dict[str, dict[str, float]] | None = None,
    id_col: str = "doc_id", text_col: str = "text", rounds: int = 25, seed: str = "mix",
) -> DataFrame:
    """id, the dimensions, ``n_tokens``, ``weight`` (wanted tokens per token), ``prob`` and ``sampled`` for every row.

    ``dimensions`` names columns over ``df``; null categories are the category ``(missing)``. Targets that are not given
    are ``tempered``. ``share`` of all tokens is the budget. A row is sampled if its id's fixed uniform number is below its
    probability, so repeated ids go together; null ids count as one id. Null and empty texts have no tokens and their cell's
    probability, 0 where the whole cell has none. Ties in the calibration have equal probabilities. An empty table gives an
    empty result; other columns of ``df`` are left out.
    """
    names = list(dimensions)
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    keyed = settled(df.select(F.col(id_col).alias("id"), *(F.coalesce(c.cast("string"), F.lit(MISSING)).alias(f"d{i}") for i, c in enumerate(dimensions.values())), tokens.alias("n")))
    ds = [f"d{i}" for i in range(len(names))]
    rows = keyed.groupBy(*ds).agg(F.sum("n").alias("n")).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells; group rare categories first")
    rows.sort()
    cells, counts = [tuple(r[:-1]) for r in rows], np.array([r[-1] for r in rows], dtype=np.int64)
    goals = [(targets or {}).get(name) or tempered(cells, i, counts, alpha) for i, name in enumerate(names)]
    weights = rake(cells, counts, goals, rounds)
    ratios = np.divide(weights, counts, out=np.zeros(len(cells)), where=counts > 0)
    probs = calibrated(counts, ratios, share * float(counts.sum()))
    spark = df.sparkSession
    schema = ", ".join(f"{d} string" for d in ds) + ", weight double, prob double"
    known = spark.createDataFrame([(*c, float(w), float(p)) for c, w, p in zip(cells, ratios, probs)], schema)
    # as many rows as cells, so at most MOST_CELLS; Spark broadcasts it where its size allows
    drawn = keyed.join(known, ds)
    return drawn.select(
        F.col("id").alias(id_col), *(F.col(d).alias(n) for d, n in zip(ds, names)), F.col("n").alias("n_tokens"),
        "weight", "prob", (uniform("id", seed) < F.col("prob")).alias("sampled"),
    )


def mixed_rows(df: DataFrame, dimensions: dict[str, Column], share: float, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all their columns, that ``mix`` samples: the cells' probabilities are looked up for each row.

    Null categories, ids and texts, ties and repeated rows are as in ``mix``; an empty table stays empty, and columns of any
    name stay as they are."""
    drawn = mix(df, dimensions, share, id_col=id_col, text_col=text_col, **options)
    names, prob = [new_name(df, f"mix_{i}") for i in range(len(dimensions))], new_name(df, "mix_prob")
    cells = drawn.groupBy(*dimensions).agg(F.max("prob").alias(prob)).toDF(*names, prob)
    keyed = df.withColumns({n: F.coalesce(c.cast("string"), F.lit(MISSING)) for n, c in zip(names, dimensions.values())})
    # a row for each cell, of which there are MOST_CELLS at most
    return keyed.join(F.broadcast(cells), names).where(uniform(id_col, options.get("seed", "mix")) < F.col(prob)).drop(*names, prob).select(*(F.col(f"`{c}`") for c in df.columns))
