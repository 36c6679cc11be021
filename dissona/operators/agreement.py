"""Agreement of raters, calibration of confidences, and the logistic fit of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_N, LOW_KAPPA, DEGENERATE = 5, 0.6, 1e-12
MAX_ITER, GRADIENT_TOL, RIDGE, MIN_STEP = 100, 1e-7, 1e-12, 1e-10


def kappa_pairs(long: DataFrame, cell: list[str], item: str, rater: str, label: str) -> DataFrame:
    """(cell, pair, n, kappa): Cohen's kappa of every pair of raters (named a-b, a < b) over the items that both rated.

    Null where chance agreement is 1."""
    a, b = long.alias("a"), long.alias("b")
    on = F.col(f"a.{item}") == F.col(f"b.{item}")
    for c in cell:
        on &= F.col(f"a.{c}") == F.col(f"b.{c}")
    both = a.join(b, on & (F.col(f"a.{rater}") < F.col(f"b.{rater}"))).select(*[F.col(f"a.{c}").alias(c) for c in cell], F.concat_ws("-", f"a.{rater}", f"b.{rater}").alias("pair"), F.col(f"a.{label}").alias("x"), F.col(f"b.{label}").alias("y"))
    keys = [*cell, "pair"]
    total = both.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("same"))
    sides = both.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("x").alias("v")), F.struct(F.lit(1).alias("s"), F.col("y").alias("v")))).alias("e"))
    margin = sides.groupBy(*keys, F.col("e.v").alias("v")).agg(F.count(F.when(F.col("e.s") == 0, 1)).alias("cx"), F.count(F.when(F.col("e.s") == 1, 1)).alias("cy"))
    chance = margin.groupBy(*keys).agg(F.sum(F.col("cx") * F.col("cy")).alias("d"))
    j = total.join(chance, keys)
    pe, po = F.col("d") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    return j.select(*keys, "n", F.when(F.abs(1 - pe) > DEGENERATE, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def kappa_cells(pairs: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, n, min_kappa, low_n, low_reliability) over the pairs of each cell."""
    g = pairs.groupBy(*cell).agg(F.max("n").alias("n"), F.min("kappa").alias("min_kappa"))
    low = F.col("n") < LOW_N
    return g.select(*cell, "n", "min_kappa", low.alias("low_n"), (~low & F.coalesce(F.col("min_kappa") < LOW_KAPPA, F.lit(False))).alias("low_reliability"))


def worst_cell(pairs: DataFrame, cell: list[str]) -> DataFrame:
    """The one (cell, pair) of the least kappa among those of enough items; of ties the first in order."""
    return pairs.where((F.col("n") >= LOW_N) & F.col("kappa").isNotNull()).orderBy("kappa", *cell, "pair").limit(1)


def calibration_bins(df: DataFrame, confidence: Column, hit: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, share): equal widths, the last one closed; confidences are clamped to 0..1."""
    c = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    b = F.least(F.floor(c * bins), F.lit(bins - 1)).cast("long")
    t = df.select(b.alias("bin"), c.alias("c"), hit.cast("double").alias("h"))
    return t.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("mean_confidence"), F.avg("h").alias("share"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece): mean distance of confidence and share, weighted by the bins' rows; no rows: 0."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("share"))) / F.sum("n")
    return bins.agg(F.round(F.coalesce(gap, F.lit(0.0)), 6).alias("ece"))


def fit_platt(x: np.ndarray, hit: np.ndarray, weight: np.ndarray) -> tuple[float, float, int]:
    """(a, b, rounds): Newton's method with halved steps on smoothed targets. x: distinct confidences; hit, weight: rows."""
    pos, neg = float(hit.sum()), float((weight - hit).sum())
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    target = hit * hi + (weight - hit) * lo  # summed targets at each confidence
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((weight * np.logaddexp(0, z) - target * z).sum())

    now, k = loss(a, b), 0
    for k in range(1, MAX_ITER + 1):
        p = 1 / (1 + np.exp(-(a * x + b)))
        d = weight * p - target
        g = np.array([(d * x).sum(), d.sum()])
        if np.abs(g).max() < GRADIENT_TOL:
            break
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + RIDGE, (w * x).sum()], [(w * x).sum(), w.sum() + RIDGE]])
        step = np.linalg.solve(h, g) if abs(np.linalg.det(h)) > 1e-300 else g
        size = 1.0
        while size >= MIN_STEP and (new := loss(a - size * step[0], b - size * step[1])) >= now + 1e-4 * size * -float(g @ step):
            size /= 2
        if size < MIN_STEP:
            break
        a, b, now = a - size * step[0], b - size * step[1], new
    return a, b, k


def platt_fit(df: DataFrame, cell: list[str], confidence: str, hit: str) -> DataFrame:
    """(cell, a, b, n) for each cell. Rows are first summed by distinct confidence, so a group is as long as those."""
    sums = df.groupBy(*cell, F.col(confidence).alias("c")).agg(F.sum(F.col(hit).cast("double")).alias("h"), F.count("*").cast("double").alias("w"))

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("c")
        a, b, _ = fit_platt(g["c"].to_numpy(float), g["h"].to_numpy(float), g["w"].to_numpy(float))
        return pd.DataFrame([[*key, a, b, int(g["w"].sum())]])

    types = dict(df.dtypes)
    return sums.groupBy(*cell).applyInPandas(fit, ", ".join(f"{c} {types[c]}" for c in cell) + ", a double, b double, n long")
