"""Calibration maps per key, kept as a table and applied by a join.

Predictions with equal probability and outcome are counted before a map is fitted,
so the fit sees weighted distinct points and gives the map of all rows. A fitted map is a list of line pieces (isotonic) or two coefficients
(Platt); applying it is one pass over the predictions for all keys. All keys are fitted
together: violators are pooled within slices of the probability, then what is left of the
slices' blocks is pooled per key; Platt's coefficients take a few Newton steps, each one
aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1000
SLICES = 64  # of the probability, within which violators are pooled first
NEWTON_STEPS = 30
KEYS = ["horizon", "multiplier"]
PIECES = "horizon string, multiplier string, lo double, hi double, y_lo double, y_hi double, slope double, intercept double"
BLOCKS = "horizon string, multiplier string, slice int, lo double, hi double, total double, weight double"


def distinct_points(predictions: DataFrame) -> DataFrame:
    """Weighted (probability, outcome) points per key."""
    return predictions.groupBy("horizon", "multiplier", "probability", F.col("outcome").cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Adjacent blocks in order of ``lo``, joined while a mean is not above the one before."""
    out: list[tuple[float, float, float, float]] = []
    for block in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist()):
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            a = out.pop()
            block = (a[0], block[1], a[2] + block[2], a[3] + block[3])
        out.append(block)
    return out


def _pool_slice(rows: pd.DataFrame) -> pd.DataFrame:
    own = rows.sort_values("lo")
    blocks = pooled(*(own[c].to_numpy() for c in ("lo", "hi", "total", "weight")))
    return pd.DataFrame([(own["horizon"].iloc[0], own["multiplier"].iloc[0], own["slice"].iloc[0], *b) for b in blocks], columns=["horizon", "multiplier", "slice", "lo", "hi", "total", "weight"])


def _pieces(rows: pd.DataFrame) -> pd.DataFrame:
    """Line pieces of a key: level within a block, straight between blocks, level beyond the ends."""
    own = rows.sort_values("lo")
    blocks = pooled(*(own[c].to_numpy() for c in ("lo", "hi", "total", "weight")))
    points = [(x, t / w) for lo, hi, t, w in blocks for x in dict.fromkeys((lo, hi))]
    lines = [(-math.inf, points[0][0], points[0][1], points[0][1]), *((a, b, u, v) for (a, u), (b, v) in zip(points, points[1:])), (points[-1][0], math.inf, points[-1][1], points[-1][1])]
    key = (own["horizon"].iloc[0], own["multiplier"].iloc[0])
    return pd.DataFrame([(*key, *line, None, None) for line in lines], columns=[*KEYS, "lo", "hi", "y_lo", "y_hi", "slope", "intercept"])


def _platt(points: DataFrame) -> DataFrame:
    """Slope and intercept of every key by Newton steps, each one aggregation over all points; keys with one outcome stay at its rate."""
    spark, p, y, w = points.sparkSession, F.col("probability"), F.col("label"), F.col("weight")
    now = {(r["horizon"], r["multiplier"]): (0.0, math.log((r["n1"] + 0.5) / (r["n0"] + 0.5))) for r in points.groupBy(*KEYS).agg(F.sum(y * w).alias("n1"), F.sum((1 - y) * w).alias("n0")).collect()}  # one row per key
    for _ in range(NEWTON_STEPS):
        at = spark.createDataFrame([(*k, *v) for k, v in now.items()], "horizon string, multiplier string, a double, b double")
        f = 1.0 / (1.0 + F.exp(-(F.col("a") * p + F.col("b"))))
        d, h = w * (f - y), w * f * (1.0 - f)
        sums = points.join(at, KEYS).groupBy(*KEYS).agg(F.sum(d * p).alias("ga"), F.sum(d).alias("gb"), F.sum(h * p * p).alias("haa"), F.sum(h * p).alias("hab"), F.sum(h).alias("hbb")).collect()
        most = 0.0
        for r in sums:
            det = (r["haa"] + 1e-9) * (r["hbb"] + 1e-9) - r["hab"] ** 2
            da, db = ((r["hbb"] + 1e-9) * r["ga"] - r["hab"] * r["gb"]) / det, ((r["haa"] + 1e-9) * r["gb"] - r["hab"] * r["ga"]) / det
            size = max(abs(da), abs(db))
            shrink = min(1.0, 5.0 / size) if size else 1.0  # separable points have no finite optimum; steps stay short
            a, b = now[(r["horizon"], r["multiplier"])]
            now[(r["horizon"], r["multiplier"])] = (a - shrink * da, b - shrink * db)
            most = max(most, size)
        if most < 1e-9:
            break
    return spark.createDataFrame([(*k, None, None, None, None, *v) for k, v in now.items()], PIECES)


def fit_calibration(predictions: DataFrame, *, method: str = "isotonic") -> DataFrame:
    """Calibration table for every key of the predictions (horizon, multiplier, probability, outcome)."""
    if method not in ("isotonic", "platt"):
        raise ValueError(f"unknown method: {method}")
    points = distinct_points(predictions).where(F.col("probability").isNotNull() & F.col("label").isNotNull())
    if method == "platt":
        points = points.persist()
        out = _platt(points)
        points.unpersist()
        return out
    p = F.col("probability")
    cells = points.groupBy(*KEYS, p.alias("lo")).agg(F.sum(F.col("label") * F.col("weight")).alias("total"), F.sum("weight").alias("weight"))
    sliced = cells.select(*KEYS, F.floor(F.col("lo") * SLICES).cast("int").alias("slice"), "lo", F.col("lo").alias("hi"), "total", "weight")
    blocks = sliced.groupBy(*KEYS, "slice").applyInPandas(_pool_slice, BLOCKS)
    return blocks.groupBy(*KEYS).applyInPandas(_pieces, PIECES)


def apply_calibration(predictions: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``calibrated``; keys without a map keep their probability.

    Line pieces are spread over the probability cells they touch, so the lookup
    is a hash join on (key, cell). The table has two rows per pooled block at most;
    whether it is broadcast is left to its size.
    """
    ks = ["horizon", "multiplier"]
    cell = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int")
    p = F.col("probability")
    lines = table.where(F.col("lo").isNotNull()).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    platt = table.where(F.col("slope").isNotNull()).select(*ks, "slope", "intercept")
    part = F.when(F.col("lo") == float("-inf"), F.col("y_hi")).when(F.col("hi") == float("inf"), F.col("y_lo")).otherwise(
        F.col("y_lo") + (p - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("y_hi") - F.col("y_lo")))
    a, b = predictions.withColumn("cell", cell(p)).alias("a"), lines.select(*ks, "cell", "lo", "hi", "y_lo", "y_hi").alias("b")
    on = (F.col("a.horizon") == F.col("b.horizon")) & (F.col("a.multiplier") == F.col("b.multiplier")) & (F.col("a.cell") == F.col("b.cell")) & (p >= F.col("lo")) & (p < F.col("hi"))
    iso = a.join(b, on, "left").select("a.*", part.alias("isotonic")).drop("cell")
    both = iso.join(platt, ks, "left")
    logit = 1.0 / (1.0 + F.exp(-(F.col("slope") * p + F.col("intercept"))))
    return both.withColumn("calibrated", F.coalesce("isotonic", logit, p)).drop("isotonic", "slope", "intercept")
