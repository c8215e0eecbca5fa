"""Clusters of wallets that trade alike.

A wallet's signature is (mean holding hours, win rate, number of trades); two
wallets are alike when the mean normalised difference is under a threshold, and
clusters are the connected components of that relation. On u = ln(1 + hours) and
v = ln(1 + trades) a normalised difference is 1 - exp(-|du|), so the space is
covered with cells small enough that all wallets of a cell are alike. Only cells
are compared with cells; their number depends on the logarithm of the value
ranges and not on the number of wallets. A pair of cells whose corners settle
the question needs no wallet at all. Pairs that are unsettled and not already tied
through other cells are split: each cell into halves on every axis, until the corners of
some two parts settle it. A part of equal points has no extent, so this ends, and at no
time are the wallets of one cell paired with those of another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.operators.graph import connected_components
from chainsieve.session import cut_lineage


def trading_signature(closed: DataFrame) -> DataFrame:
    return closed.groupBy("wallet").agg(
        F.avg("holding_hours").alias("avg_hold"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("trades"))


def _bend(d: Column) -> Column:
    return 1.0 - F.exp(-d)


def _least_gap(axis: str) -> Column:
    """Smallest possible distance between two cells on one axis, from the extremes of their wallets."""
    return F.greatest(F.lit(0.0), F.col(f"x.lo_{axis}") - F.col(f"y.hi_{axis}"), F.col(f"y.lo_{axis}") - F.col(f"x.hi_{axis}"))


def _most_gap(axis: str) -> Column:
    return F.greatest(F.col(f"x.hi_{axis}") - F.col(f"y.lo_{axis}"), F.col(f"y.hi_{axis}") - F.col(f"x.lo_{axis}"))


def _span(gap) -> Column:
    return _bend(gap("u")) + gap("w") + _bend(gap("v"))


def pattern_clusters(signatures: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(wallet, cluster_id = smallest member) for clusters of at least two wallets.

    Holding times below zero count as zero.
    """
    limit, step = 3 * threshold, 0.8 * threshold
    u, v = F.log1p(F.greatest("avg_hold", F.lit(0.0))), F.log1p(F.col("trades").cast("double"))
    points = signatures.select("wallet", u.alias("u"), F.col("win_rate").alias("w"), v.alias("v"))
    for a in "uwv":
        points = points.withColumn(f"c{a}", F.floor(F.col(a) / step))
    points = cut_lineage(points)
    box = [f(a).alias(f"{n}_{a}") for a in "uwv" for n, f in (("lo", F.min), ("hi", F.max))]
    cells = points.groupBy("cu", "cw", "cv").agg(F.min("wallet").alias("rep"), *box)

    # Cells that may hold alike wallets lie within a fixed number of steps on the holding and win axes.
    reach_u = 64 if limit >= 1 else math.ceil(-math.log(1 - limit) / step) + 1
    reach_w = math.ceil(min(limit, 1.0) / step) + 1
    shifts = F.array(*[F.struct(F.lit(i).alias("du"), F.lit(j).alias("dw")) for i in range(0, reach_u + 1) for j in range(-reach_w, reach_w + 1)])
    moved = cells.withColumn("s", F.explode(shifts)).withColumn("ju", F.col("cu") + F.col("s.du")).withColumn("jw", F.col("cw") + F.col("s.dw"))
    near = moved.alias("x").join(cells.alias("y"), (F.col("x.ju") == F.col("y.cu")) & (F.col("x.jw") == F.col("y.cw"))).where(
        (F.col("x.rep") != F.col("y.rep")) & (_span(_least_gap) < limit))
    pairs = cut_lineage(near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), (_span(_most_gap) < limit).alias("sure")))

    sure = pairs.where("sure").select("a", "b")
    tied = connected_components(sure)
    root = lambda c, name: tied.select(F.col("vertex").alias(c), F.col("component").alias(name))
    open_ = pairs.where("not sure").join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left").where(
        F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").distinct()
    owned = points.join(cells.select("cu", "cw", "cv", "rep"), ["cu", "cw", "cv"]).select("rep", "u", "w", "v").distinct()
    found = _settled(owned, open_, step, limit)

    together = connected_components(sure.unionByName(found))
    member = points.join(cells.select("cu", "cw", "cv", "rep"), ["cu", "cw", "cv"]).join(together.withColumnRenamed("vertex", "rep"), "rep", "left")
    group = member.select("wallet", F.coalesce("component", "rep").alias("group"))
    # Every cell's representative is its smallest wallet, so a group is named by its smallest member.
    return _drop_single(group)


def _settled(points: DataFrame, pairs: DataFrame, step: float, limit: float) -> DataFrame:
    """Of the pairs (a, b) of cells ``rep``, those with alike wallets, by splitting both until corners decide."""
    key = lambda level: F.struct(*[F.floor(F.col(x) / (step / 2**level)).alias(x) for x in "uwv"])
    up = lambda k: F.struct(*[F.floor(F.col(f"{k}.{x}") / 2).alias(x) for x in "uwv"])
    box = [f(x).alias(f"{n}_{x}") for x in "uwv" for n, f in (("lo", F.min), ("hi", F.max))]
    found, level = None, 0
    pairs = pairs.withColumn("ka", F.lit(None)).withColumn("kb", F.lit(None))
    while True:
        level += 1
        live = points if level == 1 else points.withColumn("k", key(level - 1)).join(
            pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("ka").alias("k")), F.struct(F.col("b").alias("rep"), F.col("kb").alias("k")))).alias("s")).select("s.*").distinct(), ["rep", "k"], "left_semi").drop("k")
        parts = live.groupBy("rep", key(level).alias("k")).agg(*box)
        x, y = parts.withColumn("up", up("k")).alias("x"), parts.withColumn("up", up("k")).alias("y")
        first = (F.col("p.a") == F.col("x.rep")) if level == 1 else (F.col("p.a") == F.col("x.rep")) & (F.col("p.ka") == F.col("x.up"))
        second = (F.col("p.b") == F.col("y.rep")) if level == 1 else (F.col("p.b") == F.col("y.rep")) & (F.col("p.kb") == F.col("y.up"))
        near = pairs.alias("p").join(x, first).join(y, second).where(_span(_least_gap) < limit)
        near = cut_lineage(near.select("p.a", "p.b", F.col("x.k").alias("ka"), F.col("y.k").alias("kb"), (_span(_most_gap) < limit).alias("sure")))
        sure = near.where("sure").select("a", "b").distinct()
        found = sure if found is None else found.unionByName(sure)
        pairs = near.where("not sure").drop("sure").join(sure, ["a", "b"], "left_anti")
        if pairs.isEmpty():
            return found


def _drop_single(group: DataFrame) -> DataFrame:
    sizes = group.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return group.join(sizes, "group", "left_semi").select("wallet", F.col("group").alias("cluster_id"))
