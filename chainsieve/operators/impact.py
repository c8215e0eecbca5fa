"""Does a wallet lead or move the price: lagged correlation and counterfactual impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.operators.timing import bin_trades, price_move_after
from chainsieve.tables import money


def counterfactual_impact(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Volume share, price influence and what the token's return would be without the wallet."""
    moves = price_move_after(trades, prices)
    total = trades.groupBy("token").agg(F.sum(money("amount_usd")).cast("double").alias("total"))
    ret = prices.groupBy("token").agg(F.max_by("price", F.struct("ts", "price")).alias("p1"), F.min_by("price", F.struct("ts", "price")).alias("p0")).select(
        "token", ((F.col("p1") - F.col("p0")) / F.col("p0")).alias("ret"))
    per = trades.join(moves, ["token", "trade_id"], "left").groupBy("token", "wallet").agg(
        F.sum(money("amount_usd")).cast("double").alias("volume"),
        F.least(F.lit(1.0), F.avg(F.abs(F.coalesce("move", F.lit(0.0))) * F.log1p("amount_usd"))).alias("price_influence"))
    share = F.when(F.col("total") > 0, F.col("volume") / F.col("total")).otherwise(0.0)
    out = per.join(total, "token").join(ret, "token", "left").select(
        "token", "wallet", share.alias("volume_contribution"), "price_influence",
        F.coalesce(F.col("ret") * (1.0 - share), F.lit(0.0)).alias("counterfactual_returns"))
    score = F.least(F.lit(1.0), 0.4 * F.col("volume_contribution") + 0.4 * F.col("price_influence") + 0.2 * F.abs("counterfactual_returns"))
    # Report wording of the impact bands.
    text = (
        F.when(score < 0.1, "Negligible market impact. Wallet is a price taker.")
        .when(score < 0.3, "Low market impact. Minor influence on price movements.")
        .when(score < 0.6, "Moderate market impact. Significant player in this token.")
        .otherwise("High market impact. Wallet likely moves the market."))
    return out.withColumn("impact_score", score).withColumn("interpretation", text)


def lead_lag(trades: DataFrame, prices: DataFrame, minutes: int = 15, max_lag: int = 5) -> DataFrame:
    """Per token, wallet and lag: correlation of binned volume with the price change ``lag`` bins later.

    Most bins of a wallet are empty, and an empty bin adds nothing to the sums of
    volume, so the sums over the full grid come from the non-empty bins plus the
    token's own totals; the dense (wallet x bin) grid is never built. The F
    statistic compares that one-regressor model with the constant one.
    """
    width = minutes * 60 * 1_000_000
    span = prices.groupBy("token").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    binned = prices.join(span, "token").groupBy(
        "token", F.floor((F.unix_micros("ts") - F.unix_micros("start")) / width).alias("bin"),
        F.floor((F.unix_micros("end") - F.unix_micros("start")) / width).alias("last")).agg(F.max_by("price", F.struct("ts", "price")).alias("price"))
    prior = binned.select("token", (F.col("bin") + 1).alias("bin"), F.col("price").alias("p0"))
    change = binned.join(prior, ["token", "bin"], "left").select(
        "token", "bin", "last", F.when(F.col("p0") > 0, (F.col("price") - F.col("p0")) / F.col("p0")).otherwise(0.0).alias("y"))
    lags = F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")
    # Token side: n, sum y and sum y^2 over bins lag..last.
    ty = change.select("token", "bin", "last", "y", lags).where(F.col("bin") >= F.col("lag")).groupBy("token", "lag").agg(
        (F.first("last") - F.col("lag") + 1).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    vol = bin_trades(trades, prices, minutes).select("token", "wallet", (F.col("bin")).alias("b"), "volume", lags).withColumn("bin", F.col("b") + F.col("lag"))
    tail = span.select("token", F.floor((F.unix_micros("end") - F.unix_micros("start")) / width).alias("last"))
    pairs = vol.join(tail, "token").where(F.col("bin") <= F.col("last")).join(change.select("token", "bin", "y"), ["token", "bin"], "left")
    wx = pairs.groupBy("token", "wallet", "lag").agg(
        F.sum("volume").alias("sx"), F.sum(F.col("volume") * F.col("volume")).alias("sxx"), F.sum(F.col("volume") * F.coalesce("y", F.lit(0.0))).alias("sxy"))
    # A wallet with no bin before the last `lag` ones still has a row, with no correlation.
    every = bin_trades(trades, prices, minutes).select("token", "wallet").distinct().select("token", "wallet", lags)
    j = every.join(wx, ["token", "wallet", "lag"], "left").join(ty, ["token", "lag"])
    n = F.col("n")
    cxy, cxx, cyy = n * F.col("sxy") - F.col("sx") * F.col("sy"), n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    r = F.when((cxx > 0) & (cyy > 0), cxy / F.sqrt(cxx * cyy))
    r2 = F.col("correlation") ** 2
    return j.select("token", "wallet", "lag", n.alias("bins"), r.alias("correlation")).withColumn(
        "f_stat", F.when((r2 < 1.0) & (F.col("bins") > 2), r2 / (1.0 - r2) * (F.col("bins") - 2)))


def best_lead(lags: DataFrame, max_lag: int = 3, f_cut: float = 3.84) -> DataFrame:
    """Strongest lag per wallet and token, where the series is long enough."""
    w = F.struct("f_stat", -F.col("lag"))
    best = lags.where((F.col("bins") + F.col("lag") >= max_lag + 10) & F.col("f_stat").isNotNull()).groupBy("token", "wallet").agg(
        F.max_by("lag", w).alias("optimal_lag"), F.max("f_stat").alias("f_stat"), F.max_by("correlation", w).alias("correlation"))
    lead = F.col("f_stat") > f_cut
    return best.withColumn("has_causality", lead).withColumn("lead_score", F.when(lead, F.col("correlation") ** 2).otherwise(0.0))


