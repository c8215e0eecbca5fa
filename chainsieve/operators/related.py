"""Wallets related by shared tokens, similar vectors or trading close in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.operators.ordered import ordered_scan, time_slice
from chainsieve.operators.timing import read_as_of


def token_overlap(trades: DataFrame, target: DataFrame, min_overlap: int = 3, shown: int | None = None) -> DataFrame:
    """Wallets that share at least ``min_overlap`` tokens with the target wallet.

    Each (wallet, token) meets the target's token list at most once, so the join
    never forms pairs among the other wallets. ``shown`` limits the listed tokens.
    """
    held = trades.select("wallet", "token").where(F.col("token").isNotNull()).distinct()
    sizes = held.groupBy("wallet").agg(F.count(F.lit(1)).alias("size"))
    mine = held.join(target, "wallet", "left_semi")
    own = mine.agg(F.count(F.lit(1)).alias("own"))  # one row
    shared = held.join(mine.select("token"), "token").join(target, "wallet", "left_anti")
    smallest = shared.groupBy("wallet").agg(F.count(F.lit(1)).alias("overlap_count"))
    out = smallest.where(F.col("overlap_count") >= min_overlap).join(sizes, "wallet").crossJoin(F.broadcast(own))
    top = _first_tokens(shared, shown)
    return out.join(top, "wallet").select(
        "wallet", F.lit("token_overlap").alias("relationship_type"),
        (F.col("overlap_count") / (F.col("size") + F.col("own") - F.col("overlap_count"))).alias("strength"), "overlap_count", "common_tokens")


def _first_tokens(shared: DataFrame, k: int | None) -> DataFrame:
    from pyspark.sql import Window

    if k is not None:
        w = Window.partitionBy("wallet").orderBy("token")
        shared = shared.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return shared.groupBy("wallet").agg(F.array_sort(F.collect_list("token")).alias("common_tokens"))


def _islands(trades: DataFrame, before_s: int, after_s: int) -> DataFrame:
    """Disjoint spans per (token, wallet) covered by its trades widened by the window."""
    pad = trades.select("token", "wallet", "ts", "trade_id", (F.unix_micros("ts") - before_s * 1_000_000).alias("lo"), (F.unix_micros("ts") + after_s * 1_000_000).alias("hi"))
    keys, order = ["token", "wallet"], ["ts", "trade_id"]
    prev = ordered_scan(pad, keys, order, time_slice("ts"), before={"hi_before": F.col("hi")})
    fresh = prev.withColumn("opens", F.when(F.col("lo") > F.coalesce("hi_before", F.lit(-(2**62))), 1).otherwise(0))
    run = ordered_scan(fresh, keys, order, time_slice("ts"), running={"island": ("sum", F.col("opens"))})
    return run.groupBy("token", "wallet", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def temporal_correlation(trades: DataFrame, target: DataFrame, minutes: int = 5, *, only_before: bool = False, min_share: float = 0.1) -> DataFrame:
    """Share of the target's trades that have a same-token trade of another wallet close in time.

    The windows around each other wallet's trades are merged into disjoint spans
    and the target's trades inside a span are counted as a difference of its
    running count at the two ends. Each target trade is counted once per wallet
    and no pair of trades is ever formed. ``only_before`` counts only trades the
    other wallet made first, which is what copying looks like.
    """
    reach = minutes * 60
    mine = trades.join(target, "wallet", "left_semi")
    others = trades.join(target, "wallet", "left_anti")
    spans = _islands(others, 0 if only_before else reach, reach)
    counted = ordered_scan(mine.select("token", "ts", "trade_id"), ["token"], ["ts", "trade_id"], time_slice("ts"), running={"c": ("count", F.lit(1))})
    # One mark per time point, with the count up to and including it.
    marks = counted.groupBy("token", "ts").agg(F.max("c").alias("c"))
    ends = spans.select("token", "wallet", "island", F.explode(F.array(
        F.struct(F.lit("lo").alias("end"), (F.col("lo") - 1).alias("at")), F.struct(F.lit("hi").alias("end"), F.col("hi").alias("at")))).alias("e")
    ).select("token", "wallet", "island", "e.end", F.timestamp_micros("e.at").alias("at"))
    seen = read_as_of(ends, marks, ["token"], ["wallet", "island", "end"], F.col("at"), F.col("ts"), {"c": F.col("c")}, ahead=False, ties=True)
    signed = F.coalesce("c", F.lit(0)) * F.when(F.col("end") == "hi", 1).otherwise(-1)
    total = mine.agg(F.count(F.lit(1)).alias("total_trades"))  # one row
    hits = seen.groupBy("wallet").agg(F.sum(signed).alias("correlated_trades")).crossJoin(F.broadcast(total))
    share = F.col("correlated_trades") / F.col("total_trades")
    return hits.where((F.col("correlated_trades") > 0) & (share > min_share)).select(
        "wallet", F.lit("temporal_correlation").alias("relationship_type"), share.alias("strength"), "correlated_trades", "total_trades")


def copies_wallet(trades: DataFrame, target: DataFrame, minutes: int = 5) -> DataFrame:
    """The wallet the target most often trades right after."""
    led = temporal_correlation(trades, target, minutes, only_before=True, min_share=0.0)
    return led.orderBy(F.col("correlated_trades").desc(), "wallet").limit(1).select(F.col("wallet").alias("copies_wallet"), "correlated_trades")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)


def pattern_similarity(vectors: DataFrame, target: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Entities whose vector is close to the target's; the target is one row and is sent to every task. More rows are refused."""
    one = F.broadcast(target.agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pattern_similarity takes one target"))).otherwise(F.min(F.struct("entity", "vector"))).alias("t")
    ).select(F.col("t.entity").alias("t_entity"), F.col("t.vector").alias("t_vector")))
    rows = vectors.crossJoin(one).where(F.col("entity") != F.col("t_entity"))
    return rows.withColumn("strength", cosine(F.col("vector"), F.col("t_vector"))).where(F.col("strength") >= threshold).select(
        F.col("entity").alias("wallet"), F.lit("pattern_similarity").alias("relationship_type"), "strength")


def nearest_snapshot(vectors: DataFrame, target: DataFrame, now: Column, ttl_seconds: int, threshold: float = 0.95) -> DataFrame:
    """Closest stored vector that has not expired; ``vectors`` carries ``stored_ts``."""
    live = vectors.where(F.unix_micros("stored_ts") + ttl_seconds * 1_000_000 > F.unix_micros(now))
    near = pattern_similarity(live, target, threshold)
    return near.agg(F.max_by("wallet", F.struct("strength", -F.col("wallet"))).alias("wallet"), F.max("strength").alias("strength"))


def related_wallets(flow: DataFrame, pattern: DataFrame, overlap: DataFrame, temporal: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Strongest relationship per wallet over the four kinds; equal strengths keep this order."""
    parts = [
        df.select("wallet", F.lit(kind).alias("relationship_type"), "strength", F.lit(-place).alias("place"))
        for place, (kind, df) in enumerate([("fund_transfer", flow), ("pattern_similarity", pattern), ("token_overlap", overlap), ("temporal_correlation", temporal)])
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    best = both.groupBy("wallet").agg(F.max_by("relationship_type", F.struct("strength", "place")).alias("relationship_type"), F.max("strength").alias("strength"))
    return best.where(F.col("strength") >= threshold)


def behavior_embedding(trades: DataFrame, keys=("wallet",), size: int = 64) -> DataFrame:
    """Buy share, sell share, ln(1 + mean usd) and trade count, padded with zeros."""
    buys = F.avg((F.col("side") == "buy").cast("double"))
    mean = F.avg("amount_usd")
    head = F.array(F.col("b"), 1.0 - F.col("b"), F.log1p("m"), F.col("n"))
    return trades.groupBy(*keys).agg(buys.alias("b"), mean.alias("m"), F.count(F.lit(1)).cast("double").alias("n")).select(
        *keys, F.concat(head, F.array_repeat(F.lit(0.0), size - 4)).alias("vector"))


def trade_sequence(trades: DataFrame, keys=("wallet",), length: int | None = None) -> DataFrame:
    """Trades as (side, ln(1 + usd), price, position) rows, the first ``length`` of each key where a format has a length."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ts", "trade_id")
    n = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = trades.withColumn("i", F.row_number().over(w))
    if length is not None:
        first = first.where(F.col("i") <= length)
    return first.join(n, list(keys)).select(
        *keys, F.col("i").alias("step"), F.when(F.col("side") == "buy", 1.0).otherwise(-1.0).alias("direction"),
        F.log1p("amount_usd").alias("size"), "price", ((F.col("i") - 1) / F.col("n")).alias("position"))
