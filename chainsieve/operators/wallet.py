"""Per-wallet aggregates: win rates, profit and loss, performance, breakdowns, behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.ordered import ordered_scan, rank_desc, time_slice, with_median
from chainsieve.tables import money

DAY = 86400.0


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(default)


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1.0e6


def open_positions(trades: DataFrame) -> DataFrame:
    buy = F.col("side") == "buy"
    return (
        trades.groupBy("wallet", "token")
        .agg(
            F.sum(F.when(buy, F.col("amount_tokens")).otherwise(-F.col("amount_tokens"))).alias("amount"),
            F.sum(F.when(buy, money("amount_usd")).otherwise(0)).cast("double").alias("spent"),
            F.sum(F.when(buy, F.col("amount_tokens")).otherwise(0.0)).alias("bought"),
        )
        .where(F.col("amount") > 0)
        .select("wallet", "token", "amount", (F.col("spent") / F.col("bought")).alias("avg_buy_price"))
    )


def timeframe_filter(trades: DataFrame, ts: str, timeframe: str, as_of: Column) -> DataFrame:
    """``Nd`` keeps the last N days before ``as_of``; ``all`` keeps everything."""
    if timeframe == "all":
        return trades
    return trades.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(timeframe[:-1])} DAYS"))


def win_rates(closed: DataFrame, as_of: Column, timeframes=("1d", "7d", "30d", "all"), keys=("wallet",)) -> DataFrame:
    """All timeframes in one pass of conditional counts."""
    aggs = []
    for tf in timeframes:
        inside = F.lit(True) if tf == "all" else F.col("exit_ts") >= as_of - F.expr(f"INTERVAL {int(tf[:-1])} DAYS")
        aggs += [
            F.count_if(inside).alias(f"total_{tf}"),
            F.count_if(inside & (F.col("pnl") > 0)).alias(f"wins_{tf}"),
        ]
    out = closed.groupBy(*keys).agg(*aggs)
    return out.select("*", *[ratio(F.col(f"wins_{tf}"), F.col(f"total_{tf}")).alias(f"win_rate_{tf}") for tf in timeframes])


def realized_pnl(closed: DataFrame, keys=("wallet",)) -> DataFrame:
    return closed.groupBy(*keys).agg(
        F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"), F.max("pnl").alias("best_trade"), F.min("pnl").alias("worst_trade"),
        F.sum("cost_basis_usd").alias("buy_volume"), F.sum("sell_value_usd").alias("sell_volume"),
        F.count(F.lit(1)).alias("trades"),
    )


def current_prices(prices: DataFrame) -> DataFrame:
    return prices.groupBy("token").agg(F.max_by("price", F.struct("ts", "price")).alias("current_price"))


def unrealized_pnl(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """Per open position; a token without a price is valued at its buy price."""
    now = F.coalesce(F.col("current_price"), F.col("avg_buy_price"))
    return positions.join(latest, "token", "left").select(
        "wallet", "token",
        ((now - F.col("avg_buy_price")) * F.col("amount")).alias("unrealized_pnl"),
        (now * F.col("amount")).alias("current_value"),
        (F.col("avg_buy_price") * F.col("amount")).alias("cost_basis"),
    )


def max_drawdown(rows: DataFrame, keys: list[str], order: list[str], slices: Column, value: str, name: str = "max_drawdown") -> DataFrame:
    """Deepest fall of cumulative ``value`` from its running peak, over ``max(final peak, 1)``."""
    cum = ordered_scan(rows, keys, order, slices, running={"__cum": ("sum", F.col(value))})
    peak = ordered_scan(cum, keys, order, slices, running={"__peak": ("max", F.col("__cum"))})
    return peak.groupBy(*keys).agg(
        (F.max(F.col("__peak") - F.col("__cum")) / F.greatest(F.max("__peak"), F.lit(1.0))).alias(name))


def performance_metrics(closed: DataFrame, keys=("wallet",)) -> DataFrame:
    ks = list(keys)
    n, mean, sd = F.col("n"), F.col("mean"), F.col("sd")
    base = closed.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("mean"), F.stddev_pop("pnl").alias("sd"),
        F.avg(seconds_between(F.col("entry_ts"), F.col("exit_ts")) / 3600.0).alias("hold"),
        F.min("exit_ts").alias("first_ts"), F.max("exit_ts").alias("last_ts"),
    )
    dd = max_drawdown(closed, ks, ["exit_ts", "trade_id"], time_slice("exit_ts"), "pnl")
    days = F.greatest(F.floor(seconds_between(F.col("first_ts"), F.col("last_ts")) / DAY), F.lit(1))
    many = n >= 2
    return base.join(dd, ks).select(
        *ks,
        F.when(many & (sd > 1e-12), mean / sd * F.sqrt(F.lit(365.0))).otherwise(0.0).alias("sharpe_ratio"),
        F.when(many, F.col("max_drawdown")).otherwise(0.0).alias("max_drawdown"),
        F.when(many, F.col("hold")).otherwise(0.0).alias("avg_hold_time_hours"),
        F.when(many, n / days).otherwise(0.0).alias("trade_frequency_per_day"),
    )


def breakdown(closed: DataFrame, by: str, keys=("wallet",), fill: str | None = None) -> DataFrame:
    """Profit per token or chain; null groups are dropped, or named ``fill``."""
    col = F.coalesce(F.col(by), F.lit(fill)) if fill else F.col(by)
    rows = closed.withColumn(by, col).where(F.col(by).isNotNull())
    return rows.groupBy(*keys, by).agg(
        F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"),
    ).withColumn("win_rate", F.col("wins") / F.col("trades"))


def token_and_chain_breakdown(closed: DataFrame) -> DataFrame:
    """Both breakdowns from one scan and one shuffle."""
    rows = closed.select(
        "wallet", "pnl",
        F.explode(F.array(
            F.struct(F.lit("token").alias("kind"), F.col("token").cast("string").alias("item")),
            F.struct(F.lit("chain").alias("kind"), F.coalesce("chain", F.lit("unknown")).alias("item")),
        )).alias("g"),
    ).where(F.col("g.item").isNotNull())
    return rows.groupBy("wallet", F.col("g.kind").alias("kind"), F.col("g.item").alias("item")).agg(
        F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"),
    ).withColumn("win_rate", F.col("wins") / F.col("trades"))


def report_token_breakdown(closed: DataFrame) -> DataFrame:
    return closed.groupBy("wallet", "token", "chain").agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.sum("pnl").alias("total_pnl_usd"), F.avg("roi").alias("average_roi"),
        F.sum(F.col("cost_basis_usd") + F.col("sell_value_usd")).alias("volume_usd"),
        F.min("entry_ts").alias("first_trade"), F.max("exit_ts").alias("last_trade"),
    )


def wallet_metrics(closed: DataFrame, per_chain: bool = True) -> DataFrame:
    """One row per wallet and chain, or per wallet over all its chains: the input of rankings and searches."""
    return closed.groupBy("wallet", *["chain"] * per_chain).agg(
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("pnl").alias("pnl"),
        ratio(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe_ratio"), F.count(F.lit(1)).alias("trades"),
    )


def chain_statistics(metrics: DataFrame) -> DataFrame:
    base = metrics.groupBy("chain").agg(
        F.count(F.lit(1)).alias("total_wallets"), F.avg("win_rate").alias("avg_win_rate"),
        F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"), F.sum("trades").alias("total_trades"),
    )
    base = with_median(base, metrics, ["chain"], "win_rate", "median_win_rate")
    return with_median(base, metrics, ["chain"], "pnl", "median_pnl")


def trading_features(closed: DataFrame, keys=("wallet",)) -> DataFrame:
    days = F.floor(seconds_between(F.min("exit_ts"), F.max("exit_ts")) / DAY)
    return closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg(seconds_between(F.col("entry_ts"), F.col("exit_ts")) / 3600.0).alias("avg_hold_time_hours"),
        (F.count(F.lit(1)) / F.when(days == 0, 1).otherwise(days)).alias("trade_frequency_per_day"),
    )


def pnl_features(closed: DataFrame, keys=("wallet",)) -> DataFrame:
    sd = F.stddev_pop("pnl")
    return closed.groupBy(*keys).agg(
        F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl_per_trade"), F.max("pnl").alias("best_trade"),
        F.min("pnl").alias("worst_trade"), sd.alias("pnl_std"),
        F.when((F.count(F.lit(1)) > 1) & (sd > 1e-12), F.avg("pnl") / sd).otherwise(0.0).alias("sharpe_ratio"),
    )


def profitability_signals(closed: DataFrame, keys=("token", "wallet"), with_hold: bool = False) -> DataFrame:
    ks, sd = list(keys), F.stddev_pop("roi")
    base = closed.groupBy(*ks).agg(
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("roi").alias("avg_roi"),
        F.count(F.lit(1)).alias("total_trades"), F.count_if(F.col("pnl") > 0).alias("profitable_trades"),
        F.avg(seconds_between(F.col("entry_ts"), F.col("exit_ts")) / 3600.0).alias("avg_holding_duration_hours"),
        F.when((F.count(F.lit(1)) >= 2) & (sd > 1e-12), F.avg("roi") / sd).otherwise(0.0).alias("sharpe_ratio"),
        F.max("roi").alias("best_roi"), F.min("roi").alias("worst_roi"),
        *([F.avg("holding_hours").alias("avg_hold_hours")] if with_hold else []),
    )
    return with_median(base, closed, ks, "roi", "median_roi")


def preferred_hours(trades: DataFrame, keys=("wallet",), k: int = 3) -> DataFrame:
    """The k busiest UTC hours, equal counts by the smaller hour. At most 24 rows per key."""
    per_hour = trades.groupBy(*keys, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "hour")
    return (
        per_hour.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "hour"))).alias("h"))
        .select(*keys, F.transform("h", lambda x: x["hour"]).alias("preferred_hours"))
    )


def behavioral_counts(trades: DataFrame, keys=("token", "wallet")) -> DataFrame:
    """Frequency, venues and gas regularity, with the counts the pattern tags need."""
    gas_mean, gas_sd = F.avg("gas_price"), F.stddev_pop("gas_price")
    n = F.count(F.lit(1))
    days = seconds_between(F.min("ts"), F.max("ts")) / DAY
    return trades.groupBy(*keys).agg(
        n.alias("n"),
        F.when((n >= 2) & (days > 0), n / days).otherwise(0.0).alias("trade_frequency_per_day"),
        F.count_distinct(F.coalesce("dex", F.lit("unknown"))).alias("dex_diversity"),
        F.when((F.count("gas_price") >= 2) & (gas_mean != 0), F.greatest(F.lit(0.0), 1.0 - F.least(gas_sd / gas_mean, F.lit(1.0))))
        .otherwise(0.0).alias("gas_pattern_consistency"),
        F.count_if(F.coalesce("token_age_hours", F.lit(999.0)) < 24).alias("early"),
        *([] if "token" in keys else [F.count_distinct("token").alias("unique_tokens_traded")]),
    )


def with_pattern_tags(counts: DataFrame) -> DataFrame:
    """Tags from behavioural counts and ``avg_hold_hours``; a missing holding time sets no holding tag."""
    hold = F.coalesce("avg_hold_hours", F.lit(0.0))
    tags = F.array_compact(F.array(
        F.when(F.col("early") / F.col("n") > 0.5, F.lit("early_adopter")),
        F.when(hold > 168, F.lit("diamond_hands")),
        F.when((hold > 1) & (hold < 168), F.lit("swing_trader")),
        F.when(F.col("trade_frequency_per_day") > 10, F.lit("high_frequency")),
    ))
    return counts.withColumn("pattern_tags", tags).drop("n", "early", "avg_hold_hours")


def behavioral_signals(trades: DataFrame, holding: DataFrame | None = None, keys=("token", "wallet")) -> DataFrame:
    """Frequency, venues, gas regularity and pattern tags.

    ``holding`` supplies ``avg_hold_hours`` per key; without it the tags that
    need a holding time stay off, as with trades that carry none.
    """
    out = behavioral_counts(trades, keys)
    out = out.withColumn("avg_hold_hours", F.lit(0.0)) if holding is None else out.join(holding, list(keys), "left")
    return with_pattern_tags(out)


def alternation_wash_score(trades: DataFrame) -> DataFrame:
    """Share of a wallet's tokens whose trades flip side more than 70 % of the time."""
    steps = ordered_scan(trades.select("wallet", "token", "ts", "trade_id", "side"), ["wallet", "token"], ["ts", "trade_id"],
                         time_slice("ts"), before={"side_before": F.col("side")})
    per_token = steps.groupBy("wallet", "token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") != F.col("side_before")).alias("flips"))
    eligible = F.col("n") >= 4
    return per_token.groupBy("wallet").agg(
        F.sum("n").alias("n"), F.count_if(eligible).alias("tokens"),
        F.count_if(eligible & (F.col("flips") / F.greatest(F.col("n") - 1, F.lit(1)) > 0.7)).alias("circular"),
    ).select("wallet", F.when(F.col("n") >= 5, ratio(F.col("circular"), F.col("tokens"))).otherwise(0.0).alias("wash_score"))


def timing_regularity(trades: DataFrame, keys=("wallet",)) -> DataFrame:
    ks = list(keys)
    gaps = ordered_scan(trades.select(*ks, "ts", "trade_id"), ks, ["ts", "trade_id"], time_slice("ts"), before={"prev_ts": F.col("ts")})
    gap = seconds_between(F.col("prev_ts"), F.col("ts"))
    cv = ratio(F.stddev_pop("gap"), F.avg("gap"))
    score = (F.greatest(F.lit(0.0), 1.0 - cv * 2.0) + F.avg((F.col("gap") < 5).cast("double"))) / 2.0
    return gaps.withColumn("gap", gap).groupBy(*ks).agg(F.when(F.count("gap") > 5, score).otherwise(0.0).alias("timing_score"))


def sandwich_score(trades: DataFrame, keys=("wallet",)) -> DataFrame:
    """A-B-A side triples that finish within 30 seconds."""
    from chainsieve.operators.ordered import neighbours

    ks = list(keys)
    ahead = neighbours(trades.select(*ks, "ts", "trade_id", "side"), ks, ["ts", "trade_id"], time_slice("ts"),
                       F.struct("side", "ts"), 2, "ahead", ahead=True)
    one, two = F.get("ahead", F.lit(0)), F.get("ahead", F.lit(1))
    hit = (F.col("side") != one["side"]) & (F.col("side") == two["side"]) & (seconds_between(F.col("ts"), two["ts"]) < 30)
    n = F.count(F.lit(1))
    return ahead.groupBy(*ks).agg(
        F.least(F.count_if(hit) / F.greatest(F.floor(n / 3), F.lit(1)), F.lit(1.0)).alias("sandwich_score"))


def behavior_patterns(closed: DataFrame, trades: DataFrame, listings: DataFrame, wash: DataFrame) -> DataFrame:
    """(wallet, pattern, confidence) for every pattern that fires.

    Holding patterns, profit taking and loss cutting read closed trades; entry
    patterns read all trades.
    """
    hold_s = seconds_between(F.col("entry_ts"), F.col("exit_ts"))
    days, hours = F.floor(hold_s / DAY), hold_s / 3600.0
    n, wins, losses = F.count(F.lit(1)), F.count_if(F.col("pnl") > 0), F.count_if(F.col("pnl") < 0)
    share = lambda cond: F.avg(cond.cast("double"))
    quick = (F.col("pnl") < 0) & (hours <= 24) & (F.abs("pnl") < 0.2 * F.col("cost_basis_usd"))
    wr = wins / n
    closed_side = closed.groupBy("wallet").agg(
        share(days >= 30).alias("diamond_hands"), share((days >= 1) & (days <= 14)).alias("swing_trader"),
        share(hours <= 24).alias("day_trader"),
        F.when(wr < 0.6, 0.0).otherwise(F.least(F.lit(1.0), (wr - 0.6) / 0.4)).alias("smart_money"),
        wr.alias("profit_taker"), ratio(F.count_if(quick), losses).alias("loss_cutter"),
    )
    age_h = seconds_between(F.col("listed_ts"), F.col("ts")) / 3600.0
    entry_side = trades.join(listings, "token", "left").groupBy("wallet").agg(
        ratio(F.count_if(age_h <= 24), F.count("listed_ts")).alias("early_adopter"),
        *([F.avg(((F.col("side") == "buy") & (F.col("price_change_5m") > 0.1)).cast("double")).alias("pump_chaser")]
          if "price_change_5m" in trades.columns else []),
    )
    washed = wash.select("wallet", F.when(F.col("wash_score") > 0.3, F.col("wash_score")).otherwise(0.0).alias("wash_trader"))
    wide = entry_side.join(closed_side, "wallet", "left").join(washed, "wallet", "left")
    names = [c for c in wide.columns if c != "wallet"]
    return (
        wide.select("wallet", F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(p).alias("confidence")) for p in names])).alias("p"))
        .select("wallet", "p.*").where(F.col("confidence") > 0)
    )


def price_change_5m(trades: DataFrame) -> DataFrame:
    """Relative move of the token price over the five minutes before each trade."""
    probes = trades.select("token", "ts", "trade_id", F.lit(1).alias("kind"), F.col("price").alias("p"), (F.col("ts") - F.expr("INTERVAL 5 MINUTES")).alias("at"))
    marks = trades.select("token", "ts", "trade_id", F.lit(0).alias("kind"), F.col("price").alias("p"), F.col("ts").alias("at"))
    both = probes.unionByName(marks)
    seen = ordered_scan(both, ["token"], ["at", "kind", "trade_id"], time_slice("at"),
                        last={"p_before": F.when(F.col("kind") == 0, F.col("p"))}).where(F.col("kind") == 1)
    change = seen.select("trade_id", F.when(F.col("p_before") > 0, F.col("p") / F.col("p_before") - 1).otherwise(0.0).alias("price_change_5m"))
    return trades.join(change, "trade_id", "left").withColumn("price_change_5m", F.coalesce("price_change_5m", F.lit(0.0)))


def rank_wallets(metrics: DataFrame, metric: str = "win_rate", per_chain: bool = False, min_trades: int = 0, limit: int | None = None) -> DataFrame:
    """Rank, total and percentile over all wallets or within a chain."""
    if metric not in ("win_rate", "pnl", "sharpe_ratio", "trades"):
        metric = "win_rate"
    rows = metrics.where(F.col("trades") >= min_trades)
    ranked = rank_desc(rows, ["chain"] if per_chain else [], metric, "wallet", "rank", total="total")
    pct = (F.col("total") - F.col("rank") + 1) / F.col("total") * 100.0
    out = ranked.withColumn("percentile", pct)
    return out.where(F.col("rank") <= limit) if limit else out


def search_wallets(metrics: DataFrame, *, min_win_rate=None, min_trades=None, min_pnl=None, chain=None,
                   sort_by: str = "win_rate", order: str = "desc", limit: int = 100, offset: int = 0) -> DataFrame:
    """Filtered, sorted page of wallets; a top-k report, so the page size is its meaning."""
    if not 0 < limit <= 1000:
        raise ValueError("a page has 1 to 1000 wallets")
    rows = metrics
    if min_win_rate is not None:
        rows = rows.where(F.col("win_rate") >= min_win_rate)
    if min_trades is not None:
        rows = rows.where(F.col("trades") >= min_trades)
    if min_pnl is not None:
        rows = rows.where(F.col("pnl") >= min_pnl)
    if chain is not None:
        rows = rows.where(F.col("chain") == chain)
    key = F.col(sort_by).desc() if order == "desc" else F.col(sort_by).asc()
    return rows.orderBy(key, "wallet").offset(offset).limit(limit)


