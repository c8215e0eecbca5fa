"""Smart-wallet finder over all tokens in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.functions import scoring
from chainsieve.operators.graph import graph_signals
from chainsieve.operators.matching import fifo_match, min_trade_size, wallet_volumes
from chainsieve.operators.timing import timing_signals
from chainsieve.operators.wallet import behavioral_counts, profitability_signals, with_pattern_tags

KEYS = ["token", "wallet"]
NO_GRAPH = {"centrality_score": 0.0, "clustering_coefficient": 0.0, "common_funding_sources": 0, "connected_smart_wallets": 0, "total_connections": 0}


def wallet_signals(
    trades: DataFrame, prices: DataFrame, edges: DataFrame | None, known: DataFrame | None,
    *, match: Callable[[DataFrame], DataFrame] = fifo_match, timing: Callable[[DataFrame, DataFrame], DataFrame] = timing_signals,
) -> DataFrame:
    """Timing (all trades), profitability (closed trades), behaviour and graph signals per token and wallet.

    Stages are parameters, so any of them can be replaced. Only wallets with a
    closed trade in the token are kept.
    """
    closed = match(trades)
    # The holding time comes out of the same aggregation as profitability, so matching is not repeated for it.
    out = with_pattern_tags(
        profitability_signals(closed, with_hold=True)
        .join(behavioral_counts(trades), KEYS)
        .join(timing(trades, prices), KEYS)
    )
    if edges is not None:
        out = out.join(graph_signals(edges, known), "wallet", "left").fillna(NO_GRAPH)
    else:
        for name, value in NO_GRAPH.items():
            out = out.withColumn(name, F.lit(value))
    return out


def score_wallets(signals: DataFrame, weights: Mapping[str, float] = scoring.CATEGORY_WEIGHTS) -> DataFrame:
    return signals.withColumn("risk_score", scoring.risk_score()).withColumn("smart_money_score", scoring.smart_money_score(weights))


def top_wallets(scored: DataFrame, min_confidence: float = 0.5, top_k: int = 100) -> DataFrame:
    """Best k per token; the row-number limit is applied before the shuffle too."""
    w = Window.partitionBy("token").orderBy(F.col("smart_money_score").desc(), "wallet")
    return scored.where(F.col("smart_money_score") >= min_confidence).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def explain(ranked: DataFrame) -> DataFrame:
    score = F.col("smart_money_score")
    return (
        ranked.withColumn("top_signals", scoring.top_signals())
        .withColumn("summary", scoring.summary_text(F.col("wallet"), score, F.col("top_signals")))
        .withColumn("interpretation", scoring.interpretation(score))
        .withColumn("timeline", scoring.timeline_events())
        .withColumn("confidence_level", scoring.confidence_level(score))
    )


def key_metrics(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "win_rate", F.col("avg_roi").alias("realized_roi"), F.col("total_trades").alias("trades_count"),
                     F.col("pre_pump_entry_rate").alias("early_entry_rate"), F.col("centrality_score").alias("graph_centrality"))


def selected_trades(
    trades: DataFrame, *, token=None, chain: str | None = None, as_of: Column | None = None, window_days: float | None = None,
    min_trade_size_usd: float = 0.0, min_holdings_usd: float = 0.0,
) -> DataFrame:
    """The trades that a search looks at; plain filters reach the scan, and small trades go before holdings are summed."""
    if token is not None:
        trades = trades.where(F.col("token") == token)
    if chain is not None:
        trades = trades.where(F.col("chain") == chain)
    if window_days is not None:
        if as_of is None:
            raise ValueError("window_days needs as_of")
        start = F.timestamp_micros(F.unix_micros(as_of) - F.lit(int(window_days * 86_400_000_000)))
        trades = trades.where((F.col("ts") >= start) & (F.col("ts") <= as_of))
    trades = min_trade_size(trades, min_trade_size_usd)
    if min_holdings_usd:
        trades = trades.join(wallet_volumes(trades, tuple(KEYS), min_holdings_usd).select(*KEYS), KEYS, "left_semi")
    return trades


def find_smart_wallets(
    trades: DataFrame, prices: DataFrame, edges: DataFrame, known: DataFrame, *, min_confidence: float = 0.5, top_k: int = 100,
    max_risk: float = scoring.MAX_RISK, weights: Mapping[str, float] = scoring.CATEGORY_WEIGHTS, **filters,
) -> DataFrame:
    """Ranked and explained wallets per token; ``filters`` are those of ``selected_trades``."""
    trades = selected_trades(trades, **filters)
    scored = score_wallets(wallet_signals(trades, prices, edges, known), weights)
    return explain(top_wallets(scored.where(F.col("risk_score") < max_risk), min_confidence, top_k))


def wallet_profile(trades: DataFrame, prices: DataFrame, wallet=None, token=None) -> DataFrame:
    """Signals, score and explanation per token without the graph, for one wallet or all; filters reach the scan."""
    mine = trades if wallet is None else trades.where(F.col("wallet") == wallet)
    if token is not None:
        mine = mine.where(F.col("token") == token)
    return explain(score_wallets(wallet_signals(mine, prices, None, None)))


def funnel_counts(signals: DataFrame, max_risk: float = scoring.MAX_RISK, min_confidence: float = 0.5, top_k: int = 100) -> DataFrame:
    scored = score_wallets(signals)
    passing = F.col("risk_score") < max_risk
    sure = passing & (F.col("smart_money_score") >= min_confidence)
    return scored.groupBy("token").agg(
        F.count(F.lit(1)).alias("analyzed"), F.count_if(passing).alias("passing"),
        F.least(F.count_if(sure), F.lit(top_k)).alias("returned"))


def ranking_summary(ranked: DataFrame) -> DataFrame:
    """Mean, upper median and mean win rate per token over the k ranked wallets."""
    n = Window.partitionBy("token")
    rows = ranked.withColumn("n", F.count(F.lit(1)).over(n))
    # Position n div 2 in ascending order is position n - n div 2 from the top.
    mid = F.col("rank") == F.col("n") - F.floor(F.col("n") / 2)
    return rows.groupBy("token").agg(
        F.avg("smart_money_score").alias("avg_smart_money_score"), F.max(F.when(mid, F.col("smart_money_score"))).alias("median_smart_money_score"),
        F.avg("win_rate").alias("avg_win_rate"), F.count(F.lit(1)).alias("total_smart_wallets"))


def bulk_leaderboard(ranked: DataFrame, limit: int = 100) -> DataFrame:
    """Best score per wallet over all tokens, re-ranked; the input holds at most k rows per token."""
    best = ranked.groupBy("wallet").agg(F.max("smart_money_score").alias("smart_money_score"), F.max_by("token", F.struct("smart_money_score", -F.col("token"))).alias("best_token"))
    top = best.orderBy(F.col("smart_money_score").desc(), "wallet").limit(limit)
    w = Window.orderBy(F.col("smart_money_score").desc(), "wallet")  # over at most `limit` rows
    return top.withColumn("rank", F.row_number().over(w))
