"""Token timelines and the nested token and wallet documents assembled from other operators.

A document's lists are pages: as with the trade list of a report, their length is
a parameter, and each is picked by a row-number limit before anything is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.features import sentiment_label


def max_trades(trades: DataFrame, n: int, keys=("wallet",), order: str = "ts") -> DataFrame:
    """The newest ``n`` trades of each report."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), "trade_id")
    return trades.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def liquidity_timeline(pool_events: DataFrame) -> DataFrame:
    return pool_events.select("token", F.lit("liquidity").alias("timeline"), "ts", F.col("type").alias("label"), F.col("value_usd").alias("amount"), F.lit(None).cast("double").alias("score"))


def mention_timeline(posts: DataFrame) -> DataFrame:
    """Mentions per hour and source with their mean sentiment; ``posts`` has a token."""
    rows = posts.withColumn("s", sentiment_label(F.coalesce("text", F.lit(""))))
    hourly = rows.groupBy("token", "source", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("score"))
    return hourly.select("token", F.lit("mentions").alias("timeline"), F.col("w.start").alias("ts"), F.col("source").alias("label"), F.col("n").cast("double").alias("amount"), "score")


def developer_timeline(transfers: DataFrame, developers: DataFrame) -> DataFrame:
    """Transfers a token's developer sent or received."""
    sent = transfers.join(developers.select("token", F.col("address").alias("src")), ["token", "src"], "left_semi").withColumn("label", F.lit("out"))
    got = transfers.join(developers.select("token", F.col("address").alias("dst")), ["token", "dst"], "left_semi").withColumn("label", F.lit("in"))
    return sent.unionByName(got).select("token", F.lit("dev_transfers").alias("timeline"), "ts", "label", F.col("amount_usd").alias("amount"), F.lit(None).cast("double").alias("score"))


def timelines(*parts: DataFrame) -> DataFrame:
    """Long rows (token, timeline, ts, label, amount, score)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _page(rows: DataFrame, key: str, order: list[Column], fields: list[str], name: str, n: int) -> DataFrame:
    """The first ``n`` rows per key as one array, in order."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name))


def token_score(heatmap: DataFrame, risk: DataFrame, features: DataFrame, times: DataFrame, holders: DataFrame, *, as_of: Column, events: int = 100) -> DataFrame:
    """One document per token: probability heatmap, risk, features, newest timeline entries and top holders."""
    per_h = heatmap.groupBy("token", "horizon").agg(F.map_from_entries(F.collect_list(F.struct("multiplier", "probability"))).alias("m"))  # one entry per multiplier
    heat = per_h.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("horizon", "m"))).alias("probability_heatmap"))
    risk_doc = risk.select("token", F.struct(*[c for c in risk.columns if c != "token"]).alias("risk_score"))
    feature_doc = features.select("token", F.struct(*[c for c in features.columns if c != "token"]).alias("features"))
    out = heat.join(risk_doc, "token", "left").join(feature_doc, "token", "left")
    for kind in ("liquidity", "mentions", "dev_transfers"):
        page = _page(times.where(F.col("timeline") == kind), "token", [F.col("ts").desc(), F.col("label"), F.col("amount")], ["ts", "label", "amount", "score"], kind, events)
        out = out.join(page, "token", "left")
    page = _page(holders, "token", [F.col("rank")], ["address", "balance", "percentage", "is_contract"], "top_holders", 10)
    return out.join(page, "token", "left").withColumn("timelines", F.struct("liquidity", "mentions", "dev_transfers")).drop("liquidity", "mentions", "dev_transfers").withColumn("timestamp", as_of)


def wallet_report(rates: DataFrame, pnl: DataFrame, breakdown: DataFrame, closed: DataFrame, patterns: DataFrame, ranks: DataFrame, related: DataFrame | None = None, unrealized: DataFrame | None = None, *, as_of: Column, trades: int = 100, tokens: int = 100) -> DataFrame:
    """One document per wallet: win rates, realized profit, unrealized profit in total and by token, token breakdown, newest trades, behaviour, relations and ranks."""
    doc = lambda df, name: df.select("wallet", F.struct(*[c for c in df.columns if c != "wallet"]).alias(name))
    out = doc(rates, "win_rate").join(doc(pnl, "realized_pnl"), "wallet", "left").join(doc(ranks, "ranking"), "wallet", "left")
    out = out.join(_page(breakdown, "wallet", [F.col("total_pnl").desc(), F.col("token")], ["token", "total_pnl", "trades", "wins", "win_rate"], "token_breakdown", tokens), "wallet", "left")
    page = _page(max_trades(closed, trades, order="exit_ts"), "wallet", [F.col("exit_ts").desc(), F.col("trade_id")], ["trade_id", "token", "exit_ts", "pnl", "roi"], "trades", trades)
    out = out.join(page, "wallet", "left")
    # At most one entry per named pattern.
    out = out.join(patterns.groupBy("wallet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "confidence")))).alias("behavior")), "wallet", "left")
    if unrealized is not None:
        total = unrealized.groupBy("wallet").agg(F.sum("unrealized_pnl").alias("total"), F.sum("current_value").alias("current_value"), F.count(F.lit(1)).alias("positions"))
        page = _page(unrealized, "wallet", [F.col("current_value").desc(), F.col("token")], ["token", "unrealized_pnl", "current_value", "cost_basis"], "by_token", tokens)
        both = total.join(page, "wallet").select("wallet", F.struct("total", "current_value", "positions", "by_token").alias("unrealized_pnl"))
        out = out.join(both, "wallet", "left")
    if related is not None:
        out = out.join(_page(related, "of_wallet", [F.col("strength").desc(), F.col("wallet")], ["wallet", "relationship_type", "strength"], "related_wallets", 50).withColumnRenamed("of_wallet", "wallet"), "wallet", "left")
    return out.withColumn("timestamp", as_of)
