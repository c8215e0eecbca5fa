"""Contract, report, aggregate and composite risk; flags and feature explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.operators.wallet import alternation_wash_score, sandwich_score, timing_regularity

# Flag column, value that raises it, flag name and points.
CONTRACT_RULES = (
    ("is_honeypot", "honeypot", 40),
    ("is_open_source", "not_open_source", 10),
    ("is_proxy", "proxy_contract", 15),
    ("is_mintable", "mintable", 20),
    ("can_take_back_ownership", "can_take_back_ownership", 25),
    ("owner_change_balance", "owner_can_change_balance", 30),
    ("hidden_owner", "hidden_owner", 20),
    ("selfdestruct", "selfdestruct", 35),
)
# Component weights and untrained defaults of the composite score.
COMPONENT_WEIGHTS = {"rug_risk": 0.30, "dev_risk": 0.25, "distribution_risk": 0.20, "social_risk": 0.15, "liquidity_risk": 0.10}
UNTRAINED = {"rug_risk": 30.0, "dev_risk": 50.0, "distribution_risk": 45.0, "social_risk": 35.0, "liquidity_risk": 40.0}
EVM_SOURCES = ("ethereum", "bsc", "polygon", "avalanche", "arbitrum")
BASE_RATES = {"2x": 0.35, "5x": 0.15, "10x": 0.05, "20x": 0.02, "50x": 0.005}
HORIZON_FACTORS = {"24h": 1.0, "7d": 1.5, "30d": 2.0}


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("minimal")


def _raised(name: str) -> Column:
    # Source code counts as closed unless it is stated to be open.
    return F.coalesce(F.col(name), F.lit("")) != "1" if name == "is_open_source" else F.coalesce(F.col(name), F.lit("")) == "1"


def contract_risk(flags: DataFrame) -> DataFrame:
    raw = reduce(lambda a, b: a + b, [F.when(_raised(c), p).otherwise(0) for c, _, p in CONTRACT_RULES])
    names = F.array_compact(F.array(*[F.when(_raised(c), F.lit(n)) for c, n, _ in CONTRACT_RULES]))
    return flags.withColumn("raw", raw).select(
        *[c for c in flags.columns if c not in {r[0] for r in CONTRACT_RULES}],
        F.least(F.lit(100), "raw").alias("risk_score"), risk_level(F.col("raw")).alias("risk_level"), names.alias("flags"))


def report_risk(tokens: DataFrame, reports: DataFrame) -> DataFrame:
    """Report score and flags; a token without a report is neutral."""
    return tokens.join(reports.withColumn("has", F.lit(True)), "token", "left").select(
        *tokens.columns, F.coalesce("score", F.lit(50)).alias("risk_score"), F.coalesce("report_level", F.lit("unknown")).alias("risk_level"),
        F.when(F.col("has").isNull(), F.array(F.lit("no_data"))).otherwise(F.coalesce("report_flags", F.array().cast("array<string>"))).alias("flags"))


def aggregate_risk(tokens: DataFrame, contract: DataFrame, reports: DataFrame) -> DataFrame:
    """Mean of the sources that apply to the chain and have a non-zero score; 50 when none.

    EVM tokens read the flag feed and Solana tokens the report feed; a token
    missing from its feed scores a neutral 50 with the flag ``no_data``.
    """
    none = F.array(F.lit("no_data"))
    feed = contract.select("token", F.col("risk_score").alias("s"), F.col("flags").alias("f"))
    evm = tokens.where(F.col("chain").isin(*EVM_SOURCES)).join(feed, "token", "left").select("token", "chain", F.coalesce("s", F.lit(50)).alias("s"), F.coalesce("f", none).alias("f"))
    sol = report_risk(tokens.where(F.col("chain") == "solana"), reports).select("token", "chain", F.col("risk_score").alias("s"), F.col("flags").alias("f"))
    scored = evm.unionByName(sol).where(F.col("s") != 0)
    # At most a handful of sources per token, each with a fixed list of flags.
    per = scored.groupBy("token", "chain").agg(F.avg("s").alias("avg_s"), F.count(F.lit(1)).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("flags"))
    score = F.coalesce("avg_s", F.lit(50.0))
    return tokens.join(per, ["token", "chain"], "left").select(
        "token", "chain", score.alias("aggregate_risk_score"), risk_level(score).alias("risk_level"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("sources", F.lit(0)).alias("sources_checked"))


def composite_risk(df: DataFrame, trained: bool = True) -> DataFrame:
    """Clip components to 0-100, fill the absent with 50, and weight them; fixed scores without models."""
    part = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(50.0)))) if trained else F.lit(UNTRAINED[c])
    out = df.select(*[c for c in df.columns if c not in COMPONENT_WEIGHTS], *[part(c).alias(c) for c in COMPONENT_WEIGHTS])
    return out.withColumn("composite_score", reduce(lambda a, b: a + b, [F.col(c) * w for c, w in COMPONENT_WEIGHTS.items()]))


def risk_flags() -> Column:
    """Flag texts from component scores and features."""
    c = F.col
    rug, dev, dist, soc, liq = c("rug_risk") > 70, c("dev_risk") > 60, c("distribution_risk") > 70, c("social_risk") > 65, c("liquidity_risk") > 60
    off = lambda name: ~F.coalesce(c(name), F.lit(False))
    num = lambda name: F.coalesce(c(name), F.lit(0.0))
    # Flag wording and thresholds.
    rules = (
        (rug, "High Contract Risk"), (rug & off("liquidity_locked"), "LP Not Locked"), (rug & off("ownership_renounced"), "Ownership Not Renounced"),
        (dev & (num("dev_holding_pct") > 0.20), "High Dev Holding"), (dev & F.coalesce(c("dev_recent_sell"), F.lit(False)), "Recent Dev Sell"),
        (dist & (num("holder_gini") > 0.80), "Highly Concentrated Holdings"), (dist & (num("top10_concentration") > 0.70), "Top 10 Hold >70%"),
        (soc & (num("bot_score") > 0.50), "High Bot Activity"), (soc & (num("duplicate_ratio") > 0.40), "Suspicious Social Patterns"),
        (liq & (num("liquidity_usd") < 10000), "Low Liquidity (<$10k)"), (liq & (num("liquidity_depth_5pct") < 5000), "Poor Liquidity Depth"),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))


def base_rate_heatmap(keys: DataFrame) -> DataFrame:
    """Untrained probabilities per row, horizon and multiplier: base rate over horizon factor."""
    cells = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("multiplier"), F.lit(b / f).alias("probability"))
        for h, f in HORIZON_FACTORS.items() for m, b in BASE_RATES.items()])
    return keys.select("*", F.explode(cells).alias("c")).select(*keys.columns, "c.*")


def heatmap_filter(heatmap: DataFrame, horizons: list[str]) -> DataFrame:
    return heatmap.where(F.col("horizon").isin(*horizons))


def bot_score(trades: DataFrame, social: DataFrame | None = None) -> DataFrame:
    """0.3 timing + 0.3 sandwich + 0.2 wash + 0.2 social, at most 1."""
    out = timing_regularity(trades).join(sandwich_score(trades), "wallet").join(alternation_wash_score(trades), "wallet")
    s = F.lit(0.0)
    if social is not None:
        out, s = out.join(social, "wallet", "left"), F.coalesce("social_bot_score", F.lit(0.0))
    return out.select("wallet", F.least(F.lit(1.0), 0.3 * F.col("timing_score") + 0.3 * F.col("sandwich_score") + 0.2 * F.col("wash_score") + 0.2 * s).alias("bot_score"))


def feature_text(name: Column, value: Column, contribution: Column) -> Column:
    """Templated description of one feature's part in a score."""
    word = F.when(contribution > 0, "increases").otherwise("decreases")
    low = F.lower(name)
    whole = F.format_number(value, 0)
    two = F.format_string("%.2f", F.round(value, 2))
    pct = F.concat(F.format_string("%.1f", F.round(value * 100, 1)), F.lit("%"))
    signed = F.concat(F.when(value >= 0, "+").otherwise(""), pct)
    plain = F.format_string("%.0f", F.round(value, 0))
    # Wording per kind of feature, first match wins.
    table = (
        ("volume", F.concat(F.lit("Trading volume of $"), whole)), ("liquidity", F.concat(F.lit("Liquidity of $"), whole)),
        ("gini", F.concat(F.lit("Holder concentration (Gini="), two, F.lit(")"))), ("smart_money", F.concat(F.lit("Smart money activity ("), pct, F.lit(")"))),
        ("sentiment", F.concat(F.lit("Social sentiment score ("), two, F.lit(")"))), ("mentions", F.concat(plain, F.lit(" social mentions"))),
        ("kol", F.concat(F.lit("KOL activity ("), plain, F.lit(")"))), ("bot_score", F.concat(F.lit("Bot activity score ("), pct, F.lit(")"))),
        ("price_change", F.concat(F.lit("Price change ("), signed, F.lit(")"))), ("holder", F.concat(plain, F.lit(" token holders"))),
    )
    out = None
    for key, text in table:
        out = F.when(low.contains(key), text) if out is None else out.when(low.contains(key), text)
    out = out.otherwise(F.concat(name, F.lit("="), F.format_string("%.3f", F.round(value, 3))))
    return F.concat(out, F.lit(" "), word, F.lit(" probability"))


def top_features(df: DataFrame, keys: list[str], names: list[str], n: int = 5) -> DataFrame:
    """Largest features per row by magnitude, as a share of the row's total magnitude."""
    cells = F.array(*[F.struct((-F.abs(F.col(c).cast("double"))).alias("o"), F.lit(i).alias("i"), F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)])
    total = F.aggregate(cells, F.lit(0.0), lambda s, x: s - x["o"])
    rows = df.select(*keys, total.alias("total"), F.posexplode(F.slice(F.array_sort(cells), 1, n)).alias("p", "f"))
    contribution = -F.col("f.o") / (F.col("total") + 1e-10)
    return rows.select(*keys, (F.col("p") + 1).alias("place"), "f.feature_name", "f.value", contribution.alias("contribution"),
                       F.when(F.col("f.value") > 0, "positive").otherwise("negative").alias("direction"),
                       feature_text(F.col("f.feature_name"), F.col("f.value"), contribution).alias("description"))
