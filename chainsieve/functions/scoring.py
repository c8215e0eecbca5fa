"""Scores, risk rules and explanations as column expressions over signal columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category weights, steepness and cut-offs of the smart-money score.
CATEGORY_WEIGHTS = {"timing": 0.30, "profitability": 0.35, "graph": 0.15, "behavioral": 0.20}
STEEPNESS = 6.0
MAX_RISK = 0.7


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def timing_score() -> Column:
    m = F.col("avg_entry_timing_minutes")
    entry = F.when(m <= -60, 1.0).when(m >= 60, 0.0).otherwise(0.5 - m / 120.0)
    return _unit(0.4 * F.col("pre_pump_entry_rate") + 0.4 * F.col("pre_dump_exit_rate") + 0.2 * entry)


def profitability_score() -> Column:
    roi, sharpe = F.col("avg_roi"), F.col("sharpe_ratio")
    roi_part = F.when(roi <= 0, 0.0).when(roi >= 5.0, 1.0).otherwise(roi / 6.25)
    sharpe_part = F.when(sharpe <= 0, 0.0).when(sharpe >= 4.0, 1.0).otherwise(sharpe / 4.0)
    return _unit(0.4 * F.col("win_rate") + 0.4 * roi_part + 0.2 * sharpe_part)


def graph_score() -> Column:
    linked = F.least(F.lit(1.0), F.col("connected_smart_wallets") / 10.0)
    return _unit(0.3 * F.col("centrality_score") + 0.3 * F.col("clustering_coefficient") + 0.4 * linked)


def behavioral_score() -> Column:
    has = lambda tag: F.array_contains("pattern_tags", tag).cast("double")
    tags = _unit(0.5 + 0.2 * has("early_adopter") + 0.2 * has("diamond_hands") - 0.1 * has("high_frequency"))
    venues = F.least(F.lit(1.0), F.col("dex_diversity") / 5.0)
    return _unit(0.3 * venues + 0.3 * F.col("gas_pattern_consistency") + 0.4 * tags)


def smart_money_score(weights: Mapping[str, float] = CATEGORY_WEIGHTS) -> Column:
    """Weighted category scores (weights normalised) through a logistic curve centred at 0.5."""
    total = sum(weights.values())
    parts = {"timing": timing_score(), "profitability": profitability_score(), "graph": graph_score(), "behavioral": behavioral_score()}
    mixed = sum((parts[k] * (w / total) for k, w in weights.items()), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-STEEPNESS * (mixed - 0.5)))


def risk_score() -> Column:
    """Strongest of the wash, bot, circular and rapid rules."""
    freq, buys, sells = F.col("trade_frequency_per_day"), F.col("total_buys"), F.col("total_sells")
    balance = F.least(buys, sells) / F.greatest(buys, sells)
    wash = F.when((freq > 20) & (F.abs("avg_roi") < 0.01), 0.8).when((buys > 0) & (sells > 0) & (freq > 10) & (balance > 0.95), 0.7).otherwise(0.0)
    bot = F.when(F.col("gas_pattern_consistency") > 0.95, 0.6).when(freq > 50, 0.7).otherwise(0.0)
    loop = F.when((F.col("clustering_coefficient") > 0.8) & (F.col("centrality_score") < 0.2), 0.7).otherwise(0.0)
    rapid = F.when((F.col("avg_holding_duration_hours") < 1.0) & (freq > 20), 0.6).otherwise(0.0)
    return F.greatest(wash, bot, loop, rapid)


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(c * 100.0, digits)), F.lit("%"))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "very_high").when(score >= 0.6, "high").when(score >= 0.4, "medium").otherwise("low")


# Report wording of the four score bands.
BANDS = (
    (0.8, "Very high confidence this is a smart-money wallet. Strong evidence of superior timing, profitability, and strategic positioning."),
    (0.6, "High confidence this is a smart-money wallet. Shows multiple positive indicators of sophisticated trading."),
    (0.4, "Moderate confidence. Some positive indicators but mixed signals. May be skilled trader or beneficiary of favorable market conditions."),
    (None, "Low confidence. Limited evidence of smart-money characteristics. Could be retail trader or opportunistic participant."),
)


def interpretation(score: Column) -> Column:
    out = None
    for cut, text in BANDS:
        if cut is None:
            return out.otherwise(text)
        out = F.when(score >= cut, text) if out is None else out.when(score >= cut, text)
    return out


def _signal(place: int, category: str, name: str, value: Column, contribution: Column, description: Column, present: Column | None = None) -> Column:
    s = F.struct(
        (-F.round(contribution, 9)).alias("sort"), F.lit(place).alias("place"), F.lit(category).alias("category"), F.lit(name).alias("name"),
        value.cast("double").alias("value"), contribution.alias("contribution"), description.alias("description"))
    return s if present is None else F.when(present, s)


def top_signals(k: int = 5) -> Column:
    """The k largest contributions, ties in listing order."""
    c = F.col
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    signals = F.array_compact(F.array(
        _signal(0, "timing", "Pre-pump entry rate", c("pre_pump_entry_rate"), c("pre_pump_entry_rate") * 0.3, text("%d buys before price pumps", c("pre_pump_buys"))),
        _signal(1, "timing", "Pre-dump exit rate", c("pre_dump_exit_rate"), c("pre_dump_exit_rate") * 0.3, text("%d sells before price dumps", c("pre_dump_sells"))),
        _signal(2, "profitability", "Win rate", c("win_rate"), c("win_rate") * 0.35, F.concat(percent(c("win_rate")), F.lit(" of trades profitable"))),
        _signal(3, "profitability", "Average ROI", c("avg_roi"), F.least(F.lit(1.0), c("avg_roi") / 5.0) * 0.35, F.concat(percent(c("avg_roi")), F.lit(" average return"))),
        _signal(4, "graph", "Connected to smart wallets", c("connected_smart_wallets"), F.least(F.lit(1.0), c("connected_smart_wallets") / 10.0) * 0.15,
                text("Connected to %d known smart wallets", c("connected_smart_wallets"))),
        _signal(5, "graph", "Network centrality", c("centrality_score"), c("centrality_score") * 0.15, text("Centrality score %.2f", F.round("centrality_score", 2))),
        _signal(6, "behavioral", "Trading patterns", F.size("pattern_tags"), F.lit(0.2), F.concat(F.lit("Patterns: "), F.array_join("pattern_tags", ", ")), F.size("pattern_tags") > 0),
    ))
    return F.slice(F.array_sort(signals), 1, k)


def timeline_events() -> Column:
    event = lambda kind, text: F.struct(F.lit(kind).alias("event_type"), text.alias("description"), F.lit("positive").alias("impact"))
    return F.array_compact(F.array(
        F.when(F.col("pre_pump_buys") > 0, event("early_entry", F.format_string("Entered position before %d price pumps", F.col("pumps_detected")))),
        F.when(F.col("pre_dump_sells") > 0, event("early_exit", F.format_string("Exited position before %d price dumps", F.col("dumps_detected")))),
        F.when(F.col("best_roi") > 2.0, event("high_roi_trade", F.concat(F.lit("Best trade achieved "), percent(F.col("best_roi")), F.lit(" ROI")))),
    ))


def summary_text(wallet: Column, score: Column, signals: Column) -> Column:
    level = F.when(score > 0.7, "high").when(score > 0.5, "medium").otherwise("low")
    top = F.get(signals, F.lit(0))
    return F.concat(
        F.lit("Wallet "), F.substring(wallet.cast("string"), 1, 10), F.lit("... has a "), percent(score),
        F.lit(" probability of being smart money ("), level, F.lit(" confidence). Primary indicator: "), top["name"], F.lit(" - "), top["description"], F.lit("."))
