"""Entry rules, cost-aware pairing and performance of trading curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.ordered import ordered_scan
from chainsieve.operators.wallet import seconds_between


def equity_metrics(curve: DataFrame, keys: list[str], slices: Column, *, initial: float, order: str = "ts", value: str = "value") -> DataFrame:
    """Total return, Sharpe ratio over steps (√252), drawdown from the running peak (starting at the initial capital) and final value."""
    steps = ordered_scan(curve, keys, [order], slices, running={"__high": ("max", F.col(value))}, before={"__prev": F.col(value)})
    peak = F.greatest(F.lit(initial), F.col("__high"))
    ret = F.when(F.col("__prev").isNotNull(), F.when(F.col("__prev") > 0, (F.col(value) - F.col("__prev")) / F.col("__prev")).otherwise(0.0))
    rows = steps.withColumn("__ret", ret).withColumn("__dd", F.when(peak > 0, (peak - F.col(value)) / peak).otherwise(0.0))
    final, sd = F.max_by(value, order), F.stddev_pop("__ret")
    return rows.groupBy(*keys).agg(
        ((final - initial) / initial).alias("total_return"), F.when((F.count("__ret") > 1) & (sd > 1e-12), F.avg("__ret") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe_ratio"),
        F.greatest(F.lit(0.0), F.max("__dd")).alias("max_drawdown"), final.alias("final_value"))


def capital_curve(closed: DataFrame, keys: list[str], slices: Column, *, initial: float = 10_000.0, order=("exit_ts", "trade_id")) -> DataFrame:
    """Capital after each closed trade."""
    run = ordered_scan(closed, keys, list(order), slices, running={"__cum": ("sum", F.col("pnl"))})
    return run.withColumn("value", F.lit(initial) + F.col("__cum")).drop("__cum")


def closed_trade_metrics(closed: DataFrame, keys: list[str], slices: Column, *, initial: float = 10_000.0) -> DataFrame:
    """Performance over closed trades; columns pnl, entry_ts, exit_ts, trade_id, fees_paid, slippage_cost."""
    curve = capital_curve(closed, keys, slices, initial=initial)
    high = ordered_scan(curve, keys, ["exit_ts", "trade_id"], slices, running={"__high": ("max", F.col("value"))})
    peak = F.greatest(F.lit(initial), F.col("__high"))
    n, ret = F.count(F.lit(1)), F.col("pnl") / initial
    return high.groupBy(*keys).agg(
        (F.sum("pnl") / initial).alias("total_return"), F.sum("pnl").alias("total_pnl"), n.alias("num_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.count_if(F.col("pnl") > 0).alias("num_wins"), (n - F.count_if(F.col("pnl") > 0)).alias("num_losses"), F.avg("pnl").alias("avg_pnl"),
        F.max("pnl").alias("best_trade"), F.min("pnl").alias("worst_trade"),
        F.when(n > 1, F.avg(ret) / (F.stddev_pop(ret) + 1e-10) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe_ratio"),
        F.greatest(F.lit(0.0), F.max((peak - F.col("value")) / peak)).alias("max_drawdown"),
        F.avg(seconds_between(F.col("entry_ts"), F.col("exit_ts")) / 3600.0).alias("avg_hold_time_hours"),
        F.sum("fees_paid").alias("total_fees_paid"), F.sum("slippage_cost").alias("total_slippage"))


def pair_signals_with_costs(signals: DataFrame, keys: list[str], order: list[str], slices: Column, *, fee: float = 0.003, slippage: float = 0.001) -> DataFrame:
    """Each closed round trip with its costs; columns side, price, amount.

    A later buy replaces an open position and a sell closes it, so a round trip
    is a sell whose previous signal is a buy. No shared cash balance limits the
    entries; positions are independent of each other.
    """
    step = ordered_scan(signals, keys, order, slices, before={"__open": F.struct("side", "price", "amount", order[0])})
    trips = step.where((F.col("side") == "sell") & (F.col("__open.side") == "buy"))
    amount = F.col("__open.amount")
    buy_price, sell_price = F.col("__open.price") * (1 + slippage), F.col("price") * (1 - slippage)
    cost, proceeds = amount * buy_price * (1 + fee), amount * sell_price * (1 - fee)
    return trips.select(
        *keys, *[c for c in order if c != order[0]], F.col("__open")[order[0]].alias("entry_ts"), F.col(order[0]).alias("exit_ts"), amount.alias("amount"), buy_price.alias("entry_price"), sell_price.alias("exit_price"),
        cost.alias("cost"), proceeds.alias("proceeds"), (proceeds - cost).alias("pnl"))


# ---------------------------------------------------------------- entry rules
def threshold_entries(predictions: DataFrame, threshold: float = 0.15) -> DataFrame:
    return predictions.where(F.col("probability") > threshold)


def top_n_entries(predictions: DataFrame, n: int = 5, *, ts: str = "ts", tie: tuple[str, ...] = ("token",), floor: float = 0.1) -> DataFrame:
    """The n most probable tokens per time; the row-number limit runs before the shuffle as well."""
    w = Window.partitionBy(ts).orderBy(F.col("probability").desc(), *tie)
    return predictions.where(F.col("probability") > floor).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def risk_adjusted_entries(predictions: DataFrame, min_ratio: float = 0.3) -> DataFrame:
    risk = F.greatest(F.coalesce("risk_score", F.lit(50.0)) / 100.0, F.lit(0.01))
    return predictions.withColumn("ratio", F.col("probability") / risk).where(F.col("ratio") > min_ratio)


def kelly_entries(predictions: DataFrame, *, fraction: float = 0.25, cap: float = 0.1) -> DataFrame:
    """Positive Kelly fractions at odds of the multiplier minus one, and the capped share of capital."""
    odds, p = F.regexp_replace("multiplier", "x", "").cast("double") - 1.0, F.col("probability")
    return predictions.withColumn("kelly", (odds * p - (1 - p)) / odds).where(F.col("kelly") > 0).withColumn("position_share", F.least(F.col("kelly") * fraction, F.lit(cap)))


def copy_trade_candidates(ranked: DataFrame, trades: DataFrame, k: int = 10) -> DataFrame:
    """Daily trades of the k best wallets; whether those are broadcast is left to their size."""
    best = ranked.orderBy("rank").limit(k).select("wallet")
    return trades.join(best, "wallet", "left_semi").withColumn("day", F.date_trunc("day", "ts"))
