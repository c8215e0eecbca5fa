"""First-in first-out matching of buys to sells, and the per-wallet volumes around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.operators.ordered import even_slices, join_same, ordered_scan, time_slice
from chainsieve.tables import money

#: Quantities are shifted so that a key's total has eleven digits before the point: 27 decimals are left for its smallest trade.
QTY, DIGITS = "decimal(38,27)", 10


def shifted(amount: Column, power: Column) -> Column:
    """``amount`` times ten to the minus ``power``, exactly as its shortest decimal says."""
    text = amount.cast("double").cast("string")
    exponent = F.coalesce(F.nullif(F.substring_index(text, "E", -1), text).cast("int"), F.lit(0)) - power
    return F.concat(F.substring_index(text, "E", 1), F.lit("E"), exponent.cast("string")).try_cast(QTY)


def assign_wallet(trades: DataFrame) -> DataFrame:
    """The wallet a trade belongs to: the buyer of a buy, the seller of a sell."""
    wallet = F.when(F.col("side") == "buy", F.col("buyer")).otherwise(F.col("seller"))
    return trades.withColumn("wallet", wallet).where(F.col("wallet").isNotNull())


def min_trade_size(trades: DataFrame, usd: float) -> DataFrame:
    """Applied before matching; it changes which lots exist, so it is never moved past it."""
    return trades.where(F.col("amount_usd") >= usd) if usd else trades


def wallet_volumes(trades: DataFrame, keys: tuple[str, ...] = ("wallet",), min_holdings: float = 0.0) -> DataFrame:
    side = lambda s: F.sum(F.when(F.col("side") == s, money("amount_usd")).otherwise(0)).cast("double")
    out = (
        trades.groupBy(*keys)
        .agg(side("buy").alias("buy_volume_usd"), side("sell").alias("sell_volume_usd"))
        .withColumn("holdings_usd", F.greatest(F.lit(0.0), F.col("buy_volume_usd") - F.col("sell_volume_usd")))
    )
    return out.where(F.col("holdings_usd") >= min_holdings) if min_holdings else out


def _sellable(base: DataFrame, keys: list[str], slices: Column) -> DataFrame:
    """Reduce each sell to what the inventory at that moment can cover."""
    signed = F.when(F.col("is_buy"), F.col("qty")).otherwise(-F.col("qty"))
    net = ordered_scan(base, keys, ["ts", "trade_id"], slices, running={"net": ("sum", signed)})
    low = ordered_scan(net, keys, ["ts", "trade_id"], slices, running={"low": ("min", F.least(F.col("net"), F.lit(0).cast(QTY)))})
    prior = ordered_scan(low, keys, ["ts", "trade_id"], slices, before={"low_before": F.col("low")})
    short = F.coalesce(F.col("low_before"), F.lit(0).cast(QTY)) - F.col("low")
    return (
        prior.withColumn("qty", F.when(F.col("is_buy"), F.col("qty")).otherwise(F.col("qty") - short).cast(QTY))
        .where(F.col("qty") > 0)
        .drop("net", "low", "low_before")
    )


def fifo_match(
    trades: DataFrame,
    keys: tuple[str, ...] = ("token", "wallet"),
    *,
    compat: bool = False,
    require_prior_buy: bool = False,
    slice_seconds: int = 3600,
    rows_per_slice: int = 100_000,
    even: bool = False,
) -> DataFrame:
    """One row per sell that matched at least one buy.

    Quantities of each side are laid end to end, so a buy and a sell each occupy
    an interval on one quantity axis and a match is an overlap. Instead of an
    overlap join, the interval ends of both sides are merged into one ordered
    list: every stretch between neighbouring ends belongs to exactly one buy and
    one sell. Work is linear in the number of trades, and one very active wallet
    is spread over slices of time (running quantities) and of the quantity axis.

    ``compat`` charges a partly used lot against its remaining quantity.
    ``require_prior_buy`` lets a sell use only inventory bought before it.
    ``even`` cuts a slice of time with more than ``rows_per_slice`` trades by rows.
    """
    ks = list(keys)
    extra = [c for c in ("chain",) if c in trades.columns and c not in ks]
    base = trades.select(
        *ks, *extra, "trade_id", "ts", (F.col("side") == "buy").alias("is_buy"),
        F.col("amount_tokens").cast("double").alias("amount"), F.col("amount_usd").alias("usd"),
    ).where((F.col("amount") > 0) & (F.col("amount") < float("inf")))
    power = (F.floor(F.log10(F.sum("amount"))) - DIGITS).cast("int").alias("power")
    base = join_same(base, base.groupBy(*ks).agg(power), ks).withColumn("qty", shifted(F.col("amount"), F.col("power"))).drop("amount", "power")
    when = time_slice("ts", slice_seconds)
    if even:
        base, when = even_slices(base, ks, ("ts", "trade_id"), seconds=slice_seconds, most=rows_per_slice, name="__even"), F.col("__even")
    if require_prior_buy:
        base = _sellable(base, ks, when)
    zero = F.lit(0).cast(QTY)
    bought = F.when(F.col("is_buy"), F.col("qty")).otherwise(zero)
    sold = F.when(F.col("is_buy"), zero).otherwise(F.col("qty"))
    laid = ordered_scan(
        base, ks, ["ts", "trade_id"], when,
        running={"bought": ("sum", bought), "sold": ("sum", sold)},
        total={"n": ("count", F.lit(1)), "all_bought": ("sum", bought), "all_sold": ("sum", sold)},
    ).withColumn("hi", F.when(F.col("is_buy"), F.col("bought")).otherwise(F.col("sold")))
    pieces = F.ceil(F.col("n") / F.lit(rows_per_slice))
    length = F.greatest(F.col("all_bought"), F.col("all_sold")).cast("double")
    ends = laid.select(
        *ks, *extra, "trade_id", "ts", "is_buy", "usd", "hi", "qty",
        F.least(F.floor(F.col("hi").cast("double") * pieces / length), pieces - 1).alias("piece"),
    )
    lot = F.struct("ts", "usd", "qty", "hi")
    deal = F.struct("trade_id", "ts", "usd", *extra)
    merged = ordered_scan(
        ends.select(*ks, "hi", "piece", "trade_id",
                    F.when(F.col("is_buy"), lot).alias("buy"), F.when(~F.col("is_buy"), deal).alias("sell")),
        ks, ["hi", "trade_id"], F.col("piece"),
        next_={"lot": F.col("buy"), "deal": F.col("sell")},
        before={"start": F.col("hi")},
    ).withColumn("start", F.coalesce("start", zero))
    pieces_ = merged.where(F.col("lot").isNotNull() & F.col("deal").isNotNull() & (F.col("hi") > F.col("start")))
    size = (F.col("hi") - F.col("start")).cast("double")
    base_qty = F.col("lot.hi") - F.greatest(F.col("start"), F.col("lot.hi") - F.col("lot.qty")) if compat else F.col("lot.qty")
    base_qty = base_qty.cast("double")
    held = (F.unix_micros("deal.ts") - F.unix_micros("lot.ts")) / 1.0e6
    lots = pieces_.select(
        *ks, "deal.*", F.col("lot.ts").alias("lot_ts"), "start",
        (size / base_qty * F.col("lot.usd")).alias("cost"), held.alias("held"),
    )
    closed = lots.groupBy(*ks, *extra, "trade_id", F.col("ts").alias("exit_ts"), F.col("usd").alias("sell_value_usd")).agg(
        F.min_by("lot_ts", "start").alias("entry_ts"),
        F.sum("cost").alias("cost_basis_usd"),
        F.sum(F.col("held") * F.col("cost")).alias("weighted"),
        F.count(F.lit(1)).alias("matched_buys"),
    )
    cost = F.col("cost_basis_usd")
    pnl = F.col("sell_value_usd") - cost
    return closed.select(
        *ks, *extra, "trade_id", "entry_ts", "exit_ts", "cost_basis_usd", "sell_value_usd", pnl.alias("pnl"),
        F.when(cost > 0, pnl / cost).otherwise(0.0).alias("roi"),
        F.when(cost > 0, F.col("weighted") / cost / 3600.0).otherwise(0.0).alias("holding_hours"),
        "matched_buys",
    )
