"""Price events, as-of reads and how early wallets acted on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.operators.ordered import neighbours, ordered_scan, time_slice
from chainsieve.tables import money

PUMP, DUMP = 0.20, -0.15


def _minutes(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 6.0e7


def with_neighbour_prices(prices: DataFrame, slice_seconds: int = 86400) -> DataFrame:
    """Previous and next price point of every point of a token."""
    return ordered_scan(
        prices, ["token"], ["ts"], time_slice("ts", slice_seconds),
        before={"prev_price": F.col("price"), "prev_ts": F.col("ts")}, after={"next_price": F.col("price")},
    )


def price_events(prices: DataFrame, pump: float = PUMP, dump: float = DUMP) -> DataFrame:
    """Points whose step from the previous point is at least +20 % or at most -15 %."""
    change = F.when(F.col("prev_price") > 0, (F.col("price") - F.col("prev_price")) / F.col("prev_price"))
    rows = with_neighbour_prices(prices).withColumn("change", change)
    kind = F.when(F.col("change") >= pump, "pump").when(F.col("change") <= dump, "dump")
    return rows.withColumn("event", kind).where(F.col("event").isNotNull()).select(
        "token", "ts", "event", (F.col("change") * 100.0).alias("price_change_pct"),
        F.col("prev_price").alias("price_before"), F.col("price").alias("price_after"))


def local_extrema(prices: DataFrame) -> DataFrame:
    """Strict local maxima and minima, with the time of the point before them."""
    up = (F.col("price") > F.col("prev_price")) & (F.col("price") > F.col("next_price"))
    down = (F.col("price") < F.col("prev_price")) & (F.col("price") < F.col("next_price"))
    rows = with_neighbour_prices(prices)
    return rows.withColumn("extremum", F.when(up, "peak").when(down, "trough")).where(F.col("extremum").isNotNull()).select(
        "token", "ts", "price", "prev_ts", "extremum")


def read_as_of(
    probes: DataFrame, marks: DataFrame, keys: list[str], probe_id: list[str], probe_at: Column, mark_at: Column,
    values: dict[str, Column], *, ahead: bool, ties: bool, slice_seconds: int = 3600,
) -> DataFrame:
    """Join each probe to the nearest mark of its key at or before it (or after it).

    Probes and marks are laid into one list per key and values are carried along
    it, so the cost is linear and no pair is formed. ``ties`` says whether a mark
    at exactly the probe's time counts. Every probe comes back; without a mark, or
    without a time, its values are null.
    """
    marks_first = ties != ahead
    p = probes.select(*keys, *probe_id, probe_at.alias("__at"), F.lit(1 if marks_first else 0).alias("__o"), F.lit(True).alias("__probe"))
    m = marks.select(*keys, mark_at.alias("__at"), F.lit(0 if marks_first else 1).alias("__o"), F.lit(False).alias("__probe"),
                     *[v.alias(n) for n, v in values.items()])
    both = p.unionByName(m.where(F.col("__at").isNotNull()), allowMissingColumns=True)
    packed = F.when(~F.col("__probe"), F.struct(*values))
    wanted = {"__hit": packed}
    order = ["__at", "__o", *probe_id]
    scanned = ordered_scan(both, keys, order, time_slice("__at", slice_seconds),
                           **({"next_": wanted} if ahead else {"last": wanted}))
    return scanned.where("__probe").select(*keys, *probe_id, *[F.when(F.col("__at").isNotNull(), F.col("__hit")[n]).alias(n) for n in values])


def next_event(trades: DataFrame, events: DataFrame) -> DataFrame:
    """Time of the first event of the token at or after each trade."""
    return read_as_of(trades, events, ["token"], ["trade_id"], F.col("ts"), F.col("ts"), {"event_ts": F.col("ts")}, ahead=True, ties=True)


def pre_event_trades(trades: DataFrame, events: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Trades with an event of their token within the window after them; each once."""
    hit = next_event(trades, events)
    return trades.join(hit, ["token", "trade_id"]).where(_minutes(F.col("ts"), F.col("event_ts")) <= window_minutes)


def next_extremum(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Minutes to the next peak and trough.

    An extremum counts only when the point before it is itself after the trade,
    so extrema are placed at the time of their predecessor.
    """
    ext = local_extrema(prices)
    out = trades
    for kind in ("peak", "trough"):
        found = read_as_of(trades, ext.where(F.col("extremum") == kind), ["token"], ["trade_id"], F.col("ts"), F.col("prev_ts"),
                           {f"{kind}_ts": F.col("ts")}, ahead=True, ties=False)
        out = out.join(found, ["token", "trade_id"], "left")
    return out.withColumn("minutes_to_peak", _minutes(F.col("ts"), F.col("peak_ts"))).withColumn(
        "minutes_to_trough", _minutes(F.col("ts"), F.col("trough_ts")))


def price_near(trades: DataFrame, prices: DataFrame, tolerance_s: int = 3600) -> DataFrame:
    """First price point within the tolerance of each trade, else 0."""
    start = F.col("ts") - F.expr(f"INTERVAL {tolerance_s} SECONDS")
    found = read_as_of(trades, prices, ["token"], ["trade_id", "ts"], start, F.col("ts"),
                       {"near_price": F.col("price"), "near_ts": F.col("ts")}, ahead=True, ties=False)
    inside = F.unix_micros("near_ts") < F.unix_micros("ts") + tolerance_s * 1_000_000
    return found.select("token", "trade_id", F.when(inside, F.col("near_price")).otherwise(0.0).alias("near_price"))


def price_move_after(trades: DataFrame, prices: DataFrame, steps: int = 4) -> DataFrame:
    """Relative move from the first price after a trade to ``steps`` points later; 0 when there is none."""
    rows = neighbours(prices, ["token"], ["ts"], time_slice("ts", 86400), F.col("price"), steps, "later", ahead=True)
    move = F.when(F.col("price") > 0, (F.get("later", F.lit(steps - 1)) - F.col("price")) / F.col("price"))
    found = read_as_of(trades, rows.withColumn("move", F.coalesce(move, F.lit(0.0))), ["token"], ["trade_id"], F.col("ts"), F.col("ts"),
                       {"move": F.col("move")}, ahead=True, ties=False)
    return found.select("token", "trade_id", F.coalesce("move", F.lit(0.0)).alias("move"))


def enrich_trade_usd(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """``amount_usd`` from the last known price at the time of the trade."""
    known = read_as_of(trades, prices, ["token"], ["trade_id"], F.col("ts"), F.col("ts"), {"known_price": F.col("price")}, ahead=False, ties=True)
    return trades.join(known, ["token", "trade_id"], "left").withColumn("enriched_usd", F.col("amount_tokens") * F.col("known_price"))


def price_timeline(trades: DataFrame, minutes: int) -> DataFrame:
    """Last trade price per regular interval."""
    w = F.window("ts", f"{minutes} minutes")
    return trades.groupBy("token", w.alias("w")).agg(F.max_by("price", F.struct("ts", "price")).alias("price"), F.count(F.lit(1)).alias("trades")).select(
        "token", F.col("w.start").alias("ts"), "price", "trades")


def fill_grid(prices: DataFrame, minutes: int) -> DataFrame:
    """Every step between a token's first and last point, with the last known price."""
    step = f"INTERVAL {minutes} MINUTES"
    span = prices.groupBy("token").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("token", F.explode(F.sequence("a", "b", F.expr(step))).alias("ts"))
    known = read_as_of(grid, prices, ["token"], ["ts"], F.col("ts"), F.col("ts"), {"price": F.col("price")}, ahead=False, ties=True)
    return known.select("token", "ts", "price")


def constant_grid(prices: DataFrame, minutes: int) -> DataFrame:
    """Fallback grid: steps back from each token's last point, all at its current price."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    span = prices.groupBy("token").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max_by("price", F.struct("ts", "price")).alias("price"))
    return span.select("token", F.explode(F.sequence("b", "a", -step)).alias("ts"), "price")


def timing_signals(trades: DataFrame, prices: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Per token and wallet: trades ahead of pumps and dumps, and minutes to the next turn."""
    events = price_events(prices)
    counts = events.groupBy("token").agg(F.count_if(F.col("event") == "pump").alias("pumps_detected"), F.count_if(F.col("event") == "dump").alias("dumps_detected"))
    is_buy = F.col("side") == "buy"
    # Buys look for pumps and peaks, sells for dumps and troughs: one scan per
    # kind of mark, with the side as part of the key.
    sided = trades.withColumn("want", F.when(is_buy, "up").otherwise("down"))
    event_marks = events.withColumn("want", F.when(F.col("event") == "pump", "up").otherwise("down"))
    ext = local_extrema(prices).withColumn("want", F.when(F.col("extremum") == "peak", "up").otherwise("down"))
    ahead = read_as_of(sided, event_marks, ["token", "want"], ["trade_id", "wallet", "ts"], F.col("ts"), F.col("ts"),
                       {"event_ts": F.col("ts")}, ahead=True, ties=True)
    turn = read_as_of(sided, ext, ["token", "want"], ["trade_id", "wallet", "ts"], F.col("ts"), F.col("prev_ts"),
                      {"turn_ts": F.col("ts")}, ahead=True, ties=False)
    up = F.col("want") == "up"
    near = _minutes(F.col("ts"), F.col("event_ts")) <= window_minutes
    a = ahead.groupBy("token", "wallet").agg(
        F.count_if(up & near).alias("pre_pump_buys"), F.count_if(~up & near).alias("pre_dump_sells"),
        F.count_if(up).alias("total_buys"), F.count_if(~up).alias("total_sells"))
    mins = _minutes(F.col("ts"), F.col("turn_ts"))
    b = turn.groupBy("token", "wallet").agg(
        F.coalesce(F.avg(F.when(up, mins)), F.lit(0.0)).alias("avg_entry_timing_minutes"),
        F.coalesce(F.avg(F.when(~up, mins)), F.lit(0.0)).alias("avg_exit_timing_minutes"))
    rate = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    return (
        a.join(b, ["token", "wallet"]).join(counts, "token", "left")
        .withColumn("pre_pump_entry_rate", rate("pre_pump_buys", "total_buys"))
        .withColumn("pre_dump_exit_rate", rate("pre_dump_sells", "total_sells"))
        .withColumn("pumps_detected", F.coalesce("pumps_detected", F.lit(0)))
        .withColumn("dumps_detected", F.coalesce("dumps_detected", F.lit(0)))
    )


def bin_trades(trades: DataFrame, prices: DataFrame, minutes: int = 15) -> DataFrame:
    """Traded usd per wallet and bin of the token's price series; bins without trades are absent.

    Bins start at the token's first price point. ``dense_bins`` adds the empty ones.
    """
    span = prices.groupBy("token").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    rows = trades.join(span, "token")
    width = minutes * 60 * 1_000_000
    k = F.floor((F.unix_micros("ts") - F.unix_micros("start")) / width)
    last = F.floor((F.unix_micros("end") - F.unix_micros("start")) / width)
    usd = money(F.abs(F.coalesce("amount_usd", "amount_tokens")))
    return rows.withColumn("bin", k).where((F.col("bin") >= 0) & (F.col("bin") <= last)).groupBy("token", "wallet", "bin").agg(
        F.sum(usd).cast("double").alias("volume"))


def dense_bins(trades: DataFrame, prices: DataFrame, minutes: int = 15) -> DataFrame:
    """Market volume per bin over the whole grid of each token, zero where nothing traded."""
    width = minutes * 60 * 1_000_000
    span = prices.groupBy("token").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    grid = span.select("token", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.unix_micros("end") - F.unix_micros("start")) / width))).alias("bin"))
    used = bin_trades(trades, prices, minutes).groupBy("token", "bin").agg(F.sum(money("volume")).cast("double").alias("volume"))
    return grid.join(used, ["token", "bin"], "left").select("token", "bin", F.coalesce("volume", F.lit(0.0)).alias("volume"))
