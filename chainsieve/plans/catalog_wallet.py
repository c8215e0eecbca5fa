"""Registered queries: matching and per-wallet metrics."""

from pyspark.sql import functions as F

from chainsieve.operators import wallet as w
from chainsieve.operators.matching import fifo_match, min_trade_size, wallet_volumes
from chainsieve.operators.ordered import even_slices, ordered_scan
from chainsieve.plans.registry import query
from chainsieve.tables import as_of, money

CLOSED_COLS = """trade_id, token, wallet, entry_ts, exit_ts, round(cost_basis_usd, 6) AS cost_basis_usd, sell_value_usd,
  round(pnl, 6) AS pnl, round(roi, 6) AS roi, round(holding_hours, 6) AS holding_hours, matched_buys"""


@query("fifo_match", f"SELECT {CLOSED_COLS} FROM v_closed")
def _(t):
    return fifo_match(t.trades).drop("chain")


@query("fifo_match_even", f"SELECT {CLOSED_COLS} FROM v_closed")
def _(t):
    """Months of trades cut by rows where they hold more than 1,000 of one key."""
    return fifo_match(t.trades, slice_seconds=30 * 86_400, rows_per_slice=1000, even=True).drop("chain")


@query("running_volume_even", """SELECT chain, trade_id, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) OVER w AS DOUBLE) AS volume_usd, count(*) OVER w AS trades,
 coalesce(lag(trade_id) OVER (PARTITION BY chain ORDER BY ts, trade_id), -1) AS previous FROM v_trades WINDOW w AS (PARTITION BY chain ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    """A chain's trades in slices of a month, each cut again by rows."""
    rows = even_slices(t.trades.select("chain", "ts", "trade_id", "amount_usd"), ["chain"], ("ts", "trade_id"), seconds=30 * 86_400, most=1000)
    run = ordered_scan(rows, ["chain"], ["ts", "trade_id"], F.col("even_slice"), running={"volume": ("sum", money("amount_usd")), "trades": ("count", F.lit(1))}, before={"previous": F.col("trade_id")})
    return run.select("chain", "trade_id", F.col("volume").cast("double").alias("volume_usd"), "trades", F.coalesce("previous", F.lit(-1)).alias("previous"))


@query("fifo_match_compat", """
WITH o AS (SELECT s.trade_id, s.usd, (least(s.hi, b.hi) - greatest(s.lo, b.lo)) / (b.hi - greatest(s.lo, b.lo)) * b.usd AS cost
  FROM v_lots s JOIN v_lots b ON s.side = 'sell' AND b.side = 'buy' AND s.token = b.token AND s.wallet = b.wallet AND b.lo < s.hi AND s.lo < b.hi)
SELECT trade_id, round(sum(cost), 6) AS cost_basis_usd, round(usd - sum(cost), 6) AS pnl, count(*) AS matched_buys FROM o GROUP BY trade_id, usd""")
def _(t):
    return fifo_match(t.trades, compat=True).select("trade_id", "cost_basis_usd", "pnl", "matched_buys")


@query("fifo_match_prior_buy", """
WITH n AS (SELECT trade_id, token, wallet, side, ts, amount_tokens AS qty, amount_usd AS usd,
    sum(CASE WHEN side = 'buy' THEN amount_tokens ELSE -amount_tokens END) OVER w AS net
    FROM v_trades WINDOW w AS (PARTITION BY token, wallet ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, least(0, min(net) OVER (PARTITION BY token, wallet ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)) AS low FROM n),
e AS (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE qty - (coalesce(lag(low) OVER (PARTITION BY token, wallet ORDER BY ts, trade_id), 0) - low) END AS eff FROM l),
p AS (SELECT *, sum(eff) OVER w AS hi, sum(eff) OVER w - eff AS lo FROM e WHERE eff > 0 WINDOW w AS (PARTITION BY token, wallet, side ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING))
SELECT s.trade_id, round(sum((least(s.hi, b.hi) - greatest(s.lo, b.lo)) / b.eff * b.usd), 6) AS cost_basis_usd, count(*) AS matched_buys, min(b.ts) AS entry_ts
FROM p s JOIN p b ON s.side = 'sell' AND b.side = 'buy' AND s.token = b.token AND s.wallet = b.wallet AND b.lo < s.hi AND s.lo < b.hi
GROUP BY s.trade_id""")
def _(t):
    return fifo_match(t.trades, require_prior_buy=True).select("trade_id", "cost_basis_usd", "matched_buys", "entry_ts")


@query("min_trade_size", """
SELECT wallet, count(*) AS trades FROM v_trades WHERE amount_usd >= 10 GROUP BY wallet""")
def _(t):
    return min_trade_size(t.trades, 10.0).groupBy("wallet").agg(F.count(F.lit(1)).alias("trades"))


@query("wallet_volumes", """
SELECT wallet, b AS buy_volume_usd, s AS sell_volume_usd, round(greatest(0, b - s), 6) AS holdings_usd FROM (
 SELECT wallet, CAST(sum(CASE WHEN side = 'buy' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS b,
        CAST(sum(CASE WHEN side = 'sell' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS s
 FROM v_trades GROUP BY wallet)""")
def _(t):
    return wallet_volumes(t.trades)


@query("min_holdings", """
SELECT wallet, round(b - s, 6) AS holdings_usd FROM (
 SELECT wallet, CAST(sum(CASE WHEN side = 'buy' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS b,
        CAST(sum(CASE WHEN side = 'sell' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS s
 FROM v_trades GROUP BY wallet) WHERE greatest(0, b - s) >= 100""")
def _(t):
    return wallet_volumes(t.trades, min_holdings=100.0).select("wallet", "holdings_usd")


def _tf(tf, cond):
    return f"""count(*) FILTER (WHERE {cond}) AS total_{tf}, count(*) FILTER (WHERE {cond} AND pnl > 0) AS wins_{tf},
 round(coalesce(count(*) FILTER (WHERE {cond} AND pnl > 0) / nullif(count(*) FILTER (WHERE {cond}), 0), 0), 6) AS win_rate_{tf}"""


@query("win_rate", "SELECT wallet, " + ", ".join(_tf(tf, c) for tf, c in [
    ("1d", "exit_ts >= TIMESTAMP '2024-01-30 00:00:00'"), ("7d", "exit_ts >= TIMESTAMP '2024-01-24 00:00:00'"),
    ("30d", "exit_ts >= TIMESTAMP '2024-01-01 00:00:00'"), ("all", "true")]) + " FROM v_closed GROUP BY wallet")
def _(t):
    return w.win_rates(fifo_match(t.trades), as_of())


@query("timeframe_filter", "SELECT wallet, count(*) AS trades FROM v_trades WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY wallet")
def _(t):
    return w.timeframe_filter(t.trades, "ts", "7d", as_of()).groupBy("wallet").agg(F.count(F.lit(1)).alias("trades"))


@query("realized_pnl", """SELECT wallet, round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 4) AS avg_pnl, round(max(pnl), 4) AS best_trade,
 round(min(pnl), 4) AS worst_trade, round(sum(cost_basis_usd), 4) AS buy_volume, round(sum(sell_value_usd), 4) AS sell_volume, count(*) AS trades
 FROM v_closed GROUP BY wallet""", digits=4)
def _(t):
    return w.realized_pnl(fifo_match(t.trades))


UNREAL = """WITH c AS (SELECT token, max_by(price, ts) AS cp FROM v_prices GROUP BY token)
SELECT p.wallet, p.token, (coalesce(cp, avg_buy_price) - avg_buy_price) * amount AS unrealized_pnl,
 coalesce(cp, avg_buy_price) * amount AS current_value, avg_buy_price * amount AS cost_basis
FROM v_positions p LEFT JOIN c ON p.token = c.token"""


@query("unrealized_pnl_positions", f"""SELECT wallet, token, round(unrealized_pnl, 6) AS unrealized_pnl, round(current_value, 6) AS current_value,
 round(cost_basis, 6) AS cost_basis FROM ({UNREAL})""")
def _(t):
    return w.unrealized_pnl(t.positions, w.current_prices(t.prices))


@query("unrealized_pnl_total", f"""SELECT wallet, round(sum(unrealized_pnl), 6) AS total, count(*) AS positions FROM ({UNREAL}) GROUP BY wallet""")
def _(t):
    return w.unrealized_pnl(t.positions, w.current_prices(t.prices)).groupBy("wallet").agg(
        F.sum("unrealized_pnl").alias("total"), F.count(F.lit(1)).alias("positions"))


DRAWDOWN = """d AS (SELECT wallet, max(peak - cum) / greatest(max(peak), 1) AS dd FROM (
  SELECT wallet, exit_ts, trade_id, cum, max(cum) OVER (PARTITION BY wallet ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS peak FROM (
   SELECT wallet, exit_ts, trade_id, sum(pnl) OVER (PARTITION BY wallet ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM v_closed)) GROUP BY wallet)"""


@query("performance_metrics", f"""WITH {DRAWDOWN},
a AS (SELECT wallet, count(*) AS n, avg(pnl) AS m, stddev_pop(pnl) AS sd, avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3600000000.0) AS hold,
  greatest(floor((epoch_us(max(exit_ts)) - epoch_us(min(exit_ts))) / 86400000000.0), 1) AS days FROM v_closed GROUP BY wallet)
SELECT a.wallet, round(CASE WHEN n >= 2 AND sd > 1e-12 THEN m / sd * sqrt(365.0) ELSE 0 END, 6) AS sharpe_ratio,
 round(CASE WHEN n >= 2 THEN dd ELSE 0 END, 6) AS max_drawdown, round(CASE WHEN n >= 2 THEN hold ELSE 0 END, 6) AS avg_hold_time_hours,
 round(CASE WHEN n >= 2 THEN n / days ELSE 0 END, 6) AS trade_frequency_per_day FROM a JOIN d ON a.wallet = d.wallet""")
def _(t):
    return w.performance_metrics(fifo_match(t.trades))


@query("max_drawdown", f"WITH {DRAWDOWN} SELECT wallet, round(dd, 6) AS max_drawdown FROM d")
def _(t):
    closed = fifo_match(t.trades)
    return w.max_drawdown(closed, ["wallet"], ["exit_ts", "trade_id"], w.time_slice("exit_ts"), "pnl")


@query("token_and_chain_breakdown", """
SELECT wallet, kind, item, round(sum(pnl), 4) AS total_pnl, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins,
 round(count(*) FILTER (WHERE pnl > 0) / count(*), 4) AS win_rate
FROM (SELECT wallet, pnl, 'token' AS kind, CAST(token AS VARCHAR) AS item FROM v_closed UNION ALL SELECT wallet, pnl, 'chain', coalesce(chain, 'unknown') FROM v_closed)
GROUP BY wallet, kind, item""", digits=4)
def _(t):
    return w.token_and_chain_breakdown(fifo_match(t.trades))


@query("token_breakdown", """SELECT wallet, token, round(sum(pnl), 4) AS total_pnl, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins,
 round(count(*) FILTER (WHERE pnl > 0) / count(*), 4) AS win_rate FROM v_closed GROUP BY wallet, token""", digits=4)
def _(t):
    return w.breakdown(fifo_match(t.trades), "token")


@query("chain_breakdown", """SELECT wallet, coalesce(chain, 'unknown') AS chain, round(sum(pnl), 4) AS total_pnl, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins,
 round(count(*) FILTER (WHERE pnl > 0) / count(*), 4) AS win_rate FROM v_closed GROUP BY 1, 2""", digits=4)
def _(t):
    return w.breakdown(fifo_match(t.trades), "chain", fill="unknown")


@query("report_token_breakdown", """SELECT wallet, token, chain, count(*) AS trade_count, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate,
 round(sum(pnl), 4) AS total_pnl_usd, round(avg(roi), 4) AS average_roi, round(sum(cost_basis_usd + sell_value_usd), 4) AS volume_usd,
 min(entry_ts) AS first_trade, max(exit_ts) AS last_trade FROM v_closed GROUP BY wallet, token, chain""", digits=4)
def _(t):
    return w.report_token_breakdown(fifo_match(t.trades))


METRICS = """m AS (SELECT wallet, chain, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(pnl) AS pnl,
  CASE WHEN stddev_pop(pnl) <> 0 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END AS sharpe_ratio, count(*) AS trades FROM v_closed GROUP BY wallet, chain)"""


@query("chain_statistics", f"""WITH {METRICS} SELECT chain, count(*) AS total_wallets, round(avg(win_rate), 4) AS avg_win_rate, round(sum(pnl), 4) AS total_pnl,
 round(avg(pnl), 4) AS avg_pnl, CAST(sum(trades) AS BIGINT) AS total_trades, round(median(win_rate), 4) AS median_win_rate, round(median(pnl), 4) AS median_pnl FROM m GROUP BY chain""", digits=4)
def _(t):
    return w.chain_statistics(w.wallet_metrics(fifo_match(t.trades)))


@query("wallet_trading_features", """SELECT wallet, count(*) AS total_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
 round(avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3600000000.0), 6) AS avg_hold_time_hours,
 round(count(*) / coalesce(nullif(floor((epoch_us(max(exit_ts)) - epoch_us(min(exit_ts))) / 86400000000.0), 0), 1), 6) AS trade_frequency_per_day
 FROM v_closed GROUP BY wallet""")
def _(t):
    return w.trading_features(fifo_match(t.trades))


@query("wallet_pnl_features", """SELECT wallet, round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 4) AS avg_pnl_per_trade, round(max(pnl), 4) AS best_trade, round(min(pnl), 4) AS worst_trade,
 round(stddev_pop(pnl), 4) AS pnl_std, round(CASE WHEN count(*) > 1 AND stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END, 4) AS sharpe_ratio
 FROM v_closed GROUP BY wallet""", digits=4)
def _(t):
    return w.pnl_features(fifo_match(t.trades))


@query("profitability_signals", """SELECT token, wallet, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(roi), 6) AS avg_roi,
 round(median(roi), 6) AS median_roi, count(*) AS total_trades, count(*) FILTER (WHERE pnl > 0) AS profitable_trades,
 round(avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3600000000.0), 6) AS avg_holding_duration_hours,
 round(CASE WHEN count(*) >= 2 AND stddev_pop(roi) > 1e-12 THEN avg(roi) / stddev_pop(roi) ELSE 0 END, 6) AS sharpe_ratio,
 round(max(roi), 6) AS best_roi, round(min(roi), 6) AS worst_roi FROM v_closed GROUP BY token, wallet""")
def _(t):
    return w.profitability_signals(fifo_match(t.trades))


@query("behavioral_signals", """WITH h AS (SELECT token, wallet, avg(holding_hours) AS hold FROM v_closed GROUP BY token, wallet),
a AS (SELECT token, wallet, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days, count(DISTINCT dex) AS dexes,
  stddev_pop(gas_price) / avg(gas_price) AS cv, count(*) FILTER (WHERE token_age_hours < 24) / count(*) AS early FROM v_trades GROUP BY token, wallet),
b AS (SELECT a.*, coalesce(hold, 0) AS hold, CASE WHEN n >= 2 AND days > 0 THEN n / days ELSE 0 END AS freq FROM a LEFT JOIN h ON a.token = h.token AND a.wallet = h.wallet)
SELECT token, wallet, round(freq, 4) AS trade_frequency_per_day, dexes AS dex_diversity,
 round(CASE WHEN n >= 2 THEN greatest(0, 1 - least(cv, 1)) ELSE 0 END, 4) AS gas_pattern_consistency,
 concat_ws(',', CASE WHEN early > 0.5 THEN 'early_adopter' END, CASE WHEN hold > 168 THEN 'diamond_hands' END,
  CASE WHEN hold > 1 AND hold < 168 THEN 'swing_trader' END, CASE WHEN freq > 10 THEN 'high_frequency' END) AS pattern_tags FROM b""", digits=4)
def _(t):
    hold = fifo_match(t.trades).groupBy("token", "wallet").agg(F.avg("holding_hours").alias("avg_hold_hours"))
    return w.behavioral_signals(t.trades, hold).withColumn("pattern_tags", F.array_join("pattern_tags", ","))


@query("preferred_hours", """SELECT wallet, string_agg(CAST(h AS VARCHAR), ',' ORDER BY rn) AS preferred_hours FROM (
 SELECT wallet, h, row_number() OVER (PARTITION BY wallet ORDER BY n DESC, h) AS rn FROM (
  SELECT wallet, hour(ts) AS h, count(*) AS n FROM v_trades GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY wallet""")
def _(t):
    return w.preferred_hours(t.trades).withColumn("preferred_hours", F.array_join("preferred_hours", ","))


WASH = """ws AS (SELECT wallet, CASE WHEN sum(n) >= 5 AND count(*) FILTER (WHERE n >= 4) > 0
   THEN count(*) FILTER (WHERE n >= 4 AND flips / greatest(n - 1, 1) > 0.7) / count(*) FILTER (WHERE n >= 4) ELSE 0 END AS wash_score FROM (
  SELECT wallet, token, count(*) AS n, count(*) FILTER (WHERE side <> prev) AS flips FROM (
   SELECT wallet, token, side, lag(side) OVER (PARTITION BY wallet, token ORDER BY ts, trade_id) AS prev FROM v_trades) GROUP BY wallet, token) GROUP BY wallet)"""


@query("alternation_wash_score", f"WITH {WASH} SELECT wallet, round(wash_score, 6) AS wash_score FROM ws")
def _(t):
    return w.alternation_wash_score(t.trades)


TIMING = """tm AS (SELECT wallet, CASE WHEN count(gap) > 5 THEN (greatest(0, 1 - 2 * stddev_pop(gap) / avg(gap)) + avg(CASE WHEN gap < 5 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END)) / 2 ELSE 0 END AS timing_score
 FROM (SELECT wallet, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY wallet ORDER BY ts, trade_id))) / 1000000.0 AS gap FROM v_trades) GROUP BY wallet)"""
SANDWICH = """sw AS (SELECT wallet, least(count(*) FILTER (WHERE side <> s2 AND side = s3 AND (epoch_us(t3) - epoch_us(ts)) / 1000000.0 < 30) / greatest(floor(count(*) / 3), 1), 1) AS sandwich_score
 FROM (SELECT wallet, side, ts, lead(side) OVER w AS s2, lead(side, 2) OVER w AS s3, lead(ts, 2) OVER w AS t3 FROM v_trades
  WINDOW w AS (PARTITION BY wallet ORDER BY ts, trade_id)) GROUP BY wallet)"""


@query("timing_regularity", f"WITH {TIMING} SELECT wallet, round(timing_score, 6) AS timing_score FROM tm")
def _(t):
    return w.timing_regularity(t.trades)


@query("sandwich_score", f"WITH {SANDWICH} SELECT wallet, round(sandwich_score, 6) AS sandwich_score FROM sw")
def _(t):
    return w.sandwich_score(t.trades)


PATTERNS = f"""WITH {WASH},
c AS (SELECT wallet, pnl, cost_basis_usd, floor((epoch_us(exit_ts) - epoch_us(entry_ts)) / 86400000000.0) AS d, (epoch_us(exit_ts) - epoch_us(entry_ts)) / 3600000000.0 AS h FROM v_closed),
cs AS (SELECT wallet, count(*) FILTER (WHERE d >= 30) / count(*) AS diamond_hands, count(*) FILTER (WHERE d BETWEEN 1 AND 14) / count(*) AS swing_trader,
  count(*) FILTER (WHERE h <= 24) / count(*) AS day_trader,
  CASE WHEN count(*) FILTER (WHERE pnl > 0) / count(*) < 0.6 THEN 0 ELSE least(1, (count(*) FILTER (WHERE pnl > 0) / count(*) - 0.6) / 0.4) END AS smart_money,
  count(*) FILTER (WHERE pnl > 0) / count(*) AS profit_taker,
  coalesce(count(*) FILTER (WHERE pnl < 0 AND h <= 24 AND abs(pnl) < 0.2 * cost_basis_usd) / nullif(count(*) FILTER (WHERE pnl < 0), 0), 0) AS loss_cutter FROM c GROUP BY wallet),
pc AS (SELECT a.trade_id, a.price / b.price - 1 AS ch FROM v_trades a ASOF JOIN v_trades b ON a.token = b.token AND a.ts - INTERVAL 5 MINUTE >= b.ts),
es AS (SELECT t.wallet, count(*) FILTER (WHERE epoch_us(t.ts) - epoch_us(listed_ts) <= 86400000000) / count(*) AS early_adopter,
  count(*) FILTER (WHERE side = 'buy' AND coalesce(ch, 0) > 0.1) / count(*) AS pump_chaser
  FROM v_trades t JOIN v_listings l ON t.token = l.token LEFT JOIN pc ON t.trade_id = pc.trade_id GROUP BY t.wallet),
wide AS (SELECT es.*, cs.* EXCLUDE (wallet), CASE WHEN wash_score > 0.3 THEN wash_score ELSE 0 END AS wash_trader
  FROM es LEFT JOIN cs ON es.wallet = cs.wallet LEFT JOIN ws ON es.wallet = ws.wallet)
"""


@query("behavior_patterns", PATTERNS + """SELECT wallet, pattern, round(confidence, 6) AS confidence FROM (
 UNPIVOT (SELECT wallet, CAST(COLUMNS(* EXCLUDE wallet) AS DOUBLE) FROM wide) ON COLUMNS(* EXCLUDE wallet) INTO NAME pattern VALUE confidence) WHERE confidence > 0""")
def _(t):
    trades = w.price_change_5m(t.trades)
    return w.behavior_patterns(fifo_match(t.trades), trades, t.listings, w.alternation_wash_score(t.trades))


@query("behavior_flags", PATTERNS + """SELECT wallet, coalesce(smart_money, 0) >= 0.6 AS is_smart_money, wash_trader >= 0.5 AS is_wash_trader,
 early_adopter >= 0.5 AS is_early_adopter FROM wide""")
def _(t):
    p = w.behavior_patterns(fifo_match(t.trades), t.trades, t.listings, w.alternation_wash_score(t.trades))
    conf = lambda n: F.coalesce(F.max(F.when(F.col("pattern") == n, F.col("confidence"))), F.lit(0.0))
    flags = p.groupBy("wallet").agg((conf("smart_money") >= 0.6).alias("is_smart_money"),
                                    (conf("wash_trader") >= 0.5).alias("is_wash_trader"), (conf("early_adopter") >= 0.5).alias("is_early_adopter"))
    rest = t.trades.select("wallet").distinct().join(flags, "wallet", "left")
    return rest.select("wallet", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags.columns if c != "wallet"])


@query("listing_join", """SELECT t.wallet, count(*) AS tradeable, round(avg((epoch_us(t.ts) - epoch_us(listed_ts)) / 3600000000.0), 4) AS avg_hours_since_listing
 FROM v_trades t JOIN v_listings l ON t.token = l.token GROUP BY t.wallet""", digits=4)
def _(t):
    rows = t.trades.join(t.listings, "token")
    return rows.groupBy("wallet").agg(F.count(F.lit(1)).alias("tradeable"),
                                      F.avg(w.seconds_between(F.col("listed_ts"), F.col("ts")) / 3600.0).alias("avg_hours_since_listing"))


@query("rank_wallets_global", f"""WITH {METRICS} SELECT wallet, chain, trades, round(win_rate, 4) AS win_rate, round(pnl, 4) AS pnl, round(sharpe_ratio, 4) AS sharpe_ratio,
 row_number() OVER (ORDER BY win_rate DESC, wallet) AS rank, count(*) OVER () AS total,
 round((count(*) OVER () - row_number() OVER (ORDER BY win_rate DESC, wallet) + 1) / count(*) OVER () * 100.0, 4) AS percentile FROM m WHERE trades >= 5""", digits=4)
def _(t):
    return w.rank_wallets(w.wallet_metrics(fifo_match(t.trades)), "win_rate", min_trades=5)


@query("rank_wallets_per_chain", f"""WITH {METRICS} SELECT wallet, chain, trades, round(pnl, 4) AS pnl, round(win_rate, 4) AS win_rate, round(sharpe_ratio, 4) AS sharpe_ratio,
 row_number() OVER (PARTITION BY chain ORDER BY pnl DESC, wallet) AS rank, count(*) OVER (PARTITION BY chain) AS total,
 round((count(*) OVER (PARTITION BY chain) - row_number() OVER (PARTITION BY chain ORDER BY pnl DESC, wallet) + 1) / count(*) OVER (PARTITION BY chain) * 100.0, 4) AS percentile FROM m""", digits=4)
def _(t):
    return w.rank_wallets(w.wallet_metrics(fifo_match(t.trades)), "pnl", per_chain=True)


@query("search_wallets", f"""WITH {METRICS} SELECT wallet, chain, round(win_rate, 4) AS win_rate, round(pnl, 4) AS pnl, round(sharpe_ratio, 4) AS sharpe_ratio, trades FROM m
 WHERE win_rate >= 0.3 AND trades >= 5 AND chain = 'ethereum' ORDER BY m.pnl DESC, wallet LIMIT 20 OFFSET 5""", digits=4)
def _(t):
    return w.search_wallets(w.wallet_metrics(fifo_match(t.trades)), min_win_rate=0.3, min_trades=5, chain="ethereum", sort_by="pnl", limit=20, offset=5)


@query("search_wallets_total", f"WITH {METRICS} SELECT chain, count(*) AS total FROM m WHERE win_rate >= 0.3 AND trades >= 5 GROUP BY chain")
def _(t):
    m = w.wallet_metrics(fifo_match(t.trades))
    return m.where((F.col("win_rate") >= 0.3) & (F.col("trades") >= 5)).groupBy("chain").agg(F.count(F.lit(1)).alias("total"))
