"""Registered queries: price events, as-of reads, graph, scores and the finder."""

import re

from pyspark.sql import functions as F

from chainsieve.functions import scoring
from chainsieve.operators import graph as g
from chainsieve.operators import timing as tm
from chainsieve.plans import finder
from chainsieve.plans.registry import query
from chainsieve.tables import SQL_VIEWS, as_of, money

NB = """nb AS (SELECT token, ts, price, lag(price) OVER w AS pp, lag(ts) OVER w AS pts, lead(price) OVER w AS np FROM v_prices WINDOW w AS (PARTITION BY token ORDER BY ts))"""
EV = NB + """, ev AS (SELECT token, ts, CASE WHEN (price - pp) / pp >= 0.20 THEN 'pump' ELSE 'dump' END AS event, (price - pp) / pp * 100.0 AS pct, pp, price
 FROM nb WHERE pp > 0 AND ((price - pp) / pp >= 0.20 OR (price - pp) / pp <= -0.15))"""
EX = """ex AS (SELECT token, ts, price, pts, CASE WHEN price > pp THEN 'peak' ELSE 'trough' END AS extremum FROM nb WHERE (price > pp AND price > np) OR (price < pp AND price < np))"""


@query("price_events", f"WITH {EV} SELECT token, ts, event, round(pct, 4) AS price_change_pct, round(pp, 4) AS price_before, round(price, 4) AS price_after FROM ev", digits=4)
def _(t):
    return tm.price_events(t.prices)


@query("local_extrema", f"WITH {NB}, {EX} SELECT token, ts, round(price, 4) AS price, extremum FROM ex", digits=4)
def _(t):
    return tm.local_extrema(t.prices).drop("prev_ts")


PRE = """pre AS (SELECT t.trade_id, t.token, t.wallet, t.side, EXISTS (SELECT 1 FROM ev WHERE ev.token = t.token
   AND ev.event = CASE WHEN t.side = 'buy' THEN 'pump' ELSE 'dump' END AND ev.ts >= t.ts AND ev.ts <= t.ts + INTERVAL 60 MINUTE) AS hit FROM v_trades t)"""


@query("pre_event_trades", f"WITH {EV} SELECT trade_id, wallet FROM v_trades t WHERE EXISTS (SELECT 1 FROM ev WHERE ev.token = t.token AND ev.event = 'pump' AND ev.ts >= t.ts AND ev.ts <= t.ts + INTERVAL 60 MINUTE)")
def _(t):
    return tm.pre_event_trades(t.trades, tm.price_events(t.prices).where(F.col("event") == "pump")).select("trade_id", "wallet")


NEXT = """nx AS (SELECT t.trade_id, t.token, t.wallet, t.side, t.ts,
  (SELECT min(ts) FROM ex WHERE ex.token = t.token AND extremum = 'peak' AND pts > t.ts) AS peak_ts,
  (SELECT min(ts) FROM ex WHERE ex.token = t.token AND extremum = 'trough' AND pts > t.ts) AS trough_ts FROM v_trades t)"""


@query("next_extremum", f"""WITH {NB}, {EX}, {NEXT} SELECT trade_id, round((epoch_us(peak_ts) - epoch_us(ts)) / 60000000.0, 4) AS minutes_to_peak,
 round((epoch_us(trough_ts) - epoch_us(ts)) / 60000000.0, 4) AS minutes_to_trough FROM nx""", digits=4)
def _(t):
    return tm.next_extremum(t.trades, t.prices).select("trade_id", "minutes_to_peak", "minutes_to_trough")


@query("price_near", """SELECT t.trade_id, round(coalesce(min_by(p.price, p.ts), 0), 6) AS near_price FROM v_trades t
 LEFT JOIN v_prices p ON p.token = t.token AND p.ts > t.ts - INTERVAL 3600 SECOND AND p.ts < t.ts + INTERVAL 3600 SECOND GROUP BY t.trade_id""")
def _(t):
    return tm.price_near(t.trades, t.prices).select("trade_id", "near_price")


MOVE = """mv AS (SELECT t.trade_id, t.wallet, t.token, t.amount_usd, coalesce((p4 - p.price) / p.price, 0) AS move FROM v_trades t
 ASOF LEFT JOIN (SELECT token, ts, price, lead(price, 4) OVER (PARTITION BY token ORDER BY ts) AS p4 FROM v_prices) p ON p.token = t.token AND t.ts < p.ts)"""


@query("price_move_after", f"WITH {MOVE} SELECT trade_id, round(move, 6) AS move FROM mv")
def _(t):
    return tm.price_move_after(t.trades, t.prices).select("trade_id", "move")


@query("enrich_trade_usd", """SELECT t.trade_id, round(t.amount_tokens * p.price, 6) AS enriched_usd FROM v_trades t ASOF LEFT JOIN v_prices p ON p.token = t.token AND t.ts >= p.ts""")
def _(t):
    return tm.enrich_trade_usd(t.trades, t.prices).select("trade_id", "enriched_usd")


@query("price_timeline", """SELECT token, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(max_by(price, ts), 6) AS price, count(*) AS trades FROM v_trades GROUP BY 1, 2""")
def _(t):
    return tm.price_timeline(t.trades, 15)


@query("price_grid_fill", """WITH s AS (SELECT token, min(ts) AS a, max(ts) AS b FROM v_prices GROUP BY token), gr AS (SELECT token, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS ts FROM s)
 SELECT gr.token, gr.ts, round(p.price, 6) AS price FROM gr ASOF LEFT JOIN v_prices p ON p.token = gr.token AND gr.ts >= p.ts""")
def _(t):
    return tm.fill_grid(t.prices, 30)


@query("price_grid_constant", """WITH s AS (SELECT token, min(ts) AS a, max(ts) AS b, max_by(price, ts) AS price FROM v_prices GROUP BY token)
 SELECT token, unnest(generate_series(a, b, INTERVAL 60 MINUTE)) AS ts, round(price, 6) AS price FROM s""")
def _(t):
    return tm.constant_grid(t.prices, 60)


BINS = """sp AS (SELECT token, min(ts) AS a, max(ts) AS b FROM v_prices GROUP BY token),
bn AS (SELECT t.token, t.wallet, CAST(floor((epoch_us(t.ts) - epoch_us(a)) / 900000000.0) AS BIGINT) AS bin, CAST(sum(CAST(abs(amount_usd) AS DECIMAL(18,2))) AS DOUBLE) AS volume
 FROM v_trades t JOIN sp ON sp.token = t.token WHERE t.ts >= a AND floor((epoch_us(t.ts) - epoch_us(a)) / 900000000.0) <= floor((epoch_us(b) - epoch_us(a)) / 900000000.0) GROUP BY 1, 2, 3)"""


@query("bin_trades", f"WITH {BINS} SELECT token, wallet, bin, volume FROM bn")
def _(t):
    return tm.bin_trades(t.trades, t.prices)


@query("bin_trades_dense", f"""WITH {BINS}, gr AS (SELECT token, unnest(generate_series(0, CAST(floor((epoch_us(b) - epoch_us(a)) / 900000000.0) AS BIGINT))) AS bin FROM sp),
 mk AS (SELECT token, bin, CAST(sum(CAST(volume AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM bn GROUP BY 1, 2)
 SELECT gr.token, gr.bin, coalesce(volume, 0) AS volume FROM gr LEFT JOIN mk ON mk.token = gr.token AND mk.bin = gr.bin""")
def _(t):
    return tm.dense_bins(t.trades, t.prices)


TSIG = EV + ", " + EX + ", " + PRE + ", " + NEXT + """, ts AS (SELECT pre.token, pre.wallet, count(*) FILTER (WHERE pre.side = 'buy' AND hit) AS pre_pump_buys, count(*) FILTER (WHERE pre.side = 'sell' AND hit) AS pre_dump_sells,
  count(*) FILTER (WHERE pre.side = 'buy') AS total_buys, count(*) FILTER (WHERE pre.side = 'sell') AS total_sells,
  coalesce(avg((epoch_us(peak_ts) - epoch_us(nx.ts)) / 60000000.0) FILTER (WHERE pre.side = 'buy'), 0) AS avg_entry_timing_minutes,
  coalesce(avg((epoch_us(trough_ts) - epoch_us(nx.ts)) / 60000000.0) FILTER (WHERE pre.side = 'sell'), 0) AS avg_exit_timing_minutes
  FROM pre JOIN nx ON pre.trade_id = nx.trade_id GROUP BY pre.token, pre.wallet),
tsig AS (SELECT ts.*, coalesce(pre_pump_buys / nullif(total_buys, 0), 0) AS pre_pump_entry_rate, coalesce(pre_dump_sells / nullif(total_sells, 0), 0) AS pre_dump_exit_rate,
  (SELECT count(*) FROM ev WHERE ev.token = ts.token AND event = 'pump') AS pumps_detected, (SELECT count(*) FROM ev WHERE ev.token = ts.token AND event = 'dump') AS dumps_detected FROM ts)"""


@query("timing_signals", f"""WITH {TSIG} SELECT token, wallet, pre_pump_buys, pre_dump_sells, total_buys, total_sells, round(avg_entry_timing_minutes, 4) AS avg_entry_timing_minutes,
 round(avg_exit_timing_minutes, 4) AS avg_exit_timing_minutes, round(pre_pump_entry_rate, 4) AS pre_pump_entry_rate, round(pre_dump_exit_rate, 4) AS pre_dump_exit_rate, pumps_detected, dumps_detected FROM tsig""", digits=4)
def _(t):
    return tm.timing_signals(t.trades, t.prices)


# ---------------------------------------------------------------- graph
PAIRS = "np AS (SELECT DISTINCT src AS wallet, dst AS other FROM v_edges WHERE src <> dst UNION SELECT DISTINCT dst, src FROM v_edges WHERE src <> dst)"
CENT = PAIRS + """, ce AS (SELECT wallet, count(*) AS neighbors, count(*) / ((SELECT count(*) FROM (SELECT src FROM v_edges UNION SELECT dst FROM v_edges)) - 1) AS centrality_score FROM np GROUP BY wallet)"""
CLUS = """tr AS (SELECT a.wallet, count(*) AS links FROM np a JOIN np b ON a.wallet = b.wallet AND a.other < b.other JOIN np c ON c.wallet = a.other AND c.other = b.other GROUP BY a.wallet),
cl AS (SELECT ce.wallet, CASE WHEN neighbors >= 2 THEN coalesce(links, 0) / (neighbors * (neighbors - 1) / 2) ELSE 0 END AS clustering_coefficient FROM ce LEFT JOIN tr ON ce.wallet = tr.wallet)"""
GSIG = CENT + ", " + CLUS + """, fs AS (SELECT dst AS wallet, count(DISTINCT src) AS n FROM v_edges WHERE type = 'fund_flow' GROUP BY dst),
sm AS (SELECT wallet, count(*) AS n FROM np WHERE other IN (SELECT wallet FROM v_smart) GROUP BY wallet),
gs AS (SELECT ce.wallet, neighbors AS total_connections, centrality_score, clustering_coefficient, coalesce(fs.n, 0) AS common_funding_sources, coalesce(sm.n, 0) AS connected_smart_wallets
  FROM ce JOIN cl ON ce.wallet = cl.wallet LEFT JOIN fs ON ce.wallet = fs.wallet LEFT JOIN sm ON ce.wallet = sm.wallet)"""


@query("trade_graph", "SELECT src, dst, count(*) AS trades, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS usd FROM v_edges GROUP BY src, dst")
def _(t):
    return g.trade_graph(t.trades).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("trades"), F.sum(money("amount_usd")).cast("double").alias("usd"))


@query("graph_vertices", "SELECT src AS wallet FROM v_edges UNION SELECT dst FROM v_edges")
def _(t):
    return g.vertices(t.edges)


@query("degree_centrality", f"WITH {CENT} SELECT wallet, neighbors, round(centrality_score, 6) AS centrality_score FROM ce")
def _(t):
    return g.degree_centrality(t.edges)


@query("clustering_coefficient", f"WITH {CENT}, {CLUS} SELECT wallet, round(clustering_coefficient, 6) AS clustering_coefficient FROM cl")
def _(t):
    return g.clustering_coefficient(t.edges)


@query("funding_sources", "SELECT dst AS wallet, count(DISTINCT src) AS common_funding_sources FROM v_edges WHERE type = 'fund_flow' GROUP BY dst")
def _(t):
    return g.funding_sources(t.edges)


@query("smart_connections", f"WITH {PAIRS} SELECT wallet, count(*) AS connected_smart_wallets FROM np WHERE other IN (SELECT wallet FROM v_smart) GROUP BY wallet")
def _(t):
    return g.smart_connections(t.edges, t.known_smart)


@query("graph_signals", f"""WITH {GSIG} SELECT wallet, total_connections, round(centrality_score, 6) AS centrality_score, round(clustering_coefficient, 6) AS clustering_coefficient,
 common_funding_sources, connected_smart_wallets FROM gs""")
def _(t):
    return g.graph_signals(t.edges, t.known_smart)


@query("graph_neighbors", f"WITH {PAIRS} SELECT wallet, other FROM np QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY other) <= 50")
def _(t):
    return g.graph_neighbors(t.edges, 50)


HOPS = "hop AS (SELECT src AS here, dst AS there, ts, trade_id, amount_usd FROM v_edges WHERE amount_usd >= 5 UNION ALL SELECT dst, src, ts, trade_id, amount_usd FROM v_edges WHERE amount_usd >= 5)"


@query("fund_flow_bfs", f"""WITH {HOPS}, d1 AS (SELECT there AS wallet, min_by(amount_usd, (ts, trade_id, here)) AS amount FROM hop WHERE here IN (FROM v_busiest) AND there NOT IN (FROM v_busiest) GROUP BY there),
 d2 AS (SELECT there AS wallet, min_by(amount_usd, (ts, trade_id, here)) AS amount FROM hop WHERE here IN (SELECT wallet FROM d1) AND there NOT IN (FROM v_busiest) AND there NOT IN (SELECT wallet FROM d1) GROUP BY there)
 SELECT (FROM v_busiest) AS seed, wallet, 1 AS depth, amount, round(least(1, amount / 10000), 6) AS strength FROM d1
 UNION ALL SELECT (FROM v_busiest), wallet, 2, amount, round(least(1, amount / 10000), 6) FROM d2""")
def _(t):
    return g.fund_flow_bfs(t.edges, t.busiest, min_amount=5.0)


CLUSTERS = """WITH RECURSIVE tied AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM v_edges WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 2),
 sym AS (SELECT a, b FROM tied UNION SELECT b, a FROM tied),
 reach(v, r) AS (SELECT a, a FROM sym UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.v),
 cc AS (SELECT v AS wallet, min(r) AS cluster_id FROM reach GROUP BY v)"""


@query("fund_flow_clusters", CLUSTERS + " SELECT wallet, cluster_id FROM cc")
def _(t):
    return g.fund_flow_clusters(t.edges)


@query("cluster_sizes", CLUSTERS + " SELECT cluster_id, count(*) AS members FROM cc GROUP BY cluster_id")
def _(t):
    return g.fund_flow_clusters(t.edges).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))


@query("cluster_of", CLUSTERS + " SELECT w.wallet, cluster_id FROM (SELECT DISTINCT wallet FROM v_trades) w LEFT JOIN cc ON cc.wallet = w.wallet")
def _(t):
    return g.cluster_of(g.fund_flow_clusters(t.edges), t.trades.select("wallet").distinct())


# ---------------------------------------------------------------- finder
SIGNALS = f"""WITH {TSIG}, {GSIG},
h AS (SELECT token, wallet, avg(holding_hours) AS hold FROM v_closed GROUP BY token, wallet),
pf AS (SELECT token, wallet, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(roi) AS avg_roi, count(*) AS total_trades, max(roi) AS best_roi,
  avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3600000000.0) AS hours, CASE WHEN count(*) >= 2 AND stddev_pop(roi) > 1e-12 THEN avg(roi) / stddev_pop(roi) ELSE 0 END AS sharpe FROM v_closed GROUP BY token, wallet),
bh AS (SELECT a.*, coalesce(hold, 0) AS hold, CASE WHEN n >= 2 AND days > 0 THEN n / days ELSE 0 END AS freq, CASE WHEN n >= 2 THEN greatest(0, 1 - least(cv, 1)) ELSE 0 END AS gas FROM (
   SELECT token, wallet, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days, count(DISTINCT dex) AS dexes,
   stddev_pop(gas_price) / avg(gas_price) AS cv, count(*) FILTER (WHERE token_age_hours < 24) / count(*) AS early FROM v_trades GROUP BY token, wallet) a LEFT JOIN h ON a.token = h.token AND a.wallet = h.wallet),
sg AS (SELECT pf.*, tsig.* EXCLUDE (token, wallet), bh.dexes, bh.freq, bh.gas, early > 0.5 AS t_early, hold > 168 AS t_diamond, hold > 1 AND hold < 168 AS t_swing, freq > 10 AS t_high,
  coalesce(gs.centrality_score, 0) AS cent, coalesce(gs.clustering_coefficient, 0) AS clus, coalesce(gs.connected_smart_wallets, 0) AS smart
  FROM pf JOIN tsig ON pf.token = tsig.token AND pf.wallet = tsig.wallet JOIN bh ON pf.token = bh.token AND pf.wallet = bh.wallet LEFT JOIN gs ON gs.wallet = pf.wallet),
sc AS (SELECT *, greatest(
   CASE WHEN freq > 20 AND abs(avg_roi) < 0.01 THEN 0.8 WHEN total_buys > 0 AND total_sells > 0 AND least(total_buys, total_sells) / greatest(total_buys, total_sells) > 0.95 AND freq > 10 THEN 0.7 ELSE 0 END,
   CASE WHEN gas > 0.95 THEN 0.6 WHEN freq > 50 THEN 0.7 ELSE 0 END, CASE WHEN clus > 0.8 AND cent < 0.2 THEN 0.7 ELSE 0 END, CASE WHEN hours < 1 AND freq > 20 THEN 0.6 ELSE 0 END) AS risk,
  1 / (1 + exp(-6 * (
   0.30 * least(1, greatest(0, 0.4 * pre_pump_entry_rate + 0.4 * pre_dump_exit_rate + 0.2 * CASE WHEN avg_entry_timing_minutes <= -60 THEN 1 WHEN avg_entry_timing_minutes >= 60 THEN 0 ELSE 0.5 - avg_entry_timing_minutes / 120 END))
 + 0.35 * least(1, greatest(0, 0.4 * win_rate + 0.4 * CASE WHEN avg_roi <= 0 THEN 0 WHEN avg_roi >= 5 THEN 1 ELSE avg_roi / 6.25 END + 0.2 * CASE WHEN sharpe <= 0 THEN 0 WHEN sharpe >= 4 THEN 1 ELSE sharpe / 4 END))
 + 0.15 * least(1, greatest(0, 0.3 * cent + 0.3 * clus + 0.4 * least(1, smart / 10)))
 + 0.20 * least(1, greatest(0, 0.3 * least(1, dexes / 5) + 0.3 * gas + 0.4 * least(1, greatest(0, 0.5 + 0.2 * t_early::INT + 0.2 * t_diamond::INT - 0.1 * t_high::INT)))) - 0.5))) AS score FROM sg),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, wallet) AS rank FROM sc WHERE risk < 0.7) WHERE rank <= 20)
"""


def _signals(t):
    return finder.wallet_signals(t.trades, t.prices, t.edges, t.known_smart)


def _found(t):
    return finder.top_wallets(finder.score_wallets(_signals(t)).where(F.col("risk_score") < 0.7), 0.0, 20)


@query("find_smart_wallets", SIGNALS + """SELECT token, wallet, rank, round(score, 4) AS smart_money_score, round(risk, 4) AS risk_score, round(win_rate, 4) AS win_rate, round(avg_roi, 4) AS realized_roi,
 total_trades AS trades_count, round(pre_pump_entry_rate, 4) AS early_entry_rate, round(cent, 4) AS graph_centrality,
 CASE WHEN score >= 0.8 THEN 'very_high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_level FROM tk""", digits=4)
def _(t):
    found = finder.find_smart_wallets(t.trades, t.prices, t.edges, t.known_smart, min_confidence=0.0, top_k=20)
    return found.select("token", "wallet", "rank", "smart_money_score", "risk_score", "win_rate", F.col("avg_roi").alias("realized_roi"),
                        F.col("total_trades").alias("trades_count"), F.col("pre_pump_entry_rate").alias("early_entry_rate"), F.col("centrality_score").alias("graph_centrality"), "confidence_level")


def _filtered_sql() -> str:
    """SIGNALS over the trades that the filters leave; prices, edges and known wallets stay those of all trades."""
    parts = ["""w_base AS (SELECT * FROM v_trades WHERE chain = 'ethereum' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY AND ts <= TIMESTAMP '2024-01-31 00:00:00' AND amount_usd >= 20)""",
             """w_trades AS (SELECT * FROM w_base WHERE (token, wallet) IN (SELECT (token, wallet) FROM w_base GROUP BY token, wallet
 HAVING sum(CASE WHEN side = 'buy' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE -CAST(amount_usd AS DECIMAL(18,2)) END) >= 50))"""]
    own = lambda text: re.sub(r"\bv_(trades|lots|overlaps|closed)\b", r"w_\1", text)
    parts += [f"w_{n} AS ({own(SQL_VIEWS[f'v_{n}'])})" for n in ("lots", "overlaps", "closed")]
    return "WITH " + ",\n".join(parts) + ",\n" + own(SIGNALS)[len("WITH "):]


@query("find_smart_wallets_filtered", _filtered_sql() + """SELECT token, wallet, rank, round(score, 4) AS smart_money_score, round(win_rate, 4) AS win_rate, total_trades AS trades_count
 FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, wallet) AS rank FROM sc WHERE risk < 0.7 AND score >= 0.1) WHERE rank <= 100""", digits=4)
def _(t):
    found = finder.find_smart_wallets(t.trades, t.prices, t.edges, t.known_smart, min_confidence=0.1, chain="ethereum", as_of=as_of(), window_days=20, min_trade_size_usd=20.0, min_holdings_usd=50.0)
    return found.select("token", "wallet", "rank", "smart_money_score", "win_rate", F.col("total_trades").alias("trades_count"))


@query("risk_score", SIGNALS + "SELECT token, wallet, round(risk, 4) AS risk_score FROM sc WHERE risk < 0.7", digits=4)
def _(t):
    return finder.score_wallets(_signals(t)).where(F.col("risk_score") < scoring.MAX_RISK).select("token", "wallet", "risk_score")


@query("smart_money_score", SIGNALS + "SELECT token, wallet, round(score, 4) AS smart_money_score FROM sc", digits=4)
def _(t):
    return finder.score_wallets(_signals(t)).select("token", "wallet", "smart_money_score")


@query("top_wallets", SIGNALS + "SELECT token, wallet, rank, round(score, 4) AS smart_money_score FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, wallet) AS rank FROM sc WHERE score >= 0.3) WHERE rank <= 10",
       digits=4)
def _(t):
    return finder.top_wallets(finder.score_wallets(_signals(t)), 0.3, 10).select("token", "wallet", "rank", "smart_money_score")


@query("key_metrics", SIGNALS + """SELECT token, wallet, round(win_rate, 4) AS win_rate, round(avg_roi, 4) AS realized_roi, total_trades AS trades_count,
 round(pre_pump_entry_rate, 4) AS early_entry_rate, round(cent, 4) AS graph_centrality FROM sg""", digits=4)
def _(t):
    return finder.key_metrics(_signals(t))


@query("explain_wallets", SIGNALS + """, al AS (SELECT token, wallet, score, pumps_detected, dumps_detected, pre_pump_buys, pre_dump_sells, best_roi, unnest([
  {'p': 0, 'name': 'Pre-pump entry rate', 'c': pre_pump_entry_rate * 0.3, 'd': format('{} buys before price pumps', pre_pump_buys)},
  {'p': 1, 'name': 'Pre-dump exit rate', 'c': pre_dump_exit_rate * 0.3, 'd': format('{} sells before price dumps', pre_dump_sells)},
  {'p': 2, 'name': 'Win rate', 'c': win_rate * 0.35, 'd': format('{:.1f}% of trades profitable', round(win_rate * 100, 1))},
  {'p': 3, 'name': 'Average ROI', 'c': least(1, avg_roi / 5) * 0.35, 'd': format('{:.1f}% average return', round(avg_roi * 100, 1))},
  {'p': 4, 'name': 'Connected to smart wallets', 'c': least(1, smart / 10) * 0.15, 'd': format('Connected to {} known smart wallets', smart)},
  {'p': 5, 'name': 'Network centrality', 'c': cent * 0.15, 'd': format('Centrality score {:.2f}', round(cent, 2))},
  {'p': 6, 'name': 'Trading patterns', 'c': CASE WHEN t_early OR t_diamond OR t_swing OR t_high THEN 0.2 END,
    'd': 'Patterns: ' || concat_ws(', ', CASE WHEN t_early THEN 'early_adopter' END, CASE WHEN t_diamond THEN 'diamond_hands' END, CASE WHEN t_swing THEN 'swing_trader' END, CASE WHEN t_high THEN 'high_frequency' END)}]) AS s FROM tk),
 rk AS (SELECT *, row_number() OVER (PARTITION BY token, wallet ORDER BY round(s.c, 9) DESC, s.p) AS rn FROM al WHERE s.c IS NOT NULL)
 SELECT token, wallet, string_agg(s.name, '|' ORDER BY rn) FILTER (WHERE rn <= 5) AS top_signals,
  format('Wallet {}... has a {:.1f}% probability of being smart money ({} confidence). Primary indicator: {} - {}.', CAST(wallet AS VARCHAR), round(any_value(score) * 100, 1),
   CASE WHEN any_value(score) > 0.7 THEN 'high' WHEN any_value(score) > 0.5 THEN 'medium' ELSE 'low' END, max(s.name) FILTER (WHERE rn = 1), max(s.d) FILTER (WHERE rn = 1)) AS summary,
  concat_ws('|', CASE WHEN any_value(pre_pump_buys) > 0 THEN format('Entered position before {} price pumps', any_value(pumps_detected)) END,
   CASE WHEN any_value(pre_dump_sells) > 0 THEN format('Exited position before {} price dumps', any_value(dumps_detected)) END,
   CASE WHEN any_value(best_roi) > 2 THEN format('Best trade achieved {:.1f}% ROI', round(any_value(best_roi) * 100, 1)) END) AS timeline
 FROM rk GROUP BY token, wallet""")
def _(t):
    full = finder.explain(_found(t))
    return full.select("token", "wallet", F.array_join(F.transform("top_signals", lambda s: s["name"]), "|").alias("top_signals"), "summary",
                       F.array_join(F.transform("timeline", lambda s: s["description"]), "|").alias("timeline"))


@query("funnel_counts", SIGNALS + """SELECT token, count(*) AS analyzed, count(*) FILTER (WHERE risk < 0.7) AS passing, least(count(*) FILTER (WHERE risk < 0.7), 20) AS returned FROM sc GROUP BY token""")
def _(t):
    return finder.funnel_counts(_signals(t), min_confidence=0.0, top_k=20)


@query("ranking_summary", SIGNALS + """SELECT token, round(avg(score), 4) AS avg_smart_money_score, round(list_sort(list(score))[CAST(floor(count(*) / 2) AS INT) + 1], 4) AS median_smart_money_score,
 round(avg(win_rate), 4) AS avg_win_rate, count(*) AS total_smart_wallets FROM tk GROUP BY token""", digits=4)
def _(t):
    return finder.ranking_summary(_found(t))


@query("bulk_leaderboard", SIGNALS + """, b AS (SELECT wallet, max(score) AS score FROM tk GROUP BY wallet)
 SELECT wallet, round(score, 4) AS smart_money_score, row_number() OVER (ORDER BY score DESC, wallet) AS rank FROM (SELECT * FROM b ORDER BY score DESC, wallet LIMIT 100)""", digits=4)
def _(t):
    return finder.bulk_leaderboard(_found(t)).drop("best_token")


@query("wallet_profile", SIGNALS + """, pr AS (SELECT token, wallet, 1 / (1 + exp(-6 * (
   0.30 * least(1, greatest(0, 0.4 * pre_pump_entry_rate + 0.4 * pre_dump_exit_rate + 0.2 * CASE WHEN avg_entry_timing_minutes <= -60 THEN 1 WHEN avg_entry_timing_minutes >= 60 THEN 0 ELSE 0.5 - avg_entry_timing_minutes / 120 END))
 + 0.35 * least(1, greatest(0, 0.4 * win_rate + 0.4 * CASE WHEN avg_roi <= 0 THEN 0 WHEN avg_roi >= 5 THEN 1 ELSE avg_roi / 6.25 END + 0.2 * CASE WHEN sharpe <= 0 THEN 0 WHEN sharpe >= 4 THEN 1 ELSE sharpe / 4 END))
 + 0.20 * least(1, greatest(0, 0.3 * least(1, dexes / 5) + 0.3 * gas + 0.4 * least(1, greatest(0, 0.5 + 0.2 * t_early::INT + 0.2 * t_diamond::INT - 0.1 * t_high::INT)))) - 0.5))) AS score, win_rate, total_trades FROM sg)
 SELECT token, wallet, round(score, 4) AS smart_money_score, round(win_rate, 4) AS win_rate, total_trades,
  CASE WHEN score >= 0.8 THEN 'very_high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_level FROM pr""", digits=4)
def _(t):
    return finder.wallet_profile(t.trades, t.prices).select("token", "wallet", "smart_money_score", "win_rate", "total_trades", "confidence_level")


