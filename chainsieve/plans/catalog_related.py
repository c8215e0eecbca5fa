"""Registered queries: related wallets, embeddings, lead-lag and market impact."""

from pyspark.sql import functions as F

from chainsieve.operators import graph as g
from chainsieve.operators import impact as im
from chainsieve.operators import related as r
from chainsieve.plans.catalog_timing import HOPS, MOVE
from chainsieve.plans.registry import query
from chainsieve.tables import as_of

HELD = """held AS (SELECT DISTINCT wallet, token FROM v_trades), mine AS (SELECT token FROM held WHERE wallet IN (FROM v_busiest)),
ov AS (SELECT h.wallet, count(*) AS overlap_count, string_agg(CAST(h.token AS VARCHAR), ',' ORDER BY h.token) AS toks FROM held h JOIN mine m ON h.token = m.token WHERE h.wallet NOT IN (FROM v_busiest) GROUP BY h.wallet HAVING count(*) >= 3),
ovl AS (SELECT ov.wallet, overlap_count, overlap_count / ((SELECT count(*) FROM held WHERE held.wallet = ov.wallet) + (SELECT count(*) FROM mine) - overlap_count) AS strength, toks FROM ov)"""
TEMP = """bz AS (SELECT * FROM v_trades WHERE wallet IN (FROM v_busiest)),
tc AS (SELECT o.wallet, count(DISTINCT b.trade_id) AS correlated_trades, (SELECT count(*) FROM bz) AS total_trades FROM bz b JOIN v_trades o ON o.token = b.token
  AND o.ts >= b.ts - INTERVAL 5 MINUTE AND o.ts <= b.ts + INTERVAL 5 MINUTE AND o.wallet <> b.wallet GROUP BY o.wallet)"""


@query("token_overlap", f"WITH {HELD} SELECT wallet, overlap_count, round(strength, 6) AS strength, toks AS common_tokens FROM ovl")
def _(t):
    return r.token_overlap(t.trades, t.busiest, shown=10).select("wallet", "overlap_count", "strength", F.array_join("common_tokens", ",").alias("common_tokens"))


TEMP_HOUR = TEMP.replace("5 MINUTE", "600 MINUTE")


@query("temporal_correlation", f"WITH {TEMP_HOUR} SELECT wallet, correlated_trades, total_trades, round(correlated_trades / total_trades, 6) AS strength FROM tc WHERE correlated_trades / total_trades > 0.1")
def _(t):
    return r.temporal_correlation(t.trades, t.busiest, minutes=600).drop("relationship_type")


@query("copies_wallet", """SELECT o.wallet AS copies_wallet, count(DISTINCT b.trade_id) AS correlated_trades FROM v_trades b JOIN v_trades o ON b.wallet IN (FROM v_busiest) AND o.token = b.token
  AND o.ts >= b.ts - INTERVAL 5 MINUTE AND o.ts <= b.ts AND o.wallet <> b.wallet GROUP BY o.wallet ORDER BY 2 DESC, 1 LIMIT 1""")
def _(t):
    return r.copies_wallet(t.trades, t.busiest)


COS = """tv AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 1),
sim AS (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, tv.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
  / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(tv.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS s FROM embeddings e, tv WHERE e.vec_id <> tv.vec_id)"""


def _vectors(t):
    return t.raw("embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").alias("vector"), "label")


@query("pattern_similarity", f"WITH {COS} SELECT vec_id AS wallet, round(s, 6) AS strength FROM sim WHERE s >= 0.1")
def _(t):
    v = _vectors(t)
    return r.pattern_similarity(v, v.orderBy("entity").limit(1), 0.1).select("wallet", "strength")


@query("nearest_snapshot", f"""WITH {COS} SELECT max_by(vec_id, (s, -vec_id)) AS wallet, round(max(s), 6) AS strength FROM sim WHERE s >= 0.05
 AND vec_id IN (SELECT vec_id FROM embeddings WHERE TIMESTAMP '2024-01-30 00:00:00' + to_hours(vec_id % 48) > TIMESTAMP '2024-01-31 00:00:00')""")
def _(t):
    v = _vectors(t)
    stored = v.withColumn("stored_ts", F.expr("TIMESTAMP '2024-01-29 00:00:00'") + F.expr("make_dt_interval(0, cast(entity % 48 as int))"))
    return r.nearest_snapshot(stored, v.orderBy("entity").limit(1), as_of(), 86400, 0.05)


EMB = """em AS (SELECT wallet, avg(CASE WHEN side = 'buy' THEN 1.0 ELSE 0.0 END) AS b, ln(1 + avg(amount_usd)) AS m, CAST(count(*) AS DOUBLE) AS n FROM v_trades GROUP BY wallet)"""


@query("behavior_embedding", f"WITH {EMB} SELECT wallet, round(b, 6) AS buy_share, round(1 - b, 6) AS sell_share, round(m, 6) AS log_size, n AS trades, 64 AS width FROM em")
def _(t):
    e = r.behavior_embedding(t.trades)
    return e.select("wallet", *[e.vector[i].alias(n) for i, n in enumerate(("buy_share", "sell_share", "log_size", "trades"))], F.size("vector").alias("width"))


@query("trade_sequence", """SELECT wallet, step, direction, round(size, 6) AS size, round(price, 6) AS price, round((step - 1) / n, 6) AS position FROM (
 SELECT wallet, row_number() OVER (PARTITION BY wallet ORDER BY ts, trade_id) AS step, CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END AS direction, ln(1 + amount_usd) AS size, price, count(*) OVER (PARTITION BY wallet) AS n FROM v_trades) WHERE step <= 100""")
def _(t):
    return r.trade_sequence(t.trades, length=100)


@query("related_wallets", f"""WITH {HELD}, {TEMP}, {HOPS}, {EMB}, me AS (SELECT * FROM em WHERE wallet IN (FROM v_busiest)),
 d1 AS (SELECT there AS wallet, min_by(amount_usd, (ts, trade_id, here)) AS amount FROM hop WHERE here IN (FROM v_busiest) AND there NOT IN (FROM v_busiest) GROUP BY there),
 d2 AS (SELECT there AS wallet, min_by(amount_usd, (ts, trade_id, here)) AS amount FROM hop WHERE here IN (SELECT wallet FROM d1) AND there NOT IN (FROM v_busiest) AND there NOT IN (SELECT wallet FROM d1) GROUP BY there),
 al AS (SELECT wallet, 'fund_transfer' AS k, least(1, amount / 10000) AS s, 0 AS p FROM (FROM d1 UNION ALL FROM d2)
  UNION ALL SELECT em.wallet, 'pattern_similarity', (em.b * me.b + (1 - em.b) * (1 - me.b) + em.m * me.m + em.n * me.n) / sqrt(em.b ** 2 + (1 - em.b) ** 2 + em.m ** 2 + em.n ** 2) / sqrt(me.b ** 2 + (1 - me.b) ** 2 + me.m ** 2 + me.n ** 2) AS s, -1 FROM em, me WHERE em.wallet <> me.wallet AND s >= 0.5
  UNION ALL SELECT wallet, 'token_overlap', strength, -2 FROM ovl UNION ALL SELECT wallet, 'temporal_correlation', correlated_trades / total_trades, -3 FROM tc WHERE correlated_trades / total_trades > 0.1)
 SELECT wallet, max_by(k, (s, p)) AS relationship_type, round(max(s), 6) AS strength FROM al GROUP BY wallet HAVING max(s) >= 0.5""")
def _(t):
    emb = r.behavior_embedding(t.trades).withColumnRenamed("wallet", "entity")
    me = emb.join(F.broadcast(t.busiest.withColumnRenamed("wallet", "entity")), "entity", "left_semi")
    return r.related_wallets(
        g.fund_flow_bfs(t.edges, t.busiest, min_amount=5.0), r.pattern_similarity(emb, me, 0.5), r.token_overlap(t.trades, t.busiest), r.temporal_correlation(t.trades, t.busiest))


IMPACT = MOVE + """, vt AS (SELECT token, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS total FROM v_trades GROUP BY token),
 rt AS (SELECT token, (max_by(price, ts) - min_by(price, ts)) / min_by(price, ts) AS r FROM v_prices GROUP BY token),
 wv AS (SELECT token, wallet, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS v, least(1, avg(abs(move) * ln(1 + amount_usd))) AS influence FROM mv GROUP BY token, wallet),
 ip AS (SELECT wv.token, wallet, v / total AS volume_contribution, influence AS price_influence, r * (1 - v / total) AS counterfactual_returns FROM wv JOIN vt ON vt.token = wv.token JOIN rt ON rt.token = wv.token)"""


@query("counterfactual_impact", f"""WITH {IMPACT} SELECT token, wallet, round(volume_contribution, 4) AS volume_contribution, round(price_influence, 4) AS price_influence, round(counterfactual_returns, 4) AS counterfactual_returns,
 round(least(1, 0.4 * volume_contribution + 0.4 * price_influence + 0.2 * abs(counterfactual_returns)), 4) AS impact_score FROM ip""", digits=4)
def _(t):
    return im.counterfactual_impact(t.trades, t.prices).drop("interpretation")


@query("impact_bands", f"""WITH {IMPACT}, s AS (SELECT least(1, 0.4 * volume_contribution + 0.4 * price_influence + 0.2 * abs(counterfactual_returns)) AS x FROM ip)
 SELECT CASE WHEN x < 0.1 THEN 'Negligible market impact. Wallet is a price taker.' WHEN x < 0.3 THEN 'Low market impact. Minor influence on price movements.'
  WHEN x < 0.6 THEN 'Moderate market impact. Significant player in this token.' ELSE 'High market impact. Wallet likely moves the market.' END AS interpretation, count(*) AS wallets FROM s GROUP BY 1""")
def _(t):
    return im.counterfactual_impact(t.trades, t.prices).groupBy("interpretation").agg(F.count(F.lit(1)).alias("wallets"))


LEAD = """sp AS (SELECT token, min(ts) AS a, max(ts) AS b FROM v_prices GROUP BY token),
 pg AS (SELECT p.token, CAST(floor((epoch_us(p.ts) - epoch_us(a)) / 3600000000.0) AS BIGINT) AS bin, price FROM v_prices p JOIN sp ON sp.token = p.token),
 wb AS (SELECT t.token, t.wallet, CAST(floor((epoch_us(t.ts) - epoch_us(a)) / 3600000000.0) AS BIGINT) AS bin, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS v FROM v_trades t JOIN sp ON sp.token = t.token
   WHERE t.ts >= a AND floor((epoch_us(t.ts) - epoch_us(a)) / 3600000000.0) <= floor((epoch_us(b) - epoch_us(a)) / 3600000000.0) GROUP BY 1, 2, 3),
 ch AS (SELECT g.token, g.bin, CASE WHEN q.price > 0 THEN (g.price - q.price) / q.price ELSE 0 END AS y FROM pg g LEFT JOIN pg q ON q.token = g.token AND q.bin = g.bin - 1),
 full_y AS (SELECT s.token, x.bin, coalesce(ch.y, 0) AS y FROM sp s, LATERAL (SELECT unnest(generate_series(0, CAST(floor((epoch_us(s.b) - epoch_us(s.a)) / 3600000000.0) AS BIGINT))) AS bin) x LEFT JOIN ch ON ch.token = s.token AND ch.bin = x.bin),
 ws AS (SELECT DISTINCT token, wallet FROM wb),
 pr AS (SELECT w.token, w.wallet, k.lag, corr(coalesce(wb.v, 0), f.y) AS c, count(*) AS n FROM ws w JOIN full_y f ON f.token = w.token CROSS JOIN (SELECT unnest([1, 2, 3]) AS lag) k
   LEFT JOIN wb ON wb.token = w.token AND wb.wallet = w.wallet AND wb.bin = f.bin - k.lag WHERE f.bin >= k.lag GROUP BY 1, 2, 3)
"""


@query("lead_lag", f"WITH {LEAD} SELECT token, wallet, lag, round(c, 4) AS correlation FROM pr", digits=4)
def _(t):
    return im.lead_lag(t.trades, t.prices, minutes=60, max_lag=3).select("token", "wallet", "lag", "correlation")


@query("lead_lag_best", f"""WITH {LEAD}, fs AS (SELECT *, c * c / (1 - c * c) * (n - 2) AS f FROM pr WHERE c IS NOT NULL AND NOT isnan(c) AND c * c < 1 AND n > 2 AND n + lag >= 13)
 SELECT token, wallet, lag AS optimal_lag, round(f, 4) AS f_stat, round(c, 4) AS correlation, f > 3.84 AS has_causality, round(CASE WHEN f > 3.84 THEN c * c ELSE 0 END, 4) AS lead_score
 FROM fs QUALIFY row_number() OVER (PARTITION BY token, wallet ORDER BY f DESC, lag) = 1""", digits=4)
def _(t):
    return im.best_lead(im.lead_lag(t.trades, t.prices, minutes=60, max_lag=3))
