"""Registered queries: outcome labels and exits."""

from pyspark.sql import functions as F

from chainsieve.operators import labels as lb
from chainsieve.plans.registry import query
from chainsieve.sources import writers

LAB = """el AS (SELECT token, ts, price FROM v_prices WHERE liquidity_usd >= 50000 AND volume_24h >= 10000),
hz(horizon, hh) AS (VALUES ('24h', 24), ('7d', 168), ('30d', 720)), ml(multiplier, mm) AS (VALUES ('2x', 2), ('5x', 5), ('10x', 10), ('20x', 20), ('50x', 50)),
pt AS (SELECT el.token, el.ts, el.price, horizon, hh, multiplier, mm FROM el, hz, ml),
fh AS (SELECT pt.token, pt.ts, pt.horizon, pt.multiplier, any_value(pt.price * mm) AS goal, any_value(hh) AS hh, min(p.ts) FILTER (WHERE p.price >= pt.price * mm AND p.liquidity_usd >= 50000) AS hit
  FROM pt JOIN v_prices p ON p.token = pt.token AND p.ts >= pt.ts AND p.ts <= pt.ts + to_hours(hh) GROUP BY 1, 2, 3, 4),
su AS (SELECT fh.token, fh.ts, fh.horizon, fh.multiplier, bool_and(p.price >= goal AND p.liquidity_usd >= 50000) AS held FROM fh JOIN v_prices p ON p.token = fh.token AND p.ts >= hit AND p.ts <= least(hit + INTERVAL 1 HOUR, fh.ts + to_hours(hh)) GROUP BY 1, 2, 3, 4),
mx AS (SELECT el.token, el.ts, horizon, max(p.price) AS max_price, max_by(p.liquidity_usd, p.ts) AS final_liquidity FROM el, hz, v_prices p WHERE p.token = el.token AND p.ts >= el.ts AND p.ts <= el.ts + to_hours(hh) GROUP BY 1, 2, 3),
ls AS (SELECT token, max(ts) AS last_ts FROM v_prices GROUP BY token),
lab AS (SELECT fh.token, fh.ts, fh.horizon, fh.multiplier, coalesce(held, false) AS reached, CASE WHEN held THEN (epoch_us(hit) - epoch_us(fh.ts)) / 3600000000.0 END AS time_hours, false AS censored,
  NOT coalesce(held, false) AND last_ts < fh.ts + to_hours(hh) AS censored_strict, max_price, final_liquidity
  FROM fh LEFT JOIN su ON su.token = fh.token AND su.ts = fh.ts AND su.horizon = fh.horizon AND su.multiplier = fh.multiplier
  JOIN mx ON mx.token = fh.token AND mx.ts = fh.ts AND mx.horizon = fh.horizon JOIN ls ON ls.token = fh.token)"""


@query("outcome_labels", f"WITH {LAB} SELECT token, ts, horizon, multiplier, reached, round(time_hours, 6) AS time_hours, censored, censored_strict, round(max_price, 6) AS max_price, final_liquidity FROM lab")
def _(t):
    return lb.outcome_labels(t.prices)


@query("outcome_window_extremes", f"WITH {LAB} SELECT token, ts, horizon, round(max_price, 6) AS max_price, final_liquidity FROM mx")
def _(t):
    ok = (F.col("p.liq") >= 50000) & (F.col("p.vol") >= 10000)
    return lb.horizon_extremes(t.prices, start=ok).select("token", F.timestamp_micros("us").alias("ts"), "horizon", "max_price", "final_liquidity")


@query("label_quality", f"""WITH {LAB} SELECT horizon, multiplier, count(*) AS total_samples, count(*) FILTER (WHERE reached) AS num_reached, round(avg(reached::INT), 6) AS hit_rate, count(*) FILTER (WHERE censored_strict) AS num_censored,
 round(avg(censored_strict::INT), 6) AS censoring_rate, round(avg(time_hours), 6) AS avg_time_hours, round(min(time_hours), 6) AS min_time_hours, round(max(time_hours), 6) AS max_time_hours FROM lab GROUP BY 1, 2""")
def _(t):
    return lb.label_quality(lb.outcome_labels(t.prices))


@query("training_join", f"""WITH {LAB}, fe AS (SELECT token, count(*) AS trades FROM v_trades GROUP BY token) SELECT lab.token, ts, any_value(trades) AS trades, bool_or(horizon = '24h' AND multiplier = '2x' AND reached) AS "24h_2x",
 round(max(time_hours) FILTER (WHERE horizon = '7d' AND multiplier = '5x'), 6) AS "7d_5x_time", bool_or(horizon = '30d' AND multiplier = '10x' AND reached) AS "30d_10x", false AS "24h_2x_censored" FROM lab JOIN fe ON fe.token = lab.token GROUP BY 1, 2""")
def _(t):
    feats = t.trades.groupBy("token").agg(F.count(F.lit(1)).alias("trades"))
    return lb.training_join(lb.outcome_labels(t.prices), feats).select("token", "ts", "trades", "24h_2x", "7d_5x_time", "30d_10x", "24h_2x_censored")


@query("export_outcomes", f"WITH {LAB} SELECT token, ts, count(*) FILTER (WHERE reached) AS reached, count(*) AS cells FROM lab GROUP BY 1, 2")
def _(t):
    nested = writers.nest_outcomes(lb.outcome_labels(t.prices))
    flat = F.flatten(F.transform(F.map_values("labels"), lambda m: F.map_values(m)))
    return nested.select(F.col("token_address").cast("int").alias("token"), F.col("timestamp").alias("ts"), F.size(F.filter(flat, lambda x: x)).cast("bigint").alias("reached"), F.size(flat).cast("bigint").alias("cells"))


@query("exit_rule", """WITH c AS (SELECT e.token, e.ts AS entry_ts, e.price AS entry_price, p.ts, p.price, (p.price - e.price) / e.price AS ch FROM v_prices e JOIN v_prices p ON p.token = e.token AND p.ts > e.ts
  WHERE p.price >= 10 * e.price OR p.price <= 0.5 * e.price OR p.ts > e.ts + INTERVAL 7 DAY),
 f AS (SELECT token, entry_ts, any_value(entry_price) AS entry_price, min(ts) AS exit_ts, min_by(price, ts) AS exit_price FROM c GROUP BY 1, 2)
 SELECT e.token, e.ts AS entry_ts, round(e.price, 6) AS entry_price, exit_ts, round(exit_price, 6) AS exit_price,
  CASE WHEN exit_price >= 10 * e.price THEN 'take_profit' WHEN exit_price <= 0.5 * e.price THEN 'stop_loss' WHEN exit_ts IS NOT NULL THEN 'max_hold' END AS reason
 FROM v_prices e LEFT JOIN f ON f.token = e.token AND f.entry_ts = e.ts""")
def _(t):
    out = lb.exit_points(t.prices)
    # A point past the holding time may also have crossed a price level.
    kind = (F.when(F.col("exit_price") >= 10 * F.col("entry_price"), "take_profit").when(F.col("exit_price") <= 0.5 * F.col("entry_price"), "stop_loss").otherwise(F.col("reason")))
    return out.withColumn("reason", kind)
