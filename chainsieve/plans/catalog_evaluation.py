"""Registered queries: prediction quality, splits, drift, strategy rules and the model ledger."""

import uuid

from pyspark.sql import functions as F

from chainsieve.operators import drift as dr
from chainsieve.operators import evaluation as ev
from chainsieve.operators import ledger as lg
from chainsieve.operators import strategy as st
from chainsieve.operators.matching import fifo_match
from chainsieve.operators.ordered import rank_desc, time_slice
from chainsieve.operators.wallet import rank_wallets, wallet_metrics
from chainsieve.plans.registry import query
from chainsieve.session import checkpoint_dir
from chainsieve.sources import writers
from chainsieve.tables import as_of, money

HM = ["horizon", "multiplier"]
UP, LOW = "CAST(ceil(probability * 10) - 1 AS INT)", "CAST(least(floor(probability * 10), 9) AS INT)"


def _binned(bin_, keys="horizon, multiplier"):
    return f"bn AS (SELECT {keys}, {bin_} AS bin, count(*) AS n, avg(probability) AS p, avg(outcome) AS y FROM v_predictions GROUP BY ALL)"


@query("hit_rates", "SELECT CAST(floor(probability * 10) AS INT) AS bucket, round(avg(outcome), 6) AS hit_rate, round(avg(probability), 6) AS avg_predicted, count(*) AS count FROM v_predictions GROUP BY 1")
def _(t):
    return ev.hit_rates(t.predictions)


@query("ece_upper", f"WITH {_binned(UP)} SELECT horizon, multiplier, round(sum(n * abs(y - p)) / sum(n), 6) AS ece FROM bn GROUP BY 1, 2")
def _(t):
    return ev.expected_calibration_error(t.predictions, HM)


@query("calibration_curve", f"WITH {_binned(UP)} SELECT horizon, multiplier, round(bin / 10, 6) AS bin_lower, round((bin + 1) / 10, 6) AS bin_upper, round(p, 6) AS predicted, round(y, 6) AS actual, n AS count FROM bn")
def _(t):
    return ev.calibration_curve(t.predictions, HM)


@query("ece_lower", f"WITH {_binned(LOW)} SELECT horizon, multiplier, round(sum(n * abs(y - p)) / sum(n), 6) AS ece FROM bn GROUP BY 1, 2")
def _(t):
    return ev.expected_calibration_error(t.predictions, HM, upper=False)


@query("calibration_gap", f"WITH {_binned(LOW)} SELECT horizon, multiplier, round(avg(abs(y - p)), 6) AS calibration_error FROM bn GROUP BY 1, 2")
def _(t):
    return ev.calibration_gap(t.predictions, HM)


@query("brier_log_loss", """SELECT horizon, multiplier, round(avg((probability - outcome) ** 2), 6) AS brier_score,
 round(avg(-(outcome * ln(probability) + (1 - outcome) * ln(1 - probability))), 6) AS log_loss FROM v_predictions GROUP BY 1, 2""")
def _(t):
    return ev.probability_losses(t.predictions, HM)


AUC = """au AS (SELECT horizon, multiplier, (sum(mr) FILTER (WHERE outcome = 1) - sum(outcome) * (sum(outcome) + 1) / 2.0) / (sum(outcome) * (count(*) - sum(outcome))) AS auc_roc FROM (
  SELECT horizon, multiplier, outcome, rank() OVER (PARTITION BY horizon, multiplier ORDER BY probability) + (count(*) OVER (PARTITION BY horizon, multiplier, probability) - 1) / 2.0 AS mr FROM v_predictions) GROUP BY 1, 2)"""


@query("auc_roc", f"WITH {AUC} SELECT horizon, multiplier, round(auc_roc, 6) AS auc_roc FROM au")
def _(t):
    return ev.auc_roc(t.predictions, HM)


def _metrics_sql(rows, keys):
    ks = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    on = "ON " + " AND ".join(f"c.{k} = e.{k}" for k in keys.split(", ")) if keys else "ON true"
    cs = ", ".join(f"c.{k}" for k in keys.split(", ")) + ", " if keys else ""
    return f"""cf AS (SELECT {ks}count(*) AS n, count(*) FILTER (WHERE (probability > 0.5) = (outcome = 1)) AS ok, count(*) FILTER (WHERE probability > 0.5 AND outcome = 1) AS tp,
  count(*) FILTER (WHERE probability > 0.5 AND outcome = 0) AS fp, count(*) FILTER (WHERE probability <= 0.5 AND outcome = 1) AS fn FROM {rows} {group}),
 eb AS (SELECT {ks}{UP} AS bin, count(*) AS n, avg(probability) AS p, avg(outcome) AS y FROM {rows} GROUP BY ALL), ec AS (SELECT {ks}sum(n * abs(y - p)) / sum(n) AS ece FROM eb {group})
 SELECT {cs}c.n AS num_samples, round(ok / c.n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1_score, round(ece, 6) AS ece FROM cf c JOIN ec e {on}"""


@query("classification_metrics", f"WITH {_metrics_sql('v_predictions', 'horizon, multiplier')}")
def _(t):
    return ev.classification_metrics(t.predictions, HM)


@query("threshold_precision", """SELECT horizon, multiplier, round(avg(outcome) FILTER (WHERE probability >= 0.3), 6) AS precision_30, round(avg(outcome) FILTER (WHERE probability >= 0.5), 6) AS precision_50,
 round(avg(outcome) FILTER (WHERE probability >= 0.7), 6) AS precision_70 FROM v_predictions GROUP BY 1, 2""")
def _(t):
    return ev.threshold_precision(t.predictions, HM)


@query("evaluate_calibration", f"""WITH {_binned(LOW)}, x AS (SELECT horizon, multiplier, sum(n * abs(y - p)) / sum(n) AS ece FROM bn GROUP BY 1, 2), br AS (SELECT horizon, multiplier, avg((probability - outcome) ** 2) AS b FROM v_predictions GROUP BY 1, 2)
 SELECT x.horizon, x.multiplier, round(ece, 6) AS ece, round(b, 6) AS brier_score FROM x JOIN br ON x.horizon = br.horizon AND x.multiplier = br.multiplier""")
def _(t):
    return ev.evaluate_calibration(t.predictions)


def _ranked(t):
    c = fifo_match(t.trades).groupBy("token", "wallet").agg(F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return rank_desc(c, ["token"], "win_rate", "wallet", "rank")


PK = """rk AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY win_rate DESC, wallet) AS rank, count(*) OVER (PARTITION BY token) AS n FROM (
  SELECT token, wallet, sum(pnl) AS pnl, avg((pnl > 0)::INT) AS win_rate FROM v_closed GROUP BY 1, 2)), ks(k) AS (VALUES (5), (10), (20), (50), (100))"""


@query("precision_at_k_score", f"WITH {PK} SELECT token, k, round(avg((win_rate > 0.6)::INT), 6) AS precision FROM rk JOIN ks ON rank <= k AND k <= n GROUP BY 1, 2")
def _(t):
    return ev.precision_at_k(_ranked(t), F.col("win_rate") > 0.6)


@query("precision_at_k_realized", f"WITH {PK} SELECT token, k, round(avg((pnl > 0)::INT), 6) AS precision FROM rk JOIN ks ON rank <= k AND k <= n GROUP BY 1, 2")
def _(t):
    return ev.precision_at_k(_ranked(t), F.col("pnl") > 0)


# ---------------------------------------------------------------- splits
@query("walk_forward_splits", """WITH sp AS (SELECT token, min(ts) AS a, max(ts) AS b FROM v_trades GROUP BY token)
 SELECT token, CAST(i AS INT) AS split, a + to_days(CAST(3 * i AS INT)) AS train_start, a + to_days(CAST(3 * i + 7 AS INT)) AS train_end, a + to_days(CAST(3 * i + 7 AS INT)) AS test_start, a + to_days(CAST(3 * i + 10 AS INT)) AS test_end
 FROM sp, range(0, 100) r(i) WHERE a + to_days(CAST(3 * i + 10 AS INT)) <= b""")
def _(t):
    spans = t.trades.groupBy("token").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return ev.calendar_splits(spans, 7, 3, 3)


def _index_sql(expanding):
    lo = "0" if expanding else "greatest(0, ts0 - 7 - 2 * size)"
    return f"""WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts, trade_id) - 1 AS i, count(*) OVER () AS n FROM v_trades), f AS (SELECT r.*, k, n // 6 AS size, n - (5 - k) * (n // 6) AS ts0 FROM r, range(0, 5) x(k)),
 p AS (SELECT k, ts, CASE WHEN i >= ts0 AND i < least(ts0 + size, n) THEN 'test' WHEN i >= {lo} AND i < ts0 - 7 THEN 'train' END AS role FROM f)
 SELECT CAST(k AS INT) AS split, role, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM p WHERE role IS NOT NULL GROUP BY 1, 2"""


@query("index_splits_expanding", _index_sql(True))
def _(t):
    return ev.index_splits(t.trades, ["ts", "trade_id"], gap=7)


@query("index_splits_sliding", _index_sql(False))
def _(t):
    return ev.index_splits(t.trades, ["ts", "trade_id"], gap=7, expanding=False)


WF = """bo AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM v_predictions), wn AS (SELECT t0 + to_days(CAST(90 + 30 * k AS INT)) AS s FROM bo, range(0, 400) r(k) WHERE t0 + to_days(CAST(90 + 30 * k AS INT)) < t1),
 gd AS (SELECT s FROM wn WHERE EXISTS (SELECT 1 FROM v_predictions p WHERE p.ts >= s - INTERVAL 90 DAY AND p.ts < s)), wx AS (SELECT p.* FROM v_predictions p JOIN gd ON p.ts >= s AND p.ts < s + INTERVAL 30 DAY)"""


@query("walk_forward_eval", f"WITH {WF}, {_metrics_sql('wx', 'horizon')}")
def _(t):
    return ev.walk_forward_eval(t.predictions, keys=["horizon"])


# ---------------------------------------------------------------- running quality and ensembles
def _history(t):
    return t.trades.select(F.col("dex").alias("model"), "ts", F.col("trade_id").alias("seq"), F.col("amount_usd").alias("performance"), (F.col("trade_id") % 20000).alias("samples_since_retrain"))


HIST = "hi AS (SELECT dex AS model, ts, amount_usd AS performance, trade_id % 20000 AS smp, row_number() OVER (PARTITION BY dex ORDER BY ts DESC, trade_id DESC) AS back FROM v_trades)"


@query("performance_trend", f"""WITH {HIST} SELECT model, max(performance) FILTER (WHERE back = 1) AS current, round(avg(performance), 6) AS mean, round(stddev_pop(performance), 6) AS std, min(performance) AS min, max(performance) AS max,
 CASE WHEN max(performance) FILTER (WHERE back = 1) > avg(performance) FILTER (WHERE back > 1) THEN 'improving' ELSE 'degrading' END AS trend FROM hi WHERE back <= 10 GROUP BY model""")
def _(t):
    return ev.performance_trend(_history(t))


@query("needs_retrain", f"""WITH {HIST}, x AS (SELECT model, max(performance) FILTER (WHERE back = 1) < 0.9 * avg(performance) FILTER (WHERE back > 1) AS dropped, max(smp) FILTER (WHERE back = 1) >= 10000 AS too_many_samples FROM hi WHERE back <= 11 GROUP BY model)
 SELECT *, dropped OR too_many_samples AS retrain FROM x""")
def _(t):
    return ev.needs_retrain(_history(t))


@query("update_due", """SELECT wallet, wallet % 3 = 0 AS is_daily, coalesce((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 86400000000.0 >= CASE WHEN wallet % 3 = 0 THEN 1 WHEN wallet % 3 = 1 THEN 7 END, false) AS due FROM v_trades GROUP BY wallet""")
def _(t):
    k = F.col("wallet") % 3
    state = t.trades.groupBy("wallet").agg(F.max("ts").alias("last_update")).withColumn("schedule", F.when(k == 0, "daily").when(k == 1, "weekly").otherwise("manual"))
    return ev.update_due(state, as_of()).select("wallet", (k == 0).alias("is_daily"), "due")


@query("recency_weights", """SELECT wallet, trade_id, round(w / sum(w) OVER (PARTITION BY wallet), 9) AS weight FROM (SELECT wallet, trade_id, 0.99 ** (row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, trade_id DESC) - 1) AS w FROM v_trades)""", digits=9)
def _(t):
    return ev.recency_weights(t.trades.select("wallet", "ts", "trade_id"), ["wallet"], ["ts", "trade_id"], time_slice("ts")).select("wallet", "trade_id", "weight")


def _model_outputs(t):
    k = F.col("trade_id")
    made = F.array(*[F.struct(F.lit(m).alias("model"), (k % d / float(d)).alias("prediction")) for m, d in (("booster", 17), ("forest", 23), ("linear", 31))])
    return t.trades.select(k.alias("row_id"), F.explode(made).alias("m")).select("row_id", "m.*")


WEIGHTS = {"booster": 0.5, "forest": 0.3, "linear": 0.2}


@query("ensemble_predict", """WITH m AS (SELECT trade_id AS row_id, trade_id % 17 / 17 AS a, trade_id % 23 / 23 AS b, trade_id % 31 / 31 AS c FROM v_trades)
 SELECT row_id, round(0.5 * a + 0.3 * b + 0.2 * c, 6) AS prediction, round(1 / (1 + (a * a + b * b + c * c) / 3 - ((a + b + c) / 3) ** 2), 6) AS confidence, round(0.5 * a, 6) AS booster_part, round(0.2 * c, 6) AS linear_part FROM m""")
def _(t):
    e = ev.ensemble_predict(_model_outputs(t), WEIGHTS)
    part = lambda m: F.try_element_at("contributions", F.lit(m))
    return e.select("row_id", "prediction", "confidence", part("booster").alias("booster_part"), part("linear").alias("linear_part"))


@query("ensemble_weights", """WITH e AS (SELECT trade_id AS step, abs(trade_id % 17 / 17 - trade_id % 5 / 5) AS a, abs(trade_id % 23 / 23 - trade_id % 5 / 5) AS b, abs(trade_id % 31 / 31 - trade_id % 5 / 5) AS c FROM v_trades),
 p AS (SELECT step, 1 / (avg(a) OVER w + 1e-6) AS a, 1 / (avg(b) OVER w + 1e-6) AS b, 1 / (avg(c) OVER w + 1e-6) AS c FROM e WINDOW w AS (ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
 l AS (SELECT list([a / (a + b + c), b / (a + b + c), c / (a + b + c)] ORDER BY step) AS ts FROM p),
 f AS (SELECT list_reduce(list_prepend([1 / 3, 1 / 3, 1 / 3], ts), lambda s, x: list_transform([greatest(0.05, 0.9 * s[1] + 0.1 * x[1]), greatest(0.05, 0.9 * s[2] + 0.1 * x[2]), greatest(0.05, 0.9 * s[3] + 0.1 * x[3])],
   lambda v: v / (greatest(0.05, 0.9 * s[1] + 0.1 * x[1]) + greatest(0.05, 0.9 * s[2] + 0.1 * x[2]) + greatest(0.05, 0.9 * s[3] + 0.1 * x[3])))) AS w FROM l)
 SELECT unnest(['booster', 'forest', 'linear']) AS model, round(unnest(w), 6) AS weight FROM f""")
def _(t):
    truth = F.col("row_id") % 5 / 5.0
    errors = _model_outputs(t).select(F.col("row_id").alias("step"), "model", F.abs(F.col("prediction") - truth).alias("error"))
    return ev.ensemble_weights(errors, list(WEIGHTS))


@query("refresh_interval", """SELECT wallet, CASE WHEN count(*) < 2 THEN 300 ELSE CAST(greatest(60, least(3600, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 / (count(*) - 1) * 0.5))) AS BIGINT) END AS ttl_seconds
 FROM (SELECT wallet, ts, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC) AS back FROM v_trades) WHERE back <= 10 GROUP BY wallet""")
def _(t):
    return ev.refresh_interval(t.trades, "wallet")


# ---------------------------------------------------------------- drift
SPLIT = "2024-01-16 00:00:00"
DRIFT_NAMES = ["amount_usd", "price", "gas_price"]


def _drift_rows(t):
    later = F.when(F.col("ts") >= F.lit(SPLIT).cast("timestamp"), 1.0).otherwise(0.0)
    return t.trades.select(
        "token", (later == 0).alias("is_reference"), "amount_usd", (F.col("price") + later * F.col("token") / 2.0).alias("price"), "gas_price", (F.col("token_age_hours") / 72.0).alias("prediction"),
        (F.when(F.col("side") == "buy", 1.0).otherwise(0.0) - later * F.col("token") / 40.0).alias("performance"))


DRIFT = f"""dw AS (SELECT token, ts < TIMESTAMP '{SPLIT}' AS ref, amount_usd, price + CASE WHEN ts >= TIMESTAMP '{SPLIT}' THEN token / 2 ELSE 0 END AS price, gas_price, token_age_hours / 72 AS prediction,
  (side = 'buy')::INT - CASE WHEN ts >= TIMESTAMP '{SPLIT}' THEN token / 40 ELSE 0 END AS performance FROM v_trades),
 dl AS (SELECT token, ref, feature, value FROM dw UNPIVOT (value FOR feature IN (amount_usd, price, gas_price, prediction))),
 dc AS (SELECT token, feature, value, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM dl GROUP BY 1, 2, 3),
 dn AS (SELECT token, feature, sum(r) OVER o / sum(r) OVER a AS fr, sum(c) OVER o / sum(c) OVER a AS fc, sum(r) OVER a AS nr, sum(c) OVER a AS nc FROM dc
   WINDOW o AS (PARTITION BY token, feature ORDER BY value), a AS (PARTITION BY token, feature)),
 ks AS (SELECT token, feature, max(abs(fr - fc)) AS d, CAST(max(nr) AS BIGINT) AS nr, CAST(max(nc) AS BIGINT) AS nc, sqrt(max(nr) * max(nc) / (max(nr) + max(nc))) * max(abs(fr - fc)) AS t FROM dn GROUP BY 1, 2),
 kp AS (SELECT *, CASE WHEN t < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * t * t))))) END AS p FROM ks)"""


@query("ks_distance", f"WITH {DRIFT} SELECT token, feature, round(d, 6) AS statistic, nr AS n_reference, nc AS n_current, round(p, 6) AS p_value FROM kp")
def _(t):
    return dr.feature_drift(dr.long_features(_drift_rows(t), ["token"], [*DRIFT_NAMES, "prediction"], ["is_reference"]), ["token"])


@query("drift_report", f"""WITH {DRIFT}, fs AS (SELECT token, list_sort(list(feature) FILTER (WHERE p < 0.05 AND feature <> 'prediction')) AS af, max(1 - p) AS cf, bool_or(p < 0.05 AND feature = 'prediction') AS pd FROM kp GROUP BY token),
 pf AS (SELECT token, avg(performance) FILTER (WHERE NOT ref) - avg(performance) FILTER (WHERE ref) AS pc, count(*) FILTER (WHERE ref) >= 100 AND count(*) FILTER (WHERE NOT ref) >= 50 AS enough FROM dw GROUP BY token),
 x AS (SELECT pf.token, enough, pc, coalesce(af, []) AS af, cf, pd, enough AND (coalesce(len(af), 0) > 0 OR pd OR pc < -0.05) AS det FROM pf JOIN fs ON fs.token = pf.token)
 SELECT token, det AS drift_detected, CASE WHEN NOT det THEN 'none' WHEN pc < -0.10 OR len(af) > 1.5 THEN 'sudden' ELSE 'gradual' END AS drift_type, round(CASE WHEN enough THEN greatest(cf, least(abs(pc) / 0.05, 1)) ELSE 0 END, 6) AS confidence,
  array_to_string(CASE WHEN enough THEN af ELSE [] END, ',') AS affected_features, round(CASE WHEN enough THEN pc END, 6) AS performance_change FROM x""")
def _(t):
    return dr.drift_report(_drift_rows(t), ["token"], DRIFT_NAMES).withColumn("affected_features", F.array_join("affected_features", ","))


@query("drift_summary", """WITH r AS (SELECT token, ts, amount_usd > 50 AS d, CASE WHEN trade_id % 3 = 0 THEN 'sudden' ELSE 'gradual' END AS k, amount_usd / 1000 AS c, row_number() OVER (PARTITION BY token ORDER BY ts DESC) AS back FROM v_trades),
 g AS (SELECT token, count(*) AS n, count(*) FILTER (WHERE d) AS hits, count(*) FILTER (WHERE d AND k = 'gradual') AS g, count(*) FILTER (WHERE d AND k = 'sudden') AS s, avg(c) FILTER (WHERE d) AS c, max(ts) AS last FROM r WHERE back <= 20 GROUP BY token)
 SELECT token, n AS total_reports, hits AS drift_count, round(hits / n, 6) AS drift_rate, CASE WHEN hits = 0 THEN 'none' WHEN g >= s THEN 'gradual' ELSE 'sudden' END AS most_common_type, round(coalesce(c, 0), 6) AS avg_confidence, CASE WHEN hits > 0 THEN last END AS last_drift FROM g""")
def _(t):
    reports = t.trades.select("token", "ts", (F.col("amount_usd") > 50).alias("drift_detected"), F.when(F.col("trade_id") % 3 == 0, "sudden").otherwise("gradual").alias("drift_type"), (F.col("amount_usd") / 1000.0).alias("confidence"))
    return dr.drift_summary(reports, ["token"])


@query("page_hinkley", """WITH n AS (SELECT token, ts, price, row_number() OVER (PARTITION BY token ORDER BY ts, trade_id) AS i FROM v_trades), m AS (SELECT token, avg(price) AS mu FROM n WHERE i <= 30 GROUP BY token),
 c AS (SELECT n.token, i, sum(price - mu - 0.005) OVER (PARTITION BY n.token ORDER BY i) AS cs FROM n JOIN m ON m.token = n.token WHERE i > 30), l AS (SELECT token, i, cs - least(0, min(cs) OVER (PARTITION BY token ORDER BY i)) > 50 AS o FROM c)
 SELECT token, coalesce(bool_or(o), false) AS alarm, min(i) FILTER (WHERE o) AS first_alarm_row FROM l GROUP BY token""")
def _(t):
    return dr.page_hinkley(t.trades.select("token", "ts", "trade_id", F.col("price").alias("value")), ["token"], ["ts", "trade_id"], time_slice("ts"))


# ---------------------------------------------------------------- strategies
@query("equity_metrics", """WITH c AS (SELECT wallet, exit_ts, 10000 + sum(pnl) OVER (PARTITION BY wallet ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS v, trade_id FROM v_closed),
 s AS (SELECT wallet, exit_ts, v, greatest(10000, max(v) OVER w) AS pk, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY wallet ORDER BY exit_ts, trade_id)), r AS (SELECT *, CASE WHEN pv > 0 THEN (v - pv) / pv WHEN pv IS NOT NULL THEN 0 END AS ret FROM s)
 SELECT wallet, round((max_by(v, exit_ts) - 10000) / 10000, 6) AS total_return, round(CASE WHEN count(ret) > 1 AND stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(252) ELSE 0 END, 4) AS sharpe_ratio,
  round(max((pk - v) / pk), 6) AS max_drawdown, round(max_by(v, exit_ts), 6) AS final_value FROM r GROUP BY wallet""")
def _(t):
    curve = st.capital_curve(fifo_match(t.trades), ["wallet"], time_slice("exit_ts")).select("wallet", F.col("exit_ts").alias("ts"), "value")
    return st.equity_metrics(curve, ["wallet"], time_slice("ts"), initial=10_000.0).withColumn("sharpe_ratio", F.round("sharpe_ratio", 4))


@query("closed_trade_metrics", """WITH c AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY wallet ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS v FROM v_closed), h AS (SELECT *, greatest(10000, max(v) OVER (PARTITION BY wallet ORDER BY exit_ts, trade_id)) AS pk FROM c)
 SELECT wallet, round(sum(pnl) / 10000, 4) AS total_return, round(sum(pnl), 4) AS total_pnl, count(*) AS num_trades, round(avg((pnl > 0)::INT), 4) AS win_rate, count(*) FILTER (WHERE pnl > 0) AS num_wins, count(*) FILTER (WHERE NOT pnl > 0) AS num_losses,
  round(avg(pnl), 4) AS avg_pnl, round(max(pnl), 4) AS best_trade, round(min(pnl), 4) AS worst_trade, round(CASE WHEN count(*) > 1 THEN avg(pnl / 10000) / (stddev_pop(pnl / 10000) + 1e-10) * sqrt(252) ELSE 0 END, 4) AS sharpe_ratio,
  round(max((pk - v) / pk), 4) AS max_drawdown, round(avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3600000000.0), 4) AS avg_hold_time_hours, round(sum(0.003 * (cost_basis_usd + sell_value_usd)), 4) AS total_fees_paid, round(sum(0.001 * (cost_basis_usd + sell_value_usd)), 4) AS total_slippage FROM h GROUP BY wallet""", digits=4)
def _(t):
    both = F.col("cost_basis_usd") + F.col("sell_value_usd")
    closed = fifo_match(t.trades).withColumn("fees_paid", 0.003 * both).withColumn("slippage_cost", 0.001 * both)
    return st.closed_trade_metrics(closed, ["wallet"], time_slice("exit_ts"))


@query("pair_signals_with_costs", """WITH s AS (SELECT token, wallet, trade_id, ts, side, price, lag(side) OVER w AS ps, lag(price) OVER w AS pp, lag(amount_tokens) OVER w AS pa, lag(ts) OVER w AS pt FROM v_trades WINDOW w AS (PARTITION BY token, wallet ORDER BY ts, trade_id))
 SELECT token, wallet, trade_id, pt AS entry_ts, ts AS exit_ts, pa AS amount, round(pp * 1.001, 10) AS entry_price, round(price * 0.999, 10) AS exit_price, round(pa * pp * 1.001 * 1.003, 10) AS cost, round(pa * price * 0.999 * 0.997, 10) AS proceeds,
  round(pa * price * 0.999 * 0.997 - pa * pp * 1.001 * 1.003, 10) AS pnl FROM s WHERE side = 'sell' AND ps = 'buy'""", digits=10)
def _(t):
    signals = t.trades.select("token", "wallet", "ts", "trade_id", "side", "price", F.col("amount_tokens").alias("amount"))
    return st.pair_signals_with_costs(signals, ["token", "wallet"], ["ts", "trade_id"], time_slice("ts"))


def _forecasts(t):
    h = F.floor(F.unix_seconds("ts") / 3600)
    return t.prices.select("token", "ts", (((h * 7 + F.col("token") * 31) % 97) / 97.0).alias("probability"), ((h * 3 + F.col("token") * 17) % 101).cast("double").alias("risk_score"), F.concat((2 + F.col("token") % 9).cast("string"), F.lit("x")).alias("multiplier"))


FC = """fc AS (SELECT token, ts, ((epoch_us(ts) // 3600000000) * 7 + token * 31) % 97 / 97 AS probability, CAST(((epoch_us(ts) // 3600000000) * 3 + token * 17) % 101 AS DOUBLE) AS risk_score, 2 + token % 9 AS m FROM v_prices)"""


@query("threshold_entries", f"WITH {FC} SELECT token, ts, round(probability, 6) AS probability FROM fc WHERE probability > 0.15")
def _(t):
    return st.threshold_entries(_forecasts(t)).select("token", "ts", "probability")


@query("top_n_entries", f"WITH {FC} SELECT token, ts, place FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY probability DESC, token) AS place FROM fc WHERE probability > 0.1) WHERE place <= 5")
def _(t):
    return st.top_n_entries(_forecasts(t)).select("token", "ts", "place")


@query("risk_adjusted_entries", f"WITH {FC} SELECT token, ts, round(probability / greatest(risk_score / 100, 0.01), 6) AS ratio FROM fc WHERE probability / greatest(risk_score / 100, 0.01) > 0.3")
def _(t):
    return st.risk_adjusted_entries(_forecasts(t)).select("token", "ts", "ratio")


@query("kelly_entries", f"WITH {FC}, k AS (SELECT *, ((m - 1) * probability - (1 - probability)) / (m - 1) AS kelly FROM fc) SELECT token, ts, round(kelly, 6) AS kelly, round(least(kelly * 0.25, 0.1), 6) AS position_share FROM k WHERE kelly > 0")
def _(t):
    return st.kelly_entries(_forecasts(t)).select("token", "ts", "kelly", "position_share")


@query("copy_trade_candidates", """WITH m AS (SELECT wallet, row_number() OVER (ORDER BY sum(pnl) DESC, wallet) AS rank FROM v_closed GROUP BY wallet), b AS (SELECT wallet FROM m WHERE rank <= 10)
 SELECT wallet, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS trades, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS volume_usd FROM v_trades WHERE wallet IN (SELECT wallet FROM b) GROUP BY 1, 2""")
def _(t):
    ranked = rank_wallets(wallet_metrics(fifo_match(t.trades), per_chain=False), "pnl")
    rows = st.copy_trade_candidates(ranked, t.trades)
    return rows.groupBy("wallet", "day").agg(F.count(F.lit(1)).alias("trades"), F.sum(money("amount_usd")).cast("double").alias("volume_usd"))


# ---------------------------------------------------------------- ledger
def model_versions(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    value = F.col("o_totalprice") / 1000.0
    return t.raw("orders").select(
        F.concat(F.lit("v"), k.cast("string")).alias("version_id"), F.concat(F.lit("model-"), c.cast("string")).alias("version_name"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.lit("").alias("notes"),
        F.when(c % 3 != 0, F.map_from_arrays(F.array(F.lit("sharpe_ratio"), F.lit("accuracy")), F.array(value, (k % 100 / 100.0)))).alias("backtest"),
        F.when(k % 2 == 0, F.map_from_arrays(F.array(F.lit("sharpe_ratio"), F.lit("total_return")), F.array(value / 2.0, (k % 7).cast("double")))).alias("strategy"))


MV = """mv AS (SELECT 'v' || o_orderkey AS version_id, 'model-' || o_custkey AS version_name, o_orderdate AS ts, o_orderstatus AS s, o_orderpriority AS p,
  CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / 1000 END AS bs, CASE WHEN o_custkey % 3 <> 0 THEN o_orderkey % 100 / 100 END AS ba, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2000 END AS ss, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END AS sr FROM orders)"""


@query("list_versions", f"WITH {MV} SELECT version_id, ts FROM mv WHERE s = 'F' OR p = '1-URGENT' ORDER BY ts DESC, version_id LIMIT 50")
def _(t):
    return lg.list_versions(model_versions(t), ["F", "1-URGENT"], 50).select("version_id", "ts")


@query("best_version", f"WITH {MV} SELECT version_id, round(coalesce(bs, ss), 6) AS metric_value FROM mv WHERE s = 'O' AND coalesce(bs, ss) IS NOT NULL ORDER BY coalesce(bs, ss) DESC, ts DESC, version_id LIMIT 1")
def _(t):
    return lg.best_version(model_versions(t), "sharpe_ratio", ["O"]).select("version_id", "metric_value")


@query("compare_versions", f"""WITH {MV} SELECT version_id, 'sharpe_ratio' AS metric, round(coalesce(ss, bs), 6) AS value FROM mv WHERE coalesce(ss, bs) IS NOT NULL UNION ALL SELECT version_id, 'accuracy', round(ba, 6) FROM mv WHERE ba IS NOT NULL
 UNION ALL SELECT version_id, 'total_return', sr FROM mv WHERE sr IS NOT NULL""")
def _(t):
    return lg.compare_versions(model_versions(t)).drop("version_name")


@query("metric_history", f"WITH {MV} SELECT ts, round(coalesce(bs, ss), 6) AS metric_value, version_id FROM mv WHERE p = '2-HIGH' AND coalesce(bs, ss) IS NOT NULL")
def _(t):
    return lg.metric_history(model_versions(t), "sharpe_ratio", ["2-HIGH"])


@query("ledger_summary", f"""WITH {MV} SELECT count(*) AS total_versions, min(ts) AS first_ts, max(ts) AS last_ts,
 (SELECT string_agg(tag, ',' ORDER BY tag) FROM (SELECT DISTINCT unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders)) AS tags FROM mv""")
def _(t):
    return lg.ledger_summary(model_versions(t)).withColumn("tags", F.array_join("tags", ","))


@query("ledger_append_read", f"WITH {MV} SELECT version_id, ts FROM mv")
def _(t):
    """Appended twice, the second time with later times; the newest record of each version is read back."""
    path = f"{checkpoint_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    versions = model_versions(t)
    writers.ledger_append(versions.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY")), path)
    writers.ledger_append(versions, path)
    return writers.ledger_read(t.spark, path).select("version_id", "ts")
