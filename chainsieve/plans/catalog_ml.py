"""Registered queries: model fits and what is made of them.

A fit has no SQL counterpart, so a query returns whole results (all rows, keys or models)
with properties that must hold: values in their range, ranks better than chance, means
near the observed rate. Numbers of rows and positives are compared exactly. The heatmap
is fitted once per session and folder of tables, stored, and read back.
"""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainsieve.ml import calibration, models, training
from chainsieve.operators import evaluation as ev
from chainsieve.operators.labels import HORIZONS, MULTIPLIERS, outcome_labels, training_join
from chainsieve.plans.catalog_evaluation import WF, _metrics_sql
from chainsieve.plans.catalog_labels import LAB
from chainsieve.plans.registry import query
from chainsieve.session import checkpoint_dir

KEYS = [(h, m) for h in HORIZONS for m in MULTIPLIERS]
ABSENT = ("90d", "2x")  # a key that has no labels
NAMES = ["price", "liquidity_usd", "volume_24h"]
_STORED: dict[tuple[str, str], str] = {}


def folder(t):
    return f"{checkpoint_dir(t.spark)}/models-{uuid.uuid4().hex}"


def stored_training(t):
    """Where the labelled price points with their market values lie; written once, as every fit reads them."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORED:
        path = folder(t)
        wide = training_join(outcome_labels(t.prices, horizons=HORIZONS, multipliers=MULTIPLIERS), t.prices.select("token").distinct(), MULTIPLIERS, HORIZONS)
        wide.join(t.prices, ["token", "ts"]).write.parquet(f"{path}/training")
        _STORED[key] = path
    return _STORED[key]


def heatmap(t):
    """Labelled rows and every key's probability for each of them, by the stored models."""
    path = stored_training(t)
    rows, key = t.spark.read.parquet(f"{path}/training"), (t.spark.sparkContext.applicationId, f"{t.folder} models")
    if key not in _STORED:
        models.save_models(t.spark, models.train_heatmap_models(rows, NAMES, KEYS, row_id=["token", "ts"]), NAMES, path)
        models.predict_heatmap(rows, NAMES, ["token", "ts"], models.load_models(t.spark, path)[0], [*KEYS, ABSENT]).write.parquet(f"{path}/heatmap")
        _STORED[key] = path
    return rows, t.spark.read.parquet(f"{path}/heatmap")


def with_outcomes(rows, scored):
    truth = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("multiplier"), F.col(f"{h}_{m}").cast("int").alias("outcome")) for h, m in KEYS])
    outcomes = rows.select("token", "ts", F.explode(truth).alias("o")).select("token", "ts", "o.*")
    return scored.join(outcomes, ["token", "ts", "horizon", "multiplier"], "left")


def trades_with_label(t):
    return t.trades.select("trade_id", "ts", "amount_usd", "gas_price", "amount_tokens", "token_age_hours", (F.col("side") == "buy").cast("double").alias("label"))


TRADE_NAMES = ["amount_usd", "gas_price", "amount_tokens", "token_age_hours"]
KEYED = f"{LAB}, lk AS (SELECT token, ts, horizon, multiplier, reached FROM lab UNION ALL SELECT DISTINCT token, ts, '90d', '2x', NULL::BOOLEAN FROM lab)"
inside = lambda c, top=1.0: (c >= 0) & (c <= top)


@query("training_table", f"""WITH {LAB} SELECT lab.token, lab.ts, any_value(round(p.price, 6)) AS price, bool_or(horizon = '24h' AND multiplier = '2x' AND reached) AS "24h_2x", bool_or(horizon = '30d' AND multiplier = '5x' AND reached) AS "30d_5x",
 round(max(time_hours) FILTER (WHERE horizon = '7d' AND multiplier = '2x'), 6) AS "7d_2x_time" FROM lab JOIN v_prices p ON p.token = lab.token AND p.ts = lab.ts GROUP BY 1, 2""")
def _(t):
    return training.training_table(t.spark, f"{stored_training(t)}/training").select("token", "ts", "price", "24h_2x", "30d_5x", "7d_2x_time")


@query("train_heatmap_models", f"""WITH {KEYED} SELECT horizon, multiplier, count(*) AS n, count(*) FILTER (WHERE reached) AS num_reached, true AS ranks_well, true AS near_rate FROM lk GROUP BY 1, 2""")
def _(t):
    """Per key: a ranking well above chance where both outcomes occur 20 times or more, and a mean probability near the rate of the outcome."""
    both = with_outcomes(*heatmap(t))
    ks = ["horizon", "multiplier"]
    auc = ev.auc_roc(both.where(F.col("outcome").isNotNull()), ks)
    rates = both.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("num_reached"), F.avg("outcome").alias("rate"), F.avg("probability").alias("mean"))
    return rates.join(auc, ks, "left").select(
        *ks, "n", "num_reached", ((F.coalesce("auc_roc", F.lit(1.0)) >= 0.7) | (F.least("num_reached", F.col("n") - F.col("num_reached")) < 20)).alias("ranks_well"), (F.abs(F.col("mean") - F.coalesce("rate", F.lit(models.MISSING))) < 0.02).alias("near_rate"))


@query("predict_heatmap", f"""WITH {KEYED} SELECT token, ts, horizon, multiplier, true AS in_range, CASE WHEN horizon = '90d' THEN 0.05 END AS without_model FROM lk""")
def _(t):
    _, scored = heatmap(t)
    return scored.select("token", "ts", "horizon", "multiplier", inside(F.col("probability")).alias("in_range"), F.when(F.col("horizon") == ABSENT[0], F.col("probability")).alias("without_model"))


@query("predict_heatmap_mean", f"""WITH {KEYED} SELECT horizon, multiplier, CASE WHEN horizon = '90d' THEN 0.05 ELSE round(avg(reached::INT), 1) END AS probability FROM lk GROUP BY 1, 2""")
def _(t):
    """The batch means; those of keys with a model to the nearest tenth of the observed rate, from which they differ by less than 0.02."""
    both = with_outcomes(*heatmap(t))
    rates = both.groupBy("horizon", "multiplier").agg(F.avg("outcome").alias("rate"))
    mean = models.mean_heatmap(both).join(rates, ["horizon", "multiplier"])
    near = F.abs(F.col("probability") - F.col("rate")) < 0.02
    return mean.select("horizon", "multiplier", F.when(near, F.round("rate", 1)).otherwise(F.col("probability")).alias("probability"))


RISK_SQL = "SELECT component, count(*) AS n, true AS in_range, true AS boosted_fits, true AS linear_fits FROM customer, (VALUES ('rug_risk'), ('dev_risk'), ('distribution_risk'), ('social_risk'), ('liquidity_risk')) v(component) GROUP BY 1"


@query("train_risk_models", RISK_SQL)
def _(t):
    """Per component: scores in 0..100; squared errors below those of the mean for boosted trees, and not above them for linear models."""
    k, names = F.col("c_custkey"), ["x1", "x2"]
    targets = {"rug_risk": F.col("c_nationkey") * 3.0 + F.col("c_acctbal") / 500.0, "dev_risk": F.greatest(F.lit(0.0), F.col("c_acctbal")) / 100.0, "distribution_risk": F.col("c_nationkey") * 4.0, "social_risk": (F.col("c_nationkey") % 7) * 15.0, "liquidity_risk": F.abs(F.col("c_acctbal")) / 120.0}
    rows = t.raw("customer").select(k.alias("token"), F.col("c_acctbal").alias("x1"), F.col("c_nationkey").alias("x2"), *[v.alias(c) for c, v in targets.items()])
    boosted = models.predict_risk(rows, names, ["token"], models.train_risk_models(rows, names))
    linear = models.predict_risk(rows, names, ["token"], models.train_risk_models(rows, names, boosted=False))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"t.{c}").alias("y"), F.col(f"b.{c}").alias("b"), F.col(f"l.{c}").alias("l")) for c in targets])).alias("e")
    long = rows.alias("t").join(boosted.alias("b"), "token").join(linear.alias("l"), "token").select(each).select("e.*")
    error = lambda c: F.avg((F.col(c) - F.col("y")) ** 2)
    return long.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(inside(F.col("b"), 100.0) & inside(F.col("l"), 100.0)).alias("in_range"),
        (error("b") < 0.2 * F.var_pop("y")).alias("boosted_fits"), (error("l") <= 1.01 * F.var_pop("y")).alias("linear_fits"))


# isotonic means by their min-max formula over all ranges of the distinct probabilities
@query("calibration_isotonic", """WITH c AS (SELECT horizon, multiplier, probability, count(*) AS n, sum(outcome) AS s FROM v_predictions GROUP BY ALL),
 r AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS wn, sum(s) OVER w AS ws FROM c WINDOW w AS (PARTITION BY horizon, multiplier ORDER BY probability)),
 av AS (SELECT x.horizon, x.multiplier, x.i AS a, y.i AS b, (y.ws - x.ws + x.s) / (y.wn - x.wn + x.n) AS m FROM r x JOIN r y ON x.horizon = y.horizon AND x.multiplier = y.multiplier AND y.i >= x.i),
 mn AS (SELECT r.horizon, r.multiplier, r.probability, r.n, a, min(m) AS m FROM r JOIN av ON av.horizon = r.horizon AND av.multiplier = r.multiplier AND a <= r.i AND b >= r.i GROUP BY ALL)
 SELECT horizon, multiplier, round(probability, 6) AS probability, n, round(max(m), 6) AS calibrated, round(max(m), 6) AS calibrated_max FROM mn GROUP BY horizon, multiplier, probability, n""")
def _(t):
    table = calibration.fit_calibration(t.predictions)
    out = calibration.apply_calibration(t.predictions, table)
    return out.groupBy("horizon", "multiplier", "probability").agg(F.count(F.lit(1)).alias("n"), F.min("calibrated").alias("calibrated"), F.max("calibrated").alias("calibrated_max"))


# at the optimum the mean of the calibrated probabilities is that of the outcomes
@query("calibration_platt", "SELECT horizon, multiplier, count(*) AS n, round(avg(outcome), 5) AS calibrated FROM v_predictions GROUP BY 1, 2", digits=5)
def _(t):
    table = calibration.fit_calibration(t.predictions, method="platt")
    out = calibration.apply_calibration(t.predictions, table)
    return out.groupBy("horizon", "multiplier").agg(F.count(F.lit(1)).alias("n"), F.avg("calibrated").alias("calibrated"))


@query("stack_models", "SELECT trade_id, true AS in_range FROM v_trades")
def _(t):
    rows = trades_with_label(t)
    out = models.predict_stacked(rows, TRADE_NAMES, *models.stack_models(rows, TRADE_NAMES, "trade_id"))
    return out.select("trade_id", (inside(F.col("booster")) & inside(F.col("leafwise")) & inside(F.col("stacked"))).alias("in_range"))


@query("route_models", "SELECT trade_id, true AS is_routed FROM v_trades")
def _(t):
    """Every row gets the prediction of the model that its route names."""
    rows = trades_with_label(t)
    base = models.base_models(rows, TRADE_NAMES, "trade_id")
    out = models.predict_routed(rows, TRADE_NAMES, base, models.route_models(rows, TRADE_NAMES, base))
    chosen = F.when(F.col("route") == 0, F.col("booster")).when(F.col("route") == 1, F.col("leafwise"))
    return out.select("trade_id", (inside(F.col("routed")) & (F.col("routed") == chosen)).alias("is_routed"))


@query("walk_forward_train", "SELECT model, split, (SELECT count(*) FROM v_trades) // 6 AS n, true AS in_range FROM (VALUES ('booster'), ('leafwise'), ('ensemble')) m(model), range(5) s(split)")
def _(t):
    """Per model and fold: the fold's size, and metrics of its out-of-sample predictions in their range."""
    keys = ["model", "split"]
    scored = training.walk_forward_train(trades_with_label(t), TRADE_NAMES, ["ts", "trade_id"])
    sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside(F.col("probability"))).alias("probable"))
    metrics = training.training_metrics(scored, keys)
    good = F.col("probable") & inside(F.col("brier_score")) & inside(F.coalesce("auc_roc", F.lit(0.5))) & (F.col("log_loss") >= 0)
    return metrics.join(sizes, keys).select("model", F.col("split").cast("long").alias("split"), "n", good.alias("in_range"))


@query("feature_importance", "SELECT feature, true AS in_range, 1.0::DOUBLE AS total FROM (VALUES ('amount_usd'), ('gas_price'), ('amount_tokens'), ('token_age_hours')) f(feature)")
def _(t):
    """Shares of the gain: they add up to one, and places follow them."""
    out = models.feature_importance(models.base_models(trades_with_label(t), TRADE_NAMES, "trade_id"), TRADE_NAMES)
    ahead = Window.orderBy("place")  # one row per feature
    falls = F.col("importance") <= F.coalesce(F.lag("importance").over(ahead), F.lit(1.0))
    return out.select("feature", (inside(F.col("importance")) & falls).alias("in_range"), F.sum("importance").over(Window.partitionBy()).alias("total"))


@query("train_job", f"WITH {LAB} SELECT horizon, multiplier, true AS in_range FROM lab GROUP BY 1, 2")
def _(t):
    """The job's metrics per key over the newest fifth of the rows."""
    metrics = training.train_job(t.spark, f"{stored_training(t)}/training", folder(t), names=NAMES)
    values = [c for c, kind in metrics.dtypes if kind == "double"]
    return metrics.select("horizon", "multiplier", F.forall(F.array(*values), lambda v: v.isNotNull() & inside(v)).alias("in_range"))


@query("backtest_job", f"WITH {WF}, {_metrics_sql('wx', '')}")
def _(t):
    out = folder(t)
    t.predictions.select("ts", "probability", "outcome").write.parquet(f"{out}/predictions")
    return training.backtest_job(t.spark, f"{out}/predictions", f"{out}/report")
