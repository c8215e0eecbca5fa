"""Time-ordered training and the two batch jobs.

``python -m chainsieve.ml.training train --data DIR --out DIR`` and
``python -m chainsieve.ml.training backtest --data DIR --out DIR`` are meant for spark-submit.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsieve.ml import boosting, calibration, models
from chainsieve.operators import evaluation as ev
from chainsieve.operators.ordered import ordered_scan, time_slice
from chainsieve.session import cut_lineage


def training_table(spark: SparkSession, path: str) -> DataFrame:
    """Feature and label rows for a fit."""
    return spark.read.parquet(path)


def fold_learners():
    """The learners of a time-ordered fold: 100 trees of depth 6 at a rate of 0.1."""
    return models.learners(trees=100, rate=0.1)


def walk_forward_train(rows: DataFrame, names: list[str], order: list[str], *, n_splits: int = 5, gap: int = 7, make=fold_learners) -> DataFrame:
    """Out-of-sample predictions: rows (split, model, probability, outcome) over expanding, time-ordered folds.

    ``rows`` has ``label``. Row numbers come from a sliced running count, and the
    bounds of a fold are numbers, so nothing is sorted into one task. The folds are
    targets of one fit, in which later rows have no label.
    """
    numbered = ordered_scan(rows, [], order, time_slice(order[0]), running={"__i": ("count", F.lit(1))})
    kept = dict.fromkeys([*names, *order])
    data = cut_lineage(numbered.select(*kept, F.col("label").cast("double").alias("label"), (F.col("__i") - 1).alias("__n")))
    n = data.count()
    size = n // (n_splits + 1)
    scored, base = None, list(make())
    starts = [n - (n_splits - k) * size for k in range(n_splits)]
    folds = {f"split{k}": F.when(F.col("__n") < start - gap, F.col("label")) for k, start in enumerate(starts)}
    model = boosting.load(boosting.fit(data.withColumns(folds), names, list(folds), make(), row_id=order))
    for k, start in enumerate(starts):
        own = data.where((F.col("__n") >= start) & (F.col("__n") < start + size))
        held = boosting.predict(own.select(*names, "label"), names, model, {x: (f"split{k}", x) for x in base}).select(F.lit(k).alias("split"), "label", *base)
        scored = held if scored is None else scored.unionByName(held)
    every = F.array(*[F.struct(F.lit(x).alias("model"), F.col(x).alias("probability")) for x in base],
                    F.struct(F.lit("ensemble").alias("model"), (sum((F.col(x) for x in base), F.lit(0.0)) / len(base)).alias("probability")))
    scored = cut_lineage(scored)  # each metric passes over it
    return scored.select("split", F.explode(every).alias("m"), F.col("label").cast("int").alias("outcome")).select("split", "m.*", "outcome")


def training_metrics(predictions: DataFrame, keys=("model",)) -> DataFrame:
    """Brier score, log loss, AUC, calibration gap and threshold precisions per model (or model and split)."""
    ks = list(keys)
    out = ev.probability_losses(predictions, ks)
    for part in (ev.auc_roc(predictions, ks), ev.calibration_gap(predictions, ks), ev.threshold_precision(predictions, ks)):
        out = out.join(part, ks, "left")
    return out


def train_job(spark: SparkSession, data: str, out: str, *, names: list[str], horizons=("24h", "7d", "30d"), multipliers=("2x", "5x", "10x", "20x", "50x"), calibrate: bool = True, make=models.learners) -> DataFrame:
    """Fit all keys on the older four fifths, score the newest fifth, save models and calibration, and return metrics per key.

    The boundary between the parts is a quantile of time.
    """
    rows = training_table(spark, data)
    cut = rows.select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", [0.8], 0.001)[0]
    at = F.unix_micros("ts")
    keys = [(h, m) for h in horizons for m in multipliers if f"{h}_{m}" in rows.columns]
    fitted = models.train_heatmap_models(rows.where(at <= cut), names, keys, make=make, row_id=["token", "ts"])
    models.save_models(spark, fitted, names, out)
    test = rows.where(at > cut)
    truth = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("multiplier"), F.col(f"{h}_{m}").cast("int").alias("outcome")) for h, m in keys])
    outcomes = test.select("token", "ts", F.explode(truth).alias("o")).select("token", "ts", "o.*")
    scored = cut_lineage(models.predict_heatmap(test, names, ["token", "ts"], fitted, keys)).join(outcomes, ["token", "ts", "horizon", "multiplier"])
    if calibrate:
        table = calibration.fit_calibration(scored)
        table.write.mode("overwrite").parquet(f"{out}/calibration")
        scored = calibration.apply_calibration(scored, table)
    metrics = ev.evaluate_calibration(scored)
    metrics.write.mode("overwrite").json(f"{out}/metrics")
    return spark.read.schema(metrics.schema).json(f"{out}/metrics")


def backtest_job(spark: SparkSession, data: str, out: str, *, start: str | None = None, end: str | None = None, train_days: int = 90, test_days: int = 30) -> DataFrame:
    """Walk-forward metrics over stored predictions (ts, probability, outcome), written as JSON."""
    rows = spark.read.parquet(data)
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    metrics = ev.walk_forward_eval(rows, train_days, test_days)
    metrics.write.mode("overwrite").json(out)
    return spark.read.schema(metrics.schema).json(out)


def main(argv: list[str] | None = None) -> None:
    from chainsieve.session import build_session

    p = argparse.ArgumentParser(prog="chainsieve")
    p.add_argument("job", choices=("train", "backtest"))
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--features", default="", help="comma-separated feature columns (train)")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--no-calibration", action="store_true")
    a = p.parse_args(argv)
    spark = build_session()
    if a.job == "train":
        train_job(spark, a.data, a.out, names=[c for c in a.features.split(",") if c], calibrate=not a.no_calibration).show(truncate=False)
    else:
        backtest_job(spark, a.data, a.out, start=a.start, end=a.end).show(truncate=False)


if __name__ == "__main__":
    main()
