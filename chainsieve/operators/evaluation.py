"""Prediction quality: calibration, classification, ranking precision and walk-forward pooling.

Predictions are long rows with ``probability`` and ``outcome`` (0 or 1). Every
metric first folds rows into a bounded number of bins, or into distinct score
values, on the map side; no group is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.ordered import ordered_scan, time_slice, value_slice

DAY_US = 86_400_000_000
PRECISION_CUTS = (0.3, 0.5, 0.7)
EPS = 2.220446049250313e-16  # clipping of log loss


def _p() -> Column:
    return F.col("probability")


def _y() -> Column:
    return F.col("outcome")


def hit_rates(predictions: DataFrame, keys=()) -> DataFrame:
    """Observed rate per tenth of predicted probability; a certain prediction has its own bucket 10."""
    return predictions.groupBy(*keys, F.floor(_p() * 10).cast("int").alias("bucket")).agg(
        F.avg(_y().cast("double")).alias("hit_rate"), F.avg(_p()).alias("avg_predicted"), F.count(F.lit(1)).alias("count"))


def _bins(predictions: DataFrame, keys, bin_: Column) -> DataFrame:
    return predictions.withColumn("bin", bin_.cast("int")).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(_p()).alias("predicted"), F.avg(_y().cast("double")).alias("actual"))


def upper_bin(n_bins: int = 10) -> Column:
    """Bins (lo, hi]; a probability of exactly 0 belongs to none."""
    return F.when(_p() > 0, F.ceil(_p() * n_bins) - 1)


def lower_bin(n_bins: int = 10) -> Column:
    """Bins [lo, hi), the last one closed."""
    return F.least(F.floor(_p() * n_bins), F.lit(n_bins - 1))


def calibration_curve(predictions: DataFrame, keys=(), n_bins: int = 10, upper: bool = True) -> DataFrame:
    rows = _bins(predictions, keys, upper_bin(n_bins) if upper else lower_bin(n_bins)).where(F.col("bin").isNotNull())
    return rows.select(*keys, (F.col("bin") / n_bins).alias("bin_lower"), ((F.col("bin") + 1) / n_bins).alias("bin_upper"), "predicted", "actual", "count")


def expected_calibration_error(predictions: DataFrame, keys=(), n_bins: int = 10, upper: bool = True) -> DataFrame:
    bins = _bins(predictions, keys, upper_bin(n_bins) if upper else lower_bin(n_bins))
    gap = F.when(F.col("bin").isNotNull(), F.col("count") * F.abs(F.col("actual") - F.col("predicted")))
    return bins.groupBy(*keys).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("count")).alias("ece"))


def calibration_gap(predictions: DataFrame, keys=(), n_bins: int = 10) -> DataFrame:
    """Unweighted mean gap over the non-empty bins."""
    return _bins(predictions, keys, lower_bin(n_bins)).groupBy(*keys).agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("calibration_error"))


def probability_losses(predictions: DataFrame, keys=()) -> DataFrame:
    clipped = F.least(F.greatest(_p(), F.lit(EPS)), F.lit(1 - EPS))
    return predictions.groupBy(*keys).agg(
        F.avg((_p() - _y()) * (_p() - _y())).alias("brier_score"),
        F.avg(-(_y() * F.log(clipped) + (1 - _y()) * F.log(1 - clipped))).alias("log_loss"))


def auc_roc(predictions: DataFrame, keys=()) -> DataFrame:
    """Rank statistic over distinct scores: each positive counts the negatives below it and half of those level with it.

    Scores are counted before they are ordered, and the running count is carried
    over bands of the score, so one key may hold all rows. Null with one class.
    """
    ks = list(keys)
    per = predictions.groupBy(*ks, "probability").agg(F.count_if(_y() == 1).alias("pos"), F.count_if(_y() == 0).alias("neg"))
    run = ordered_scan(per, ks, ["probability"], value_slice("probability"), running={"below": ("sum", F.col("neg"))})
    wins = F.col("pos") * (F.col("below") - F.col("neg") / 2.0)
    return run.groupBy(*ks).agg((F.sum(wins) / F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("pos") * F.sum("neg"))).alias("auc_roc"))


def classification_metrics(predictions: DataFrame, keys=()) -> DataFrame:
    """Accuracy, precision, recall, F1 at p > 0.5 and the calibration error, from one pass over bins."""
    said, is_ = _p() > 0.5, _y() == 1
    ks = list(keys)
    bins = predictions.withColumn("bin", upper_bin().cast("int")).groupBy(*ks, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(said == is_).alias("right"), F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"),
        F.count_if(~said & is_).alias("fn"), F.avg(_p()).alias("p"), F.avg(_y().cast("double")).alias("y"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("y") - F.col("p")))
    out = bins.groupBy(*ks).agg(*[F.sum(c).alias(c) for c in ("n", "right", "tp", "fp", "fn")], F.coalesce(F.sum(gap), F.lit(0.0)).alias("gap"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(
        *ks, F.col("n").alias("num_samples"), (F.col("right") / F.col("n")).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1_score"), (F.col("gap") / F.col("n")).alias("ece"))


def threshold_precision(predictions: DataFrame, keys=(), cuts=PRECISION_CUTS) -> DataFrame:
    """Precision at p >= cut; null where nothing reaches the cut."""
    return predictions.groupBy(*keys).agg(*[
        (F.count_if((_p() >= c) & (_y() == 1)) / F.when(F.count_if(_p() >= c) > 0, F.count_if(_p() >= c))).alias(f"precision_{int(c * 100)}") for c in cuts])


def evaluate_calibration(predictions: DataFrame, keys=("horizon", "multiplier")) -> DataFrame:
    ks = list(keys)
    return expected_calibration_error(predictions, ks, upper=False).join(probability_losses(predictions, ks).drop("log_loss"), ks)


def precision_at_k(ranked: DataFrame, success: Column, keys=("token",), ks=(5, 10, 20, 50, 100)) -> DataFrame:
    """Share of the first k ranked rows that succeed, for each k the ranking reaches. ``ranked`` has ``rank`` from 1."""
    sizes = F.array(*[F.lit(k) for k in ks])
    rows = ranked.where(F.col("rank") <= max(ks)).withColumn("hit", success.cast("int"))
    wide = rows.select(*keys, "hit", F.explode(F.filter(sizes, lambda k: F.col("rank") <= k)).alias("k"))
    return wide.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("precision")).where(F.col("n") == F.col("k")).drop("n")


# ---------------------------------------------------------------- splits
def calendar_splits(spans: DataFrame, train_days: int, test_days: int, step_days: int) -> DataFrame:
    """Every (train, test) window of each (start, end) span that ends inside it; one row per split."""
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    last = F.col("end") - days(train_days + test_days)
    starts = F.when(last >= F.col("start"), F.sequence(F.col("start"), last, days(step_days)))
    keys = [c for c in spans.columns if c not in ("start", "end")]
    at = F.col("train_start")
    return spans.select(*keys, F.posexplode(starts).alias("split", "train_start")).select(
        *keys, "split", "train_start", (at + days(train_days)).alias("train_end"), (at + days(train_days)).alias("test_start"), (at + days(train_days + test_days)).alias("test_end"))


def index_splits(rows: DataFrame, order: list[str], *, n_splits: int = 5, test_size: int | None = None, gap: int = 0, expanding: bool = True, slice_by: Column | None = None) -> DataFrame:
    """Bounds of time-ordered folds by row number, with the first and last time of each part.

    Rows are numbered by a sliced running count. A row takes part in at most
    ``n_splits`` folds, so only per-fold folds of (count, min, max) are shuffled.
    """
    slices = time_slice(order[0]) if slice_by is None else slice_by
    numbered = ordered_scan(rows.select(*order), [], order, slices, running={"i": ("count", F.lit(1))}, total={"n": ("count", F.lit(1))})
    i, n = F.col("i") - 1, F.col("n")
    size = F.lit(test_size) if test_size else F.floor(n / (n_splits + 1))

    def part(k: int) -> Column:
        test_start = n - (n_splits - k) * size
        train_end = test_start - gap
        train_start = F.lit(0) if expanding else F.greatest(F.lit(0), train_end - 2 * size)
        role = F.when((i >= test_start) & (i < F.least(test_start + size, n)), "test").when((i >= train_start) & (i < train_end), "train")
        return F.struct(F.lit(k).alias("split"), role.alias("role"))

    spread = numbered.select(F.col(order[0]).alias("ts"), F.explode(F.array(*[part(k) for k in range(n_splits)])).alias("p")).where(F.col("p.role").isNotNull())
    folds = spread.groupBy("p.split", "p.role").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    whole = Window.partitionBy("split")
    return folds.withColumn("roles", F.count(F.lit(1)).over(whole)).where(F.col("roles") == 2).drop("roles")


def rolling_windows(predictions: DataFrame, train_days: int = 90, test_days: int = 30, keys=()) -> DataFrame:
    """Rows of the test windows that have train data, with their window number.

    Windows of ``test_days`` follow each other after the first ``train_days``.
    Whether a window has train data is decided on the set of non-empty blocks of
    the greatest common width, which both kinds of window are made of.
    """
    from math import gcd

    block = gcd(train_days, test_days)
    span = predictions.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))  # one row
    rows = predictions.crossJoin(F.broadcast(span))
    age = F.unix_micros("ts") - F.unix_micros("t0")
    start_of = lambda k: (train_days + k * test_days) * DAY_US
    window = F.floor((age - train_days * DAY_US) / (test_days * DAY_US))
    rows = rows.withColumn("window", window)
    inside = (F.col("window") >= 0) & (start_of(F.col("window")) < F.unix_micros("t1") - F.unix_micros("t0"))
    blocks = rows.select(F.floor(age / (block * DAY_US)).alias("b")).distinct()
    # Block b serves the windows k with k*test <= b*block < k*test + train.
    lo = F.floor((F.col("b") * block - train_days) / test_days) + 1
    hi = F.floor(F.col("b") * block / test_days)
    lo = F.greatest(lo, F.lit(0))
    trained = blocks.select(F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias("window")).distinct()
    return rows.where(inside).join(trained, "window", "left_semi").drop("t0", "t1")


def walk_forward_eval(predictions: DataFrame, train_days: int = 90, test_days: int = 30, keys=()) -> DataFrame:
    """Metrics over the pooled test windows; missing probability is 0.5 and missing outcome a miss."""
    filled = predictions.withColumn("probability", F.coalesce("probability", F.lit(0.5))).withColumn("outcome", F.coalesce("outcome", F.lit(0)))
    return classification_metrics(rolling_windows(filled, train_days, test_days), keys)


# ---------------------------------------------------------------- running model quality
def performance_trend(history: DataFrame, keys=("model",), window: int = 10) -> DataFrame:
    """Statistics of the last ``window`` measurements before and including the latest; improving when it beats the mean of those before."""
    ks = list(keys)
    w = Window.partitionBy(*ks).orderBy(F.col("ts").desc(), F.col("seq").desc())
    recent = history.withColumn("back", F.row_number().over(w)).where(F.col("back") <= window)
    cur = F.max(F.when(F.col("back") == 1, F.col("performance")))
    out = recent.groupBy(*ks).agg(
        cur.alias("current"), F.avg("performance").alias("mean"), F.stddev_pop("performance").alias("std"), F.min("performance").alias("min"), F.max("performance").alias("max"),
        F.avg(F.when(F.col("back") > 1, F.col("performance"))).alias("before"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= 2).withColumn("trend", F.when(F.col("current") > F.col("before"), "improving").otherwise("degrading")).drop("before", "n")


def needs_retrain(history: DataFrame, keys=("model",), *, drop: float = 0.1, window: int = 10, max_samples: int = 10_000) -> DataFrame:
    """Whether each model's latest measurement fell below 90 % of the mean of the ten before it, or too many samples went by."""
    ks = list(keys)
    w = Window.partitionBy(*ks).orderBy(F.col("ts").desc(), F.col("seq").desc())
    recent = history.withColumn("back", F.row_number().over(w)).where(F.col("back") <= window + 1)
    cur, base = F.max(F.when(F.col("back") == 1, F.col("performance"))), F.avg(F.when(F.col("back") > 1, F.col("performance")))
    fell = F.coalesce(cur < base * (1 - drop), F.lit(False))
    return recent.groupBy(*ks).agg(
        fell.alias("dropped"), (F.max(F.when(F.col("back") == 1, F.col("samples_since_retrain"))) >= max_samples).alias("too_many_samples"),
    ).withColumn("retrain", F.col("dropped") | F.col("too_many_samples"))


def update_due(state: DataFrame, as_of: Column) -> DataFrame:
    """Daily schedules are due after one day, weekly ones after seven; never-updated models always."""
    age = (F.unix_micros(as_of) - F.unix_micros("last_update")) / DAY_US
    need = F.when(F.col("schedule") == "daily", 1.0).when(F.col("schedule") == "weekly", 7.0)
    return state.withColumn("due", F.coalesce(F.col("last_update").isNull() | (age >= need), F.lit(False)))


def recency_weights(rows: DataFrame, keys: list[str], order: list[str], slices: Column, decay: float = 0.99) -> DataFrame:
    """Weight ``decay ** age`` by position from the newest row, summing to 1 per key (closed-form total)."""
    at = ordered_scan(rows, keys, order, slices, running={"i": ("count", F.lit(1))}, total={"n": ("count", F.lit(1))})
    total = (1.0 - F.pow(F.lit(decay), F.col("n"))) / (1.0 - decay)
    return at.withColumn("weight", F.pow(F.lit(decay), F.col("n") - F.col("i")) / total).drop("i", "n")


def ensemble_predict(predictions: DataFrame, weights: dict[str, float], row_keys=("row_id",)) -> DataFrame:
    """Weighted prediction per row, its confidence 1 / (1 + variance), and each model's contribution. Columns: model, prediction."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    part = F.col("prediction") * F.try_element_at(table, F.col("model"))
    return predictions.groupBy(*row_keys).agg(
        F.sum(part).alias("prediction"), (1.0 / (1.0 + F.var_pop("prediction"))).alias("confidence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", part.alias("c"))))).alias("contributions"))


def ensemble_weights(errors: DataFrame, models: list[str], *, rate: float = 0.1, floor: float = 0.05, recent: int = 100, memory: int | None = None) -> DataFrame:
    """Weights after the newest update: reciprocal recent error, moved by ``rate`` per update, floored and renormalised.

    Columns: step, model, error. An update older than ``memory`` steps weighs
    less than (1 - rate) ** memory. By default that is below double precision, so
    the fold of that many steps is the fold of all, and doesn't grow with the history.
    """
    if memory is None:
        memory = math.ceil(math.log(1e-18) / math.log(1 - rate)) if rate < 1 else 1
    names = sorted(models)
    back = Window.partitionBy("model").orderBy(F.col("step").desc())
    last = errors.withColumn("back", F.row_number().over(back)).where(F.col("back") <= memory + recent)
    trail = Window.partitionBy("model").orderBy("step").rowsBetween(-(recent - 1), 0)
    rows = last.select("step", "model", "back", (1.0 / (F.avg("error").over(trail) + 1e-6)).alias("perf")).where(F.col("back") <= memory)
    steps = rows.groupBy("step").agg(*[F.max(F.when(F.col("model") == m, F.col("perf"))).alias(m) for m in names])
    target = F.array(*[F.col(m) / sum((F.col(x) for x in names), F.lit(0.0)) for m in names])
    fold = steps.agg(F.transform(F.array_sort(F.collect_list(F.struct("step", target.alias("t")))), lambda x: x["t"]).alias("targets"))  # at most `memory` rows
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scale = lambda a: F.transform(a, lambda x: x / total(a))

    def step(state: Column, t: Column) -> Column:
        moved = F.zip_with(state, t, lambda a, b: (1 - rate) * a + rate * b)
        return scale(F.transform(scale(moved), lambda x: F.greatest(F.lit(floor), x)))

    start = F.array(*[F.lit(1.0 / len(names)) for _ in names])
    return fold.select(F.posexplode(F.aggregate("targets", start, step)).alias("pos", "weight")).select(
        F.element_at(F.array(*[F.lit(m) for m in names]), F.col("pos") + 1).alias("model"), "weight")


def refresh_interval(updates: DataFrame, key: str, *, base_s: int = 300, low_s: int = 60, high_s: int = 3600) -> DataFrame:
    """Half the mean gap of the last ten updates, within bounds; the base interval with fewer than two."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc())
    recent = updates.withColumn("back", F.row_number().over(w)).where(F.col("back") <= 10)
    n = F.count(F.lit(1))
    half = F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1.0e6 / (n - 1) * 0.5)
    return recent.groupBy(key).agg(F.when(n < 2, base_s).otherwise(F.greatest(F.lit(low_s), F.least(F.lit(high_s), half))).cast("bigint").alias("ttl_seconds"))
