"""Change detection: two-sample distribution tests, performance drops and cumulative-sum alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.operators.ordered import ordered_scan, value_slice

MIN_REFERENCE, MIN_CURRENT = 100, 50


def long_features(rows: DataFrame, keys: list[str], names: list[str], keep: list[str]) -> DataFrame:
    """One row per feature and sample, so that all features are tested in one job."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return rows.select(*keys, *keep, F.explode(items).alias("f")).select(*keys, *keep, "f.*")


def ks_distance(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Largest gap between the two cumulative distributions of ``value`` per key.

    ``is_reference`` splits the samples. Values are counted first; running counts
    of both sides are carried over value bands, so a key of any size is spread.
    """
    counts = samples.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(
        F.count_if("is_reference").alias("r"), F.count_if(~F.col("is_reference")).alias("c"))
    return ks_of_counts(counts, keys)


def ks_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``ks_distance`` of values that are counted already: ``r`` times in the reference, ``c`` times in the current sample."""
    run = ordered_scan(counts, keys, ["value"], value_slice("value"), running={"rr": ("sum", F.col("r")), "cc": ("sum", F.col("c"))},
                       total={"n_reference": ("sum", F.col("r")), "n_current": ("sum", F.col("c"))})
    gap = F.abs(F.try_divide("rr", "n_reference") - F.try_divide("cc", "n_current"))
    return run.groupBy(*keys).agg(F.max(gap).alias("statistic"), F.max("n_reference").alias("n_reference"), F.max("n_current").alias("n_current"))


def ks_p_value(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov series at sqrt(nm / (n + m)) times the distance."""
    t = F.sqrt(n * m / (n + m)) * statistic
    powers = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * t * t))
    series = 2.0 * F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def feature_drift(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Distance and p-value per key and feature."""
    return ks_distance(samples, [*keys, "feature"]).withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_reference"), F.col("n_current")))


def drift_report(rows: DataFrame, keys: list[str], names: list[str], *, threshold: float = 0.05) -> DataFrame:
    """One report per key over features, ``prediction`` and ``performance`` with their ``is_reference`` flag."""
    tests = feature_drift(long_features(rows, keys, [*names, "prediction"], ["is_reference"]), keys)
    ref, cur = F.count_if("is_reference"), F.count_if(~F.col("is_reference"))
    change = F.avg(F.when(~F.col("is_reference"), F.col("performance"))) - F.avg(F.when(F.col("is_reference"), F.col("performance")))
    sizes = rows.groupBy(*keys).agg(ref.alias("n_ref"), cur.alias("n_cur"), change.alias("performance_change"))
    return _judged(tests, sizes, keys, len(names), threshold)


def _judged(tests: DataFrame, sizes: DataFrame, keys: list[str], features: int, threshold: float) -> DataFrame:
    """The report of tests (feature, p_value) and sizes (n_ref, n_cur, performance_change) per key."""
    is_pred = F.col("feature") == "prediction"
    low = F.col("p_value") < threshold
    summary = tests.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(low & ~is_pred, F.col("feature")))).alias("affected_features"),  # one entry per feature
        F.max(F.when(~is_pred, 1 - F.col("p_value"))).alias("feature_confidence"),
        F.max(F.when(is_pred, 1 - F.col("p_value"))).alias("prediction_confidence"),
        F.coalesce(F.bool_or(is_pred & low), F.lit(False)).alias("prediction_drift"))
    both = (sizes.join(summary, keys) if keys else sizes.crossJoin(F.broadcast(summary))).withColumn(
        "enough", (F.col("n_ref") >= MIN_REFERENCE) & (F.col("n_cur") >= MIN_CURRENT))
    delta = F.col("performance_change")
    feature = F.size("affected_features") > 0
    perf = F.coalesce(delta < -threshold, F.lit(False))
    detected = F.col("enough") & (feature | F.col("prediction_drift") | perf)
    sudden = (perf & (delta < -0.10)) | (F.size("affected_features") > 0.5 * features)
    confidence = F.greatest(F.coalesce("feature_confidence", F.lit(0.0)), F.coalesce("prediction_confidence", F.lit(0.0)),
                            F.coalesce(F.least(F.abs(delta) / threshold, F.lit(1.0)), F.lit(0.0)))
    return both.select(
        *keys, detected.alias("drift_detected"), F.when(~detected, "none").when(sudden, "sudden").otherwise("gradual").alias("drift_type"),
        F.when(F.col("enough"), confidence).otherwise(0.0).alias("confidence"),
        F.when(F.col("enough"), F.col("affected_features")).otherwise(F.array().cast("array<string>")).alias("affected_features"),
        F.when(F.col("enough"), delta).alias("performance_change"))


ROWS, PERFORMANCE = "__rows", "__performance"


def sample_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """A sample as counted values, which can be merged with others: feature, banded, value, n, total.

    One row per feature and value; one row each for the number of rows and for the
    number and sum of ``performance``.
    """
    values = long_features(rows, [], [*names, "prediction"], []).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("performance").alias("known"), F.coalesce(F.sum(F.col("performance").cast("double")), F.lit(0.0)).alias("total"))
    kinds = F.array(F.struct(F.lit(ROWS).alias("feature"), F.col("rows").alias("n"), F.lit(0.0).alias("total")), F.struct(F.lit(PERFORMANCE).alias("feature"), F.col("known").alias("n"), "total"))
    facts = facts.select(F.explode(kinds).alias("f")).select("f.feature", F.lit(False).alias("banded"), F.lit(None).cast("double").alias("value"), "f.n", "f.total")
    return values.select("feature", F.lit(False).alias("banded"), "value", "n", F.lit(0.0).alias("total")).unionByName(facts)


def _same_grain(summary: DataFrame, banded: DataFrame) -> DataFrame:
    """``summary`` with the values of the features in ``banded`` replaced by the number of their band."""
    marked = summary.join(banded.select("feature", F.lit(True).alias("to_band")), "feature", "left")
    band = F.coalesce("to_band", F.lit(False)) & ~F.col("banded")
    value = F.when(band, value_slice("value").cast("double")).otherwise(F.col("value"))
    return marked.withColumn("value", value).withColumn("banded", F.col("banded") | band).drop("to_band")


def merge_summaries(one: DataFrame, other: DataFrame, limit: int) -> DataFrame:
    """Both samples as one. A feature with more than ``limit`` distinct values is kept as counts of bands, 64 to each doubling, from then on."""
    both = one.unionByName(other)
    folded = lambda df: df.groupBy("feature", "banded", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole = folded(both)
    wide = whole.groupBy("feature").agg((F.bool_or("banded") | (F.count(F.lit(1)) > limit)).alias("wide")).where("wide")
    return folded(_same_grain(whole, wide))


def summary_tests(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Distance and p-value per feature of two summaries, and how far off the distance may be.

    ``statistic_error`` is 0 where both samples hold exact values. Otherwise the gap is
    known at the borders of bands, and inside a band it can exceed both of its borders'
    by no more than that band's larger share.
    """
    wide = reference.where("banded").select("feature").unionByName(current.where("banded").select("feature")).distinct()
    side = lambda df, r, c: _same_grain(df.where(~F.col("feature").isin(ROWS, PERFORMANCE)), wide).select("feature", "banded", "value", r.alias("r"), c.alias("c"))
    none = F.lit(0).cast("bigint")
    both = side(reference, F.col("n"), none).unionByName(side(current, none, F.col("n")))
    counts = both.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.bool_or("banded").alias("banded"))
    tests = ks_of_counts(counts, ["feature"]).withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_reference"), F.col("n_current")))
    largest = counts.where("banded").groupBy("feature").agg(F.max("r").alias("r"), F.max("c").alias("c"))
    share = F.greatest(F.try_divide("r", "n_reference"), F.try_divide("c", "n_current"))
    return tests.join(largest, "feature", "left").withColumn("statistic_error", F.coalesce(share, F.lit(0.0))).drop("r", "c")


def summary_report(tests: DataFrame, reference: DataFrame, current: DataFrame, names: list[str], *, threshold: float = 0.05) -> DataFrame:
    """``drift_report`` from the tests and summaries of two samples."""
    fact = lambda df, n: df.agg(F.coalesce(F.max(F.when(F.col("feature") == ROWS, F.col("n"))), F.lit(0)).alias(f"n_{n}"), F.max(F.when(F.col("feature") == PERFORMANCE, F.try_divide("total", "n"))).alias(f"p_{n}"))
    sizes = fact(reference, "ref").crossJoin(F.broadcast(fact(current, "cur")))  # one row each
    return _judged(tests, sizes.withColumn("performance_change", F.col("p_cur") - F.col("p_ref")), [], len(names), threshold)


def drift_summary(reports: DataFrame, keys: list[str], last: int = 20) -> DataFrame:
    """Count, rate, most frequent type (ties alphabetical), mean confidence and latest report over the last reports."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    recent = reports.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    hit = F.col("drift_detected")
    n, kinds = F.count_if(hit), ("gradual", "none", "sudden")
    tally = {k: F.count_if(hit & (F.col("drift_type") == k)) for k in kinds}
    most = F.greatest(*tally.values())
    common = F.when(n == 0, "none")
    for k in kinds:
        common = common.when(tally[k] == most, k)
    return recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_reports"), n.alias("drift_count"), F.avg(hit.cast("double")).alias("drift_rate"), common.alias("most_common_type"),
        F.coalesce(F.avg(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"), F.when(n > 0, F.max("ts")).alias("last_drift"))


def page_hinkley(values: DataFrame, keys: list[str], order: list[str], slices: Column, value: str = "value", *, delta: float = 0.005, threshold: float = 50.0, warmup: int = 30) -> DataFrame:
    """Whether and where the cumulative deviation from the warm-up mean rises ``threshold`` above its lowest level.

    The position, the running sum and the running minimum are sliced scans. Fewer
    than ``warmup`` values raise no alarm.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    head = values.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= warmup)
    mean = head.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.count(F.lit(1)).alias("__head"))
    placed = ordered_scan(values, keys, order, slices, running={"__i": ("count", F.lit(1))})
    late = placed.where(F.col("__i") > warmup).join(mean, keys).withColumn("__d", F.col(value) - F.col("__mean") - delta)
    cus = ordered_scan(late, keys, order, slices, running={"cusum": ("sum", F.col("__d"))})
    low = ordered_scan(cus, keys, order, slices, running={"__low": ("min", F.least(F.lit(0.0), F.col("cusum")))})
    over = F.col("cusum") - F.col("__low") > threshold
    alarms = low.groupBy(*keys).agg(F.bool_or(over).alias("alarm"), F.min(F.when(over, F.col("__i"))).alias("first_alarm_row"))
    return mean.select(*keys).join(alarms, keys, "left").withColumn("alarm", F.coalesce("alarm", F.lit(False)))
