"""Queries over model-version records (schema ``model_versions``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged(versions: DataFrame, tags: list[str] | None) -> DataFrame:
    """Versions that carry any of the tags."""
    return versions.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else versions


def list_versions(versions: DataFrame, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    out = tagged(versions, tags).orderBy(F.col("ts").desc(), "version_id")
    return out.limit(limit) if limit else out


def _metric(name: str) -> Column:
    """Backtest value of a metric, else the strategy value."""
    return F.coalesce(F.try_element_at("backtest", F.lit(name)), F.try_element_at("strategy", F.lit(name)))


def best_version(versions: DataFrame, metric: str = "sharpe_ratio", tags: list[str] | None = None) -> DataFrame:
    """The version with the highest value; equal values go to the newest."""
    rows = tagged(versions, tags).withColumn("metric_value", _metric(metric)).where(F.col("metric_value").isNotNull())
    return rows.orderBy(F.col("metric_value").desc(), F.col("ts").desc(), "version_id").limit(1)


def compare_versions(versions: DataFrame, ids: list[str] | DataFrame | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Long rows (version, metric, value); a strategy value overrides the backtest value of the same name."""
    rows = versions
    if isinstance(ids, DataFrame):
        rows = rows.join(ids, "version_id", "left_semi")
    elif ids is not None:
        rows = rows.where(F.col("version_id").isin(ids))
    empty = F.create_map().cast("map<string,double>")
    back, strat = F.coalesce("backtest", empty), F.coalesce("strategy", empty)
    kept = F.map_filter(back, lambda k, _: ~F.map_contains_key(strat, k))
    long = rows.select("version_id", "version_name", F.explode(F.map_concat(kept, strat)).alias("metric", "value"))
    return long.where(F.col("metric").isin(metrics)) if metrics else long


def metric_history(versions: DataFrame, metric: str, tags: list[str] | None = None) -> DataFrame:
    return tagged(versions, tags).select("ts", _metric(metric).alias("metric_value"), "version_id").where(F.col("metric_value").isNotNull()).orderBy("ts")


def ledger_summary(versions: DataFrame) -> DataFrame:
    """Number of versions, tags in use and the time span of the ledger."""
    tags = versions.select(F.explode("tags").alias("tag")).distinct().agg(F.array_sort(F.collect_list("tag")).alias("tags"))  # one row
    return versions.agg(F.count(F.lit(1)).alias("total_versions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).crossJoin(tags)
