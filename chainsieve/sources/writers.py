"""Sinks: feature snapshots, exported labels, the model ledger, warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """Write a canonical table partitioned as its schema declares."""
    from chainsieve.schemas import PARTITIONS

    out = df
    for col, source in PARTITIONS[name].items():
        if col not in out.columns:
            out = out.withColumn(col, F.to_date(source))
    out.write.mode(mode).partitionBy(*PARTITIONS[name]).parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """Append snapshots (entity_id, ts, features[, metadata]) by day."""
    features.withColumn("ds", F.to_date("ts")).write.mode("append").partitionBy("ds").parquet(path)


def read_features(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    out = spark.read.parquet(path)
    if since is not None:
        out = out.where(F.col("ds") >= F.lit(since).cast("date"))
    return out.where(F.col("ds") <= F.lit(until).cast("date")) if until is not None else out


def nest_outcomes(labels: DataFrame) -> DataFrame:
    """Label rows as one document per point: maps by horizon, then by multiplier."""
    cell = lambda v: F.map_from_entries(F.collect_list(F.struct("multiplier", v)))
    per_h = labels.groupBy("token", "ts", "horizon").agg(
        cell("reached").alias("l"), cell("time_hours").alias("t"), cell("censored").alias("c"), F.max("max_price").alias("m"), F.max("final_liquidity").alias("f"))
    by_h = lambda v: F.map_from_entries(F.collect_list(F.struct("horizon", v)))
    return per_h.groupBy("token", "ts").agg(
        by_h("l").alias("labels"), by_h("t").alias("time_to_target"), by_h("c").alias("censored"), by_h("m").alias("max_price_reached"), by_h("f").alias("final_liquidity")
    ).withColumnsRenamed({"token": "token_address", "ts": "timestamp"})


def export_outcomes(labels: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt != "json":
        raise ValueError(f"unsupported format: {fmt}")
    nest_outcomes(labels).write.mode("overwrite").json(path)


def ledger_append(versions: DataFrame, path: str) -> None:
    versions.write.mode("append").parquet(path)


def ledger_read(spark: SparkSession, path: str) -> DataFrame:
    """Latest record of each version id."""
    raw = spark.read.parquet(path)
    return raw.groupBy("version_id").agg(F.max_by(F.struct("*"), "ts").alias("v")).select("v.*")


def ledger_export(versions: DataFrame, path: str) -> None:
    versions.select("version_id", "version_name", "ts", "tags", "notes", F.col("backtest").alias("backtest_metrics"), F.col("strategy").alias("strategy_metrics")).write.mode("overwrite").json(path)
