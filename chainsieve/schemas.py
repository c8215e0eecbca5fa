"""Schemas and partitioning of the canonical and warehouse tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL = {
    "trades": "trade_id bigint, token string, chain string, wallet string, side string, buyer string, seller string, ts timestamp, amount_tokens double, amount_usd double, price double, dex string, gas_price double, token_age_hours double",
    "prices": "token string, ts timestamp, price double, liquidity_usd double, volume_24h double",
    "transfers": "hash string, from_address string, to_address string, value decimal(38,0), token_symbol string, token_name string, token_decimal int, ts timestamp, block_number bigint, chain string",
    "edges": "src string, dst string, type string, ts timestamp, amount_usd double",
    "holders": "token string, address string, balance double",
    "positions": "wallet string, token string, amount double, avg_buy_price double",
    "posts": "post_id bigint, source string, author_id string, ts timestamp, text string, like_count bigint, retweet_count bigint, reply_count bigint",
    "tokens": "address string, chain string, symbol string, name string, decimals int, total_supply decimal(38,0), created_at timestamp, metadata map<string,string>",
    "wallets": "address string, chain string, label string, first_seen timestamp, last_seen timestamp, metadata map<string,string>",
    "token_predictions": "token string, ts timestamp, horizon string, multiplier string, probability double, risk_score double, model_version string, features map<string,double>, explanations map<string,double>",
    "wallet_analytics": "wallet string, ts timestamp, win_rate double, total_pnl double, total_trades bigint, smart_money_score double, patterns array<string>",
    "model_versions": "version_id string, version_name string, ts timestamp, tags array<string>, notes string, backtest map<string,double>, strategy map<string,double>",
    "feature_store": "entity_id string, ts timestamp, features map<string,double>, metadata map<string,string>",
    "alert_subscriptions": "id string, webhook_url string, token_addresses array<string>, wallet_addresses array<string>, min_probability_2x double, min_probability_10x double, max_risk_score double, dev_sell_threshold double, active boolean, created_at timestamp",
    "audit_log": "id bigint, ts timestamp, actor string, action string, resource string, details map<string,string>",
}


def schema(name: str) -> T.StructType:
    """Column types of a table; needs a running session."""
    return T.StructType.fromDDL(DDL[name])



# Partition column -> timestamp it is the date of (or the column itself).
PARTITIONS = {
    "trades": {"chain": "chain", "ds": "ts"}, "prices": {"ds": "ts"}, "transfers": {"chain": "chain", "ds": "ts"}, "posts": {"ds": "ts"},
    "token_predictions": {"ds": "ts"}, "wallet_analytics": {"ds": "ts"}, "feature_store": {"ds": "ts"}, "audit_log": {"ds": "ts"},
    "tokens": {"chain": "chain"}, "wallets": {"chain": "chain"},
}
UNIQUE = {"tokens": ["address", "chain"], "wallets": ["address", "chain"], "model_versions": ["version_id"], "alert_subscriptions": ["id"], "trades": ["trade_id"]}

# Range constraints of the output documents.
RANGES = {"probability": (0.0, 1.0), "win_rate": (0.0, 1.0), "risk_score": (0.0, 100.0), "composite_score": (0.0, 100.0), "wash_trading_score": (0.0, 1.0), "correlation_score": (-1.0, 1.0)}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a uniqueness constraint."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Number of values outside their range, per constrained column present."""
    present = [c for c in ranges if c in df.columns]
    return df.agg(*[F.count_if(~F.col(c).between(*ranges[c])).alias(c) for c in present])


def conforms(df: DataFrame, name: str) -> list[str]:
    """Columns missing from ``df`` or of another type than the table declares."""
    have = dict(df.dtypes)
    return reduce(lambda bad, f: bad + ([f.name] if have.get(f.name) != f.dataType.simpleString() else []), schema(name).fields, [])
