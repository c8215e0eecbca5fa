"""Small cases with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainsieve.functions import normalize as nz
from chainsieve.operators import drift as dr
from chainsieve.operators import evaluation as ev
from chainsieve.operators import graph as g
from chainsieve.operators import labels as lb
from chainsieve.operators import related as r
from chainsieve.operators import strategy as st
from chainsieve.operators import wallet as w
from chainsieve.operators.matching import fifo_match
from chainsieve.operators.ordered import time_slice

T0 = datetime(2024, 1, 1)


def closed(spark, pnls, tokens=None):
    rows = [("w", (tokens or ["AAA"] * len(pnls))[i], "ethereum", i, T0 + timedelta(hours=i), T0 + timedelta(hours=i + 5), 100.0, 100.0 + p, float(p), p / 100.0) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "wallet string, token string, chain string, trade_id bigint, entry_ts timestamp, exit_ts timestamp, cost_basis_usd double, sell_value_usd double, pnl double, roi double")


def test_win_rate(spark):
    row = w.win_rates(closed(spark, [100, -50, 200]), F.lit(T0 + timedelta(days=1))).first()
    assert (row["wins_all"], row["total_all"]) == (2, 3) and row["win_rate_all"] == pytest.approx(2 / 3)


def test_realized_pnl(spark):
    row = w.realized_pnl(closed(spark, [100, -50, 200])).first()
    assert (row["total_pnl"], row["best_trade"], row["worst_trade"]) == (250, 200, -50) and row["avg_pnl"] == pytest.approx(83.3333, abs=1e-3)


def test_breakdown_order(spark):
    rows = w.breakdown(closed(spark, [100, -20, 50], ["AAA", "AAA", "BBB"]), "token").orderBy(F.col("total_pnl").desc()).collect()
    assert [(x["token"], x["total_pnl"], x["trades"], x["wins"]) for x in rows] == [("AAA", 80, 2, 1), ("BBB", 50, 1, 1)]


def test_wash_score(spark):
    rows = [("w", "AAA", i, T0 + timedelta(minutes=i), "buy" if i % 2 == 0 else "sell") for i in range(6)]
    df = spark.createDataFrame(rows, "wallet string, token string, trade_id bigint, ts timestamp, side string")
    assert w.alternation_wash_score(df).first()["wash_score"] == 1.0


def test_fifo_partial_sells(spark):
    rows = [("t", "w", 1, T0, "buy", 100.0, 1000.0), ("t", "w", 2, T0 + timedelta(hours=2), "sell", 50.0, 750.0), ("t", "w", 3, T0 + timedelta(hours=3), "sell", 50.0, 600.0)]
    df = spark.createDataFrame(rows, "token string, wallet string, trade_id bigint, ts timestamp, side string, amount_tokens double, amount_usd double")
    got = {x["trade_id"]: x for x in fifo_match(df).collect()}
    first = got[2]
    assert (first["cost_basis_usd"], first["pnl"], first["roi"], first["holding_hours"], first["matched_buys"]) == (500, 250, 0.5, 2.0, 1)
    assert got[3]["cost_basis_usd"] == 500
    assert {x["trade_id"]: x["cost_basis_usd"] for x in fifo_match(df, compat=True).collect()}[3] == 1000


def test_rank(spark):
    df = spark.createDataFrame([("a", 0.7, 10), ("b", 0.8, 10), ("c", 0.6, 10)], "wallet string, win_rate double, trades bigint").withColumn("chain", F.lit("x"))
    got = {x["wallet"]: (x["rank"], x["percentile"]) for x in w.rank_wallets(df).collect()}
    assert got["b"] == (1, 100.0) and got["c"][0] == 3


def test_overlap_strength(spark):
    rows = [("t", x) for x in "ABCD"] + [("o", x) for x in "ABC"]
    df = spark.createDataFrame(rows, "wallet string, token string")
    row = r.token_overlap(df, spark.createDataFrame([("t",)], "wallet string")).first()
    assert (row["overlap_count"], row["strength"]) == (3, 0.75)


def test_fund_flow(spark):
    edges = spark.createDataFrame([("111", "222", 1000.0, T0, 1), ("222", "333", 500.0, T0, 2)], "src string, dst string, amount_usd double, ts timestamp, trade_id bigint")
    got = {x["wallet"]: (x["depth"], x["strength"]) for x in g.fund_flow_bfs(edges, spark.createDataFrame([("111",)], "wallet string")).collect()}
    assert got == {"222": (1, 0.1), "333": (2, 0.05)}


def test_centrality(spark):
    edges = spark.createDataFrame([("w1", "w2"), ("w1", "w3")], "src string, dst string")
    got = {x["wallet"]: (x["neighbors"], x["centrality_score"]) for x in g.degree_centrality(edges).collect()}
    assert got["w1"] == (2, 1.0)


def test_labels(spark):
    rows = [("t", T0, 1.0), ("t", T0 + timedelta(hours=12), 2.5), ("t", T0 + timedelta(hours=24), 6.0)]
    df = spark.createDataFrame(rows, "token string, ts timestamp, price double").withColumn("liquidity_usd", F.lit(100_000.0)).withColumn("volume_24h", F.lit(50_000.0))
    got = {(x["multiplier"]): (x["reached"], x["time_hours"]) for x in lb.outcome_labels(df, horizons=("24h",)).where(F.col("ts") == F.lit(T0)).collect()}
    assert got["2x"] == (True, 12.0) and got["5x"] == (True, 24.0) and got["10x"] == (False, None)


def test_closed_trade_metrics(spark):
    df = closed(spark, [50, -20]).withColumn("fees_paid", F.lit(1.0)).withColumn("slippage_cost", F.lit(0.5))
    row = st.closed_trade_metrics(df, ["wallet"], time_slice("exit_ts")).first()
    assert (row["total_pnl"], row["num_wins"], row["num_losses"], row["total_fees_paid"]) == (30, 1, 1, 2)


@pytest.mark.parametrize("text,want", [("1,234.56", 1234.56), ("$100", 100.0), (None, 0.0), ("n/a", 0.0), ("", 0.0)])
def test_clean_numeric(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(nz.clean_numeric(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("text,want", [("ETH", "ethereum"), ("BSC", "bsc"), ("BNB", "bsc"), ("SOL", "solana"), ("MATIC", "polygon"), ("Foo", "foo")])
def test_chain_alias(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(nz.normalize_chain(F.col("c"))).first()[0] == want


def test_calendar_splits(spark):
    spans = spark.createDataFrame([("a", T0, datetime(2024, 3, 31)), ("b", T0, datetime(2024, 1, 15))], "k string, start timestamp, end timestamp")
    got = ev.calendar_splits(spans, 30, 10, 10).groupBy("k").count().collect()
    assert [(x["k"], x["count"]) for x in got] == [("a", 6)]


def test_trend_and_retrain(spark):
    rows = [("m", T0 + timedelta(hours=i), i, 0.60 + 0.02 * i, 0) for i in range(10)]
    df = spark.createDataFrame(rows, "model string, ts timestamp, seq int, performance double, samples_since_retrain bigint")
    assert ev.performance_trend(df, window=5).first()["trend"] == "improving"
    assert not ev.needs_retrain(df).first()["retrain"]
    worse = df.unionByName(spark.createDataFrame([("m", T0 + timedelta(days=2), 99, 0.3, 0)], df.schema))
    assert ev.needs_retrain(worse).first()["dropped"]


def test_drift_needs_enough_rows(spark):
    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") < 200).alias("is_reference"), (F.col("id") % 50 + F.when(F.col("id") >= 200, 500).otherwise(0)).cast("double").alias("x"),
                                   F.lit(0.5).alias("prediction"), F.lit(0.9).alias("performance"))
    row = dr.drift_report(rows, [], ["x"]).first()
    assert row["drift_detected"] and row["affected_features"] == ["x"] and row["drift_type"] == "sudden"
    few = dr.drift_report(rows.where("row_id % 10 = 0"), [], ["x"]).first()
    assert not few["drift_detected"] and few["confidence"] == 0
