"""Written tables, stored models, and the shape of physical plans."""

import json
import re

import pytest
from conftest import TINY
from pyspark.sql import functions as F

from __spark_entry__ import queries
from chainsieve.ml import models, training
from chainsieve.operators.labels import outcome_labels
from chainsieve.schemas import conforms, range_violations, schema
from chainsieve.sources import writers as wr


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_round_trip(spark, tables, tmp_path):
    snap = tables.trades.select(F.col("wallet").cast("string").alias("entity_id"), "ts", F.create_map(F.lit("usd"), "amount_usd").alias("features"))
    wr.write_features(snap, f"{tmp_path}/f")
    wr.write_features(snap.limit(5), f"{tmp_path}/f")
    assert wr.read_features(spark, f"{tmp_path}/f").count() == snap.count() + 5
    part = wr.read_features(spark, f"{tmp_path}/f", since="2024-01-10")
    assert "PartitionFilters: [isnotnull(ds" in part._jdf.queryExecution().toString()


def test_outcome_export(spark, tables, tmp_path):
    labels = outcome_labels(tables.prices, horizons=("24h",), multipliers=("2x",))
    wr.export_outcomes(labels, f"{tmp_path}/o")
    docs = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/o").collect()]
    assert len(docs) == labels.count() and "2x" in docs[0]["labels"]["24h"]
    with pytest.raises(ValueError):
        wr.export_outcomes(labels, f"{tmp_path}/o", fmt="csv")


def test_ledger_keeps_latest(spark, tmp_path):
    rows = "('a', 'one', TIMESTAMP '2024-01-01', array('x'), '', map('auc', 0.5D), map()), ('a', 'two', TIMESTAMP '2024-01-02', array('x'), '', map('auc', 0.6D), map())"
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(version_id, version_name, ts, tags, notes, backtest, strategy)").withColumn("strategy", F.col("strategy").cast("map<string,double>")).withColumn("backtest", F.col("backtest").cast("map<string,double>"))
    wr.ledger_append(df, f"{tmp_path}/l")
    assert [r["version_name"] for r in wr.ledger_read(spark, f"{tmp_path}/l").collect()] == ["two"]


def test_table_layout_and_schema(spark, tables, tmp_path):
    wr.write_table(tables.trades, f"{tmp_path}/t", "trades")
    back = spark.read.parquet(f"{tmp_path}/t").where((F.col("chain") == "bsc") & (F.col("ds") == "2024-01-03"))
    assert back.count() > 0 and "PartitionFilters: [isnotnull(chain" in back._jdf.queryExecution().toString()
    assert conforms(spark.createDataFrame([], schema("trades")), "trades") == []
    assert range_violations(spark.sql("SELECT 1.5D AS win_rate")).first()["win_rate"] == 1


def test_models_survive_storage(spark, tables, tmp_path):
    rows = tables.trades.select("trade_id", "amount_usd", "gas_price", (F.col("side") == "buy").alias("24h_2x"))
    names, keys = ["amount_usd", "gas_price"], [("24h", "2x"), ("7d", "2x")]
    fitted = models.train_heatmap_models(rows, names, keys, make=lambda: models.learners(trees=2, depth=2))
    models.save_models(spark, fitted, names, f"{tmp_path}/m")
    again, back = models.load_models(spark, f"{tmp_path}/m")
    a, b = (models.predict_heatmap(rows, names, ["trade_id"], f, keys).where("horizon = '24h'").agg(F.sum("probability")).first()[0] for f in (fitted, again))
    assert back == names and a == pytest.approx(b)
    assert models.predict_heatmap(rows, names, ["trade_id"], again, keys).where("horizon = '7d' AND probability = 0.05").count() == rows.count()


def test_walk_forward_is_out_of_sample(spark, tables):
    rows = tables.trades.select("trade_id", "ts", "amount_usd", (F.col("side") == "buy").cast("double").alias("label"))
    out = training.walk_forward_train(rows, ["amount_usd"], ["ts", "trade_id"], n_splits=2, gap=7, make=lambda: models.learners(trees=2, depth=2))
    n = rows.count() // 3
    assert {(r["split"], r["model"]): r["count"] for r in out.groupBy("split", "model").count().collect()} == {(s, m): n for s in (0, 1) for m in ("booster", "leafwise", "ensemble")}


ONE_ROW_JOINS = {  # joins with an aggregate of one row, which is broadcast on purpose
    "degree_centrality", "graph_signals", "temporal_correlation", "pattern_similarity", "related_wallets", "find_smart_wallets", "walk_forward_eval", "token_set_operations", "token_overlap",
}


@pytest.mark.parametrize("name", ["fifo_match", "pre_event_trades", "next_extremum", "price_near", "outcome_labels", "exit_rule", "token_overlap", "temporal_correlation", "timing_signals", "find_smart_wallets", "rank_wallets_global", "walk_forward_eval", "rate_excess", "clustering_coefficient", "counterfactual_impact"])
def test_no_nested_loop_joins(spark, name):
    plan = physical(queries()[name](spark, TINY))
    assert "CartesianProduct" not in plan
    assert name in ONE_ROW_JOINS or "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["scan_wallet_trades"](spark, TINY)._jdf.queryExecution().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan and "value" not in read


def test_registered_fits_are_whole(tables, monkeypatch):
    """Keys, components, folds and trees that the registered model queries ask for, without fitting them."""
    import inspect

    from chainsieve.plans import catalog_ml

    assert len(set(catalog_ml.KEYS)) == 15
    assert set(models.learners()) == {"booster", "leafwise"} == set(models.MODEL_WEIGHTS)
    assert {(b.trees, b.depth, b.rate) for b in models.learners().values()} == {(200, 6, 0.05)}
    assert {(b.trees, b.depth, b.rate) for b in training.fold_learners().values()} == {(100, 6, 0.1)}
    asked = {}

    class Asked(Exception):
        pass

    def spy(module, name):
        real = inspect.signature(getattr(module, name))

        def stop(*args, **kwargs):
            call = real.bind(*args, **kwargs)
            call.apply_defaults()
            asked[name] = call.arguments
            raise Asked

        monkeypatch.setattr(module, name, stop)

    for module, name in ((models, "train_heatmap_models"), (models, "train_risk_models"), (models, "stack_models"), (training, "walk_forward_train"), (training, "train_job")):
        spy(module, name)
    for name in ("train_heatmap_models", "train_risk_models", "stack_models", "walk_forward_train", "train_job"):
        with pytest.raises(Asked):
            queries()[name](tables.spark, TINY)
    heat = asked["train_heatmap_models"]
    assert len(heat["keys"]) == 15 and heat["make"]()["booster"].trees == 200
    assert {f"{h}_{m}" for h, m in heat["keys"]} <= set(heat["training"].columns)
    risk = asked["train_risk_models"]
    assert risk["trees"] == 100 and set(models.RISK_COMPONENTS) <= set(risk["training"].columns)
    assert asked["stack_models"]["cv"] == 5 and asked["stack_models"]["make"]()["booster"].trees == 200
    assert asked["walk_forward_train"]["n_splits"] == 5 and asked["walk_forward_train"]["make"]()["booster"].trees == 100
    job = asked["train_job"]
    assert len(job["horizons"]) * len(job["multipliers"]) == 15 and job["make"]()["booster"].trees == 200


def test_risk_components_fit_side_by_side(spark):
    rows = spark.range(60).selectExpr("id AS token", "CAST(id AS double) AS x", *[f"CAST(id % {i + 2} * 10 AS double) AS {c}" for i, c in enumerate(models.RISK_COMPONENTS)])
    out = models.predict_risk(rows, ["x"], ["token"], models.train_risk_models(rows, ["x"], trees=2))
    assert set(out.columns) == {"token", *models.RISK_COMPONENTS} and out.count() == 60
