"""Streams over several files equal the batch computation; late, repeated and malformed input."""

import json
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainsieve.streaming import live

T0 = datetime(2024, 1, 1)
SCHEMA = "trade_id bigint, token string, chain string, wallet string, side string, ts timestamp, amount_usd double"


def rows(spark, ids, minutes=None):
    data = [(i, f"t{i % 2}", "solana" if i % 3 else "ethereum", f"w{i % 4}", "buy" if i % 2 else "sell", T0 + timedelta(minutes=minutes if minutes is not None else i), float(i)) for i in ids]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def landing(tmp_path):
    return f"{tmp_path}/in-{uuid.uuid4().hex}", f"{tmp_path}/out-{uuid.uuid4().hex}"


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_running_signals_over_batches(spark, landing):
    src, out = landing
    for k in range(3):
        land(rows(spark, range(k * 40, k * 40 + 40)), src)
    stream = live.read_rows(spark, src, rows(spark, [1]).schema, max_files=1)
    updates = live.run_to_table(live.live_wallet_signals(stream), out, mode="update")
    assert updates.select("batch").distinct().count() == 3
    got = {r["wallet"]: tuple(r) for r in live.latest(updates, ["wallet"]).collect()}
    want = {r["wallet"]: tuple(r) for r in live.live_wallet_signals(rows(spark, range(120))).collect()}
    assert got == want


def test_state_continues_after_restart(spark, landing):
    src, out = landing
    land(rows(spark, range(40)), src)
    schema = rows(spark, [1]).schema
    live.run_to_table(live.live_wallet_signals(live.read_rows(spark, src, schema)), out, mode="update")
    land(rows(spark, range(40, 80)), src)
    updates = live.run_to_table(live.live_wallet_signals(live.read_rows(spark, src, schema)), out, mode="update")
    assert sum(r["trade_count"] for r in live.latest(updates, ["wallet"]).collect()) == 80


def test_duplicates_and_late_rows(spark, landing):
    src, out = landing
    schema = rows(spark, [1]).schema
    land(rows(spark, range(0, 30)), src)
    land(rows(spark, list(range(20, 50))), src)  # ten repeated
    land(rows(spark, [900], minutes=600), src)  # moves the watermark far ahead
    land(rows(spark, [901], minutes=5), src)  # later than the watermark allows
    stream = live.dedup_late(live.read_rows(spark, src, schema, max_files=1), lateness="30 minutes")
    ids = sorted(r["trade_id"] for r in live.run_to_table(stream.select("trade_id"), out).collect())
    assert ids == [*range(50), 900]


def test_windows_equal_batch(spark, landing):
    src, out = landing
    for k in range(2):
        land(rows(spark, range(k * 60, k * 60 + 60)), src)
    stream = live.stream_windows(live.read_rows(spark, src, rows(spark, [1]).schema, max_files=1), ["token"], size="30 minutes", slide="10 minutes", lateness="1 day")
    got = sorted(map(tuple, live.latest(live.run_to_table(stream, out, mode="update"), ["token", "window_start", "window_end"]).collect()))
    assert got == sorted(map(tuple, live.stream_windows(rows(spark, range(120)), ["token"], size="30 minutes", slide="10 minutes").collect()))


def test_messages(spark):
    good = json.dumps({"params": {"result": {"signature": "abc", "logs": ["x"]}}})
    df = spark.createDataFrame([(good,), ('{"params": {}}',), ("{broken",), ('{"id": 1}',)], "value string")
    assert [(r["signature"], r["logs"], r["chain"]) for r in live.live_trades(df, "solana").collect()] == [("abc", ["x"], "solana")]
    with pytest.raises(ValueError):
        live.live_trades(df, "dogechain")


def test_one_failing_handler_does_not_stop_the_other(spark, landing):
    src, out = landing
    land(rows(spark, range(20)), src)
    seen = []

    def bad(batch, batch_id):
        raise RuntimeError("no")

    live.signal_updates(live.read_rows(spark, src, rows(spark, [1]).schema), {"bad": bad, "good": lambda b, i: seen.append(b.count())}, out, once=True).awaitTermination()
    assert seen == [4]


def test_alert_triggers(spark):
    scores = spark.createDataFrame([("A", "w1", 0.6, 0.1, 80.0, 5.0), ("B", "w2", 0.5, 0.9, 10.0, None)], "token string, wallet string, probability_2x double, probability_10x double, risk_score double, dev_sells double")
    subs = spark.createDataFrame(
        [("any", "u", None, None, 0.5, None, 80.0, None, True), ("onlyB", "u", ["B"], None, None, 0.9, None, None, True), ("wallet", "u", None, ["w1"], None, None, None, None, True), ("off", "u", None, None, 0.1, None, None, None, False)],
        "id string, webhook_url string, token_addresses array<string>, wallet_addresses array<string>, min_probability_2x double, min_probability_10x double, max_risk_score double, dev_sell_threshold double, active boolean")
    got = sorted((r["subscription_id"], r["token"], r["trigger"]) for r in live.alert_matches(scores, subs).collect())
    assert got == [("any", "A", "probability_2x"), ("any", "B", "probability_2x"), ("onlyB", "B", "probability_10x"), ("wallet", "A", "activity")]


def test_alerts_of_stored_scores_take_disk_by_scores(spark, tables, tmp_path):
    """A query's disk doesn't hold its matches, and cutting hot keys into shares changes none."""
    from chainsieve.plans import catalog_streaming as cs
    from chainsieve.plans.catalog import QUERIES

    seen = []
    run = live.run_to_table
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(live, "run_to_table", lambda stream, path, **how: seen.append(path) or run(stream, path, **how))
        n = QUERIES["alert_matches"](spark, tables.folder).count()
    stored = sum(spark.read.parquet(f"{p}/rows").count() for p in seen)
    assert stored == tables.trades.count() < n
    scores = cs._scores(tables.trades)
    whole, cut = (live.alert_matches(scores, cs._subscriptions(tables), **how) for how in ({}, {"pairs_per_task": 50}))
    assert n == whole.count() == cut.count() and whole.exceptAll(cut).isEmpty()


def test_filter_rejects_unknown_chain(spark):
    assert live.token_filter(rows(spark, range(12)), token="t0", chain="ethereum").where(F.col("chain") != "ethereum").count() == 0
    with pytest.raises(ValueError):
        live.token_filter(rows(spark, [1]), chain="dogechain")


def test_drift_tests_whole_batches_and_fills_its_reference(spark, tmp_path):
    import time

    from chainsieve.streaming import monitor

    for k, (n, shift) in enumerate([(50, 0.0), (300, 0.0), (300, 0.0), (300, 5.0)]):
        ts = (F.lit(1_700_000_000 + 10_000 * k) + F.col("id")).cast("timestamp")
        spark.range(n).select(ts.alias("ts"), (F.col("id") + 1000 * k).alias("row_id"), (F.rand(k) + shift).alias("x"), F.rand(k + 9).alias("prediction"), F.lit(1.0).alias("performance")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in order of their time
    for name, sizes, first in (("whole", {}, 2), ("rows", {"reference_size": 400, "current_size": 200}, 2)):
        stream = spark.readStream.schema("ts timestamp, row_id long, x double, prediction double, performance double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        monitor.stream_drift(stream, ["x"], f"{tmp_path}/{name}", once=True, **sizes).awaitTermination()
        got = {r.batch: r.drift_detected for r in spark.read.parquet(f"{tmp_path}/{name}/reports").collect()}
        assert got == {2: False, 3: True}, name


def test_live_queries_read_a_folder_of_part_files(spark, tmp_path):
    import os

    from chainsieve.plans.catalog import QUERIES

    source = "/root/testdata/sf0.001"
    for f in os.listdir(source):
        if f != "events.parquet":
            os.symlink(f"{source}/{f}", tmp_path / f)
    spark.read.parquet(f"{source}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("token_filter", "dedup_late"):
        assert QUERIES[name](spark, str(tmp_path)).count() == QUERIES[name](spark, source).count() > 0


def test_wallet_states_arrival_and_time_to_live(spark, tmp_path):
    """The last to arrive names the time; a wallet that is silent for the time to live starts anew, others go on."""
    import time

    schema = "trade_id long, wallet string, side string, amount_usd double, ts timestamp, arrived timestamp"
    land = lambda rows: spark.createDataFrame(rows, "trade_id long, wallet string, side string, amount_usd double, t long, a long").selectExpr(
        "trade_id", "wallet", "side", "amount_usd", "timestamp_seconds(t) AS ts", "timestamp_seconds(a) AS arrived").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(ttl, to):
        with live.keyed_state(spark):
            return live.run_to_table(live.live_wallet_states(live.read_rows(spark, f"{tmp_path}/in", schema), ttl=ttl), f"{tmp_path}/{to}", mode="update")

    land([(1, "a", "buy", 10.0, 500, 900), (2, "a", "sell", 5.5, 700, 800), (3, "b", None, None, 100, 100), (4, None, "buy", 1.0, 1, 1)])
    for ttl, to in (("1 second", "short"), ("1 day", "long"), (None, "ever")):
        first = {r.wallet: (r.trade_count, r.total_volume, r.buy_count, r.sell_count, r.last_trade_time.timestamp()) for r in run(ttl, to).collect()}
        assert first == {"a": (2, 15.5, 1, 1, 500.0), "b": (1, 0.0, 0, 1, 100.0)}
    time.sleep(2)
    land([(5, "a", "buy", 1.0, 600, 850)])
    last = {to: live.latest(run(ttl, to), ["wallet"]).where("wallet = 'a'").first() for ttl, to in (("1 second", "short"), ("1 day", "long"), (None, "ever"))}
    assert (last["short"].trade_count, last["short"].last_trade_time.timestamp()) == (1, 600.0)
    for to in ("long", "ever"):  # the trade of 500 arrived at 900, after that of 600
        assert (last[to].trade_count, last[to].total_volume, last[to].last_trade_time.timestamp()) == (3, 16.5, 500.0)


def test_late_rows_join_sessions(spark, tmp_path):
    """A late row between two sessions of earlier batches makes them one."""
    land = lambda rows: spark.createDataFrame([(1, 2, t) for t in rows], "token long, wallet long, t long").selectExpr("token", "wallet", "timestamp_seconds(t) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for batch in ([0, 600, 7000], [3600, 90_000], [10**9]):
        land(batch)
    rows = live.read_rows(spark, f"{tmp_path}/in", "token long, wallet long, ts timestamp", max_files=1)
    out = live.run_to_table(live.stream_sessions(rows, ["token", "wallet"], gap="1 hour", lateness="2 days"), f"{tmp_path}/out").collect()
    assert sorted((r.session_start.timestamp(), r.session_end.timestamp(), r.trades) for r in out) == [(0, 10_600, 4), (90_000, 93_600, 1)]
