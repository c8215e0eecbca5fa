"""No row or value is lost to nulls, sizes or times: small, huge, missing and simultaneous."""

from pyspark.sql import functions as F

from chainsieve.operators import evaluation, features, graph, labels, matching, ordered, related, timing, wallet

TRADE = "trade_id long, token string, wallet string, side string, ts string, amount_tokens double, amount_usd double"


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADE).withColumn("ts", F.col("ts").cast("timestamp"))


def test_matching_keeps_quantities_of_any_size(spark):
    day = "2024-01-01 0{}:00:00".format
    rows = []
    for i, (who, size) in enumerate((("huge", 1e22), ("dust", 4e-10), ("plain", 2.0))):
        rows += [(2 * i, "t", who, "buy", day(0), size, 10.0), (2 * i + 1, "t", who, "sell", day(1), size, 20.0)]
    # both sizes in one key, and sums that only a decimal closes
    rows += [(10, "t", "both", "buy", day(0), 1e22, 1.0), (11, "t", "both", "buy", day(1), 4e-10, 1.0), (12, "t", "both", "sell", day(2), 1e22, 3.0), (13, "t", "both", "sell", day(3), 4e-10, 5.0)]
    rows += [(20, None, "x", "buy", day(0), 0.1, 1.0), (21, None, "x", "buy", day(1), 0.2, 1.0), (22, None, "x", "sell", day(2), 0.3, 1.0)]
    for kind in ({}, {"compat": True}, {"require_prior_buy": True}, {"slice_seconds": 60, "rows_per_slice": 1}):
        got = {r.trade_id: (r.cost_basis_usd, r.matched_buys) for r in matching.fifo_match(trades(spark, rows), **kind).collect()}
        assert got == {1: (10.0, 1), 3: (10.0, 1), 5: (10.0, 1), 12: (1.0, 1), 13: (1.0, 1), 22: (2.0, 2)}, kind


def test_volumes_keep_fractions_of_a_cent_and_large_sums(spark):
    rows = [("a", "buy", 0.004), ("a", "buy", 0.004), ("b", "sell", 3e16)]
    got = {r.wallet: (r.buy_volume_usd, r.sell_volume_usd) for r in matching.wallet_volumes(spark.createDataFrame(rows, "wallet string, side string, amount_usd double")).collect()}
    assert got == {"a": (0.008, 0.0), "b": (0.0, 3e16)}
    moved = spark.createDataFrame([("t", "x", "y", 1e-9), ("t", "x", "y", 2e-9)], "token string, src string, dst string, amount double")
    assert [(r.address, round(r.balance, 12)) for r in features.holders_from_transfers(moved).collect()] == [("y", 3e-9)]


def test_scans_keep_null_keys_and_null_order(spark):
    rows = [("a", 1, 1.0), ("a", None, 2.0), (None, 3, 4.0), (None, 4, 5.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = ordered.ordered_scan(df, ["k"], ["t"], F.floor(F.col("t") / 2), running={"s": ("sum", F.col("v"))}, before={"b": F.col("v")}).collect()
    assert {(r.k, r.t): (r.s, r.b) for r in got} == {("a", None): (2.0, None), ("a", 1): (3.0, 2.0), (None, 3): (4.0, None), (None, 4): (9.0, 4.0)}
    near = ordered.neighbours(df, ["k"], ["t"], F.floor(F.col("t") / 2), F.col("v"), 2, "n", ahead=True).collect()
    assert {(r.k, r.t): list(r.n) for r in near} == {("a", None): [1.0], ("a", 1): [], (None, 3): [5.0], (None, 4): []}
    ranks = ordered.rank_desc(spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", float("nan"))], "w string, m double"), [], "m", "w", "r", "n").collect()
    assert {r.w: (r.r, r.n) for r in ranks} == {"c": (1, 4), "a": (2, 4), "b": (3, 4), "d": (4, 4)}
    mid = ordered.middle_values(df, ["k"], "v").collect()
    assert {r.k: (r.lower_mid, r.upper_mid) for r in mid} == {"a": (1.0, 2.0), None: (4.0, 5.0)}


def test_probes_without_key_or_time_come_back(spark):
    snapshots = spark.createDataFrame([("a", "2024-01-01", {"x": 1.0})], "entity_id string, ts string, features map<string,double>").withColumn("ts", F.col("ts").cast("timestamp"))
    probes = spark.createDataFrame([(1, "a", "2024-01-02"), (2, "a", None), (3, None, "2024-01-02")], "probe_id int, entity_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.probe_id: r.features for r in features.features_as_of(probes, snapshots).collect()}
    assert got == {1: {"x": 1.0}, 2: {}, 3: {}}
    prices = spark.createDataFrame([("t", "2024-01-01 00:00:30", 5.0)], "token string, ts string, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = trades(spark, [(1, "t", "w", "buy", "2024-01-01 00:00:00", 1.0, 1.0), (2, "t", "w", "buy", None, 1.0, 1.0), (3, None, "w", "buy", "2024-01-01 00:00:00", 1.0, 1.0)])
    assert {r.trade_id: r.near_price for r in timing.price_near(asked, prices).collect()} == {1: 5.0, 2: 0.0, 3: 0.0}


def test_labels_see_every_price_of_a_second(spark):
    rows = [("t", "2024-01-01 00:00:00.0", 1.0), ("t", "2024-01-01 00:00:01.2", 9.0), ("t", "2024-01-01 00:00:01.7", 1.0)]
    prices = spark.createDataFrame(rows, "token string, ts string, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    prices = prices.withColumn("liquidity_usd", F.lit(1e6)).withColumn("volume_24h", F.lit(1e6))
    got = labels.outcome_labels(prices, multipliers=("5x",), horizons=("24h",), require_sustained=False).orderBy("ts").collect()
    assert [(r.reached, r.max_price) for r in got] == [(True, 9.0), (False, 9.0), (False, 1.0)]


def test_limits_are_refused_or_absent(spark):
    import pytest

    metrics = spark.createDataFrame([("w", 0.5, 1, 1.0, 1.0)], "wallet string, win_rate double, trades int, pnl double, sharpe_ratio double")
    with pytest.raises(ValueError):
        wallet.search_wallets(metrics, limit=1001)
    edges = spark.createDataFrame([("a", f"n{i:03}", "x", 1.0) for i in range(70)], "src string, dst string, type string, amount_usd double")
    assert graph.graph_neighbors(edges).where("wallet = 'a'").count() == 70 and graph.graph_neighbors(edges, 50).where("wallet = 'a'").count() == 50
    many = trades(spark, [(i, "t", "w", "buy", "2024-01-01 00:00:00", 1.0, 1.0) for i in range(130)]).withColumn("price", F.lit(1.0))
    assert related.trade_sequence(many).count() == 130
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "entity long, vector array<double>")
    with pytest.raises(Exception, match="one target"):
        related.pattern_similarity(vectors, vectors).collect()
    slow = spark.createDataFrame([(s, m, 1.0 if (m == "a") == (s < 600) else 0.01) for s in range(1000) for m in ("a", "b")], "step int, model string, error double")
    whole = {r.model: r.weight for r in evaluation.ensemble_weights(slow, ["a", "b"], rate=0.01, memory=1000).collect()}
    assert {r.model: r.weight for r in evaluation.ensemble_weights(slow, ["a", "b"], rate=0.01).collect()} == whole
