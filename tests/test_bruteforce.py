"""Operators against plain sequential computations, with one key holding most rows and slices forced to be small."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainsieve.ml import calibration
from chainsieve.operators import drift as dr
from chainsieve.operators import evaluation as ev
from chainsieve.operators import features as ft
from chainsieve.operators import graph as g
from chainsieve.operators import patterns as pt
from chainsieve.operators.matching import fifo_match
from chainsieve.operators.ordered import even_slices, middle_values, neighbours, ordered_scan, rank_desc, time_slice
from chainsieve.operators.timing import read_as_of

T0 = datetime(2024, 1, 1)


def skewed_trades(n=3000, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        wallet = "hot" if rnd.random() < 0.6 else f"w{rnd.randrange(20)}"
        out.append((i, "t", wallet, rnd.choice(["buy", "buy", "sell"]) if i % 2 else "sell", T0 + timedelta(seconds=rnd.randrange(200_000)), float(rnd.randrange(1, 9)), float(rnd.randrange(100, 9999)) / 100))
    return out


SCHEMA = "trade_id bigint, token string, wallet string, side string, ts timestamp, amount_tokens double, amount_usd double"


def queue_match(trades, compat, prior):
    """First-in first-out by a queue per wallet."""
    result = {}
    by = {}
    for t in sorted(trades, key=lambda t: (t[4], t[0])):
        by.setdefault((t[1], t[2]), []).append(t)
    for rows in by.values():
        buys = [dict(at=(t[4], t[0]), left=t[5], qty=t[5], usd=t[6]) for t in rows if t[3] == "buy"]
        pos = 0
        for t in rows:
            if t[3] != "sell":
                continue
            need, cost, lots = t[5], 0.0, 0
            while need > 1e-9 and pos < len(buys):
                b = buys[pos]
                if prior and b["at"] > (t[4], t[0]):
                    break
                take = min(need, b["left"])
                cost += take / (b["left"] if compat else b["qty"]) * b["usd"]
                lots += 1
                need -= take
                b["left"] -= take
                if b["left"] <= 1e-9:
                    pos += 1
            if lots:
                result[t[0]] = (round(cost, 6), lots)
    return result


@pytest.mark.parametrize("compat,prior", [(False, False), (True, False), (False, True)])
def test_fifo(spark, compat, prior):
    trades = skewed_trades()
    df = spark.createDataFrame(trades, SCHEMA)
    got = {r["trade_id"]: (round(r["cost_basis_usd"], 6), r["matched_buys"]) for r in fifo_match(df, compat=compat, require_prior_buy=prior, rows_per_slice=50).collect()}
    want = queue_match(trades, compat, prior)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in want)


def test_ordered_scan(spark):
    trades = skewed_trades(1500)
    df = spark.createDataFrame(trades, SCHEMA)
    v = F.col("amount_tokens")
    some = F.when(F.col("side") == "buy", F.col("amount_usd"))
    got = {r["trade_id"]: r for r in ordered_scan(
        df, ["wallet"], ["ts", "trade_id"], time_slice("ts", 1800), running={"s": ("sum", v), "lo": ("min", v), "hi": ("max", v)}, total={"n": ("count", F.lit(1))},
        last={"seen": some}, next_={"ahead": some}, before={"p": v}, after={"q": v}).collect()}
    for key in {t[2] for t in trades}:
        rows = sorted((t for t in trades if t[2] == key), key=lambda t: (t[4], t[0]))
        for i, t in enumerate(rows):
            r, upto = got[t[0]], rows[: i + 1]
            seen = [x[6] for x in upto if x[3] == "buy"]
            ahead = [x[6] for x in rows[i:] if x[3] == "buy"]
            assert (r["s"], r["lo"], r["hi"], r["n"]) == (sum(x[5] for x in upto), min(x[5] for x in upto), max(x[5] for x in upto), len(rows))
            assert r["seen"] == (seen[-1] if seen else None) and r["ahead"] == (ahead[0] if ahead else None)
            assert r["p"] == (rows[i - 1][5] if i else None) and r["q"] == (rows[i + 1][5] if i + 1 < len(rows) else None)


def test_neighbours_cross_slices(spark):
    trades = skewed_trades(600)
    df = spark.createDataFrame(trades, SCHEMA)
    got = {r["trade_id"]: r["next"] for r in neighbours(df, ["wallet"], ["ts", "trade_id"], time_slice("ts", 900), F.col("trade_id"), 4, "next", ahead=True).collect()}
    for key in {t[2] for t in trades}:
        ids = [t[0] for t in sorted((t for t in trades if t[2] == key), key=lambda t: (t[4], t[0]))]
        assert all(got[x] == ids[i + 1: i + 5] for i, x in enumerate(ids))


@pytest.mark.parametrize("ahead,ties", [(True, True), (True, False), (False, True), (False, False)])
def test_read_as_of(spark, ahead, ties):
    rnd = random.Random(5)
    probes = [(i, "k", T0 + timedelta(minutes=rnd.randrange(600))) for i in range(200)]
    marks = [("k", T0 + timedelta(minutes=m), float(m)) for m in sorted(rnd.sample(range(600), 80))]
    p, m = spark.createDataFrame(probes, "id int, key string, ts timestamp"), spark.createDataFrame(marks, "key string, ts timestamp, v double")
    got = {r["id"]: r["v"] for r in read_as_of(p, m, ["key"], ["id"], F.col("ts"), F.col("ts"), {"v": F.col("v")}, ahead=ahead, ties=ties).collect()}
    for i, _, ts in probes:
        fit = [v for _, at, v in marks if (at > ts if ahead else at < ts) or (ties and at == ts)]
        assert got[i] == ((fit[0] if ahead else fit[-1]) if fit else None)


def test_median_and_rank(spark):
    rnd = random.Random(8)
    rows = [(i, "a" if i % 4 else "b", round(rnd.uniform(-50, 500), 1)) for i in range(801)]
    df = spark.createDataFrame(rows, "id int, k string, x double")
    mid = {r["k"]: (r["lower_mid"], r["upper_mid"]) for r in middle_values(df, ["k"], "x").collect()}
    ranks = {r["id"]: r["rank"] for r in rank_desc(df, ["k"], "x", "id", "rank").collect()}
    for k in "ab":
        xs = sorted(x for _, kk, x in rows if kk == k)
        assert mid[k] == (xs[(len(xs) - 1) // 2], xs[len(xs) // 2])
        order = [i for i, kk, x in sorted(rows, key=lambda t: (-t[2], t[0])) if kk == k]
        assert all(ranks[i] == n + 1 for n, i in enumerate(order))


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(11)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)] + [(500, 500 + i) for i in range(1, 80)]
    got = {r["vertex"]: r["component"] for r in g.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == components(nodes, [p for p in pairs if p[0] != p[1]])


@pytest.mark.parametrize("threshold", [0.3, 0.05, 0.02])
def test_pattern_clusters(spark, threshold):
    rnd = random.Random(17)
    sigs = [(f"w{i:03d}", rnd.choice([0.5, 3.0, 40.0, 900.0]) * rnd.uniform(0.7, 1.4), rnd.choice([0.0, 0.3, 0.5, 1.0]) * rnd.uniform(0.8, 1.0), rnd.choice([1, 2, 30, 400]) + rnd.randrange(3)) for i in range(90)]
    near = lambda a, b: (abs(a[1] - b[1]) / (max(a[1], b[1]) + 1) + abs(a[2] - b[2]) + abs(a[3] - b[3]) / (max(a[3], b[3]) + 1)) / 3 < threshold
    pairs = [(a[0], b[0]) for a in sigs for b in sigs if a[0] < b[0] and near(a, b)]
    want = components({s[0] for s in sigs}, pairs)
    tied = {x for p in pairs for x in p}
    got = {r["wallet"]: r["cluster_id"] for r in pt.pattern_clusters(spark.createDataFrame(sigs, "wallet string, avg_hold double, win_rate double, trades bigint"), threshold).collect()}
    assert got == {k: v for k, v in want.items() if k in tied}


def test_auc_ks_and_cusum_on_one_hot_key(spark):
    rnd = random.Random(23)
    rows = [(i, "hot", rnd.randrange(50) / 50.0, int(rnd.random() < 0.4), T0 + timedelta(minutes=i), rnd.gauss(5 if i < 700 else 7, 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, k string, probability double, outcome int, ts timestamp, value double")
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ev.auc_roc(df, ["k"]).first()["auc_roc"] == pytest.approx(wins, abs=1e-9)

    ref, cur = sorted(r[5] for r in rows if r[0] < 700), sorted(r[5] for r in rows if r[0] >= 700)
    gap = max(abs(sum(a <= x for a in ref) / len(ref) - sum(a <= x for a in cur) / len(cur)) for x in ref + cur)
    assert dr.ks_distance(df.withColumn("is_reference", F.col("id") < 700), ["k"]).first()["statistic"] == pytest.approx(gap, abs=1e-9)

    mean, cus, low, first = sum(r[5] for r in rows[:30]) / 30, 0.0, 0.0, None
    for i, r in enumerate(rows[30:], 31):
        cus += r[5] - mean - 0.005
        low = min(low, cus)
        if cus - low > 50 and first is None:
            first = i
    row = dr.page_hinkley(df, ["k"], ["ts", "id"], time_slice("ts")).first()
    assert (row["alarm"], row["first_alarm_row"]) == (first is not None, first)


def test_gini_of_one_large_token(spark):
    rnd = random.Random(29)
    bal = [float(rnd.randrange(1, 500)) for _ in range(900)]
    df = spark.createDataFrame([("t", i, b) for i, b in enumerate(bal)], "token string, address int, balance double")
    xs, n = sorted(bal), len(bal)
    want = 2 * sum((i + 1) * x for i, x in enumerate(xs)) / (n * sum(xs)) - (n + 1) / n
    assert ft.holder_stats(df).first()["gini_coefficient"] == pytest.approx(want, abs=1e-9)


def test_isotonic_map(spark):
    rnd = random.Random(31)
    rows = [("24h", "2x", p / 40, int(rnd.random() < (p / 40) ** 2)) for p in range(41) for _ in range(25)]
    df = spark.createDataFrame(rows, "horizon string, multiplier string, probability double, outcome int")
    got = {round(r["probability"], 6): r["calibrated"] for r in calibration.apply_calibration(df, calibration.fit_calibration(df)).collect()}
    # Pool adjacent violators.
    blocks = []
    for p in range(41):
        ys = [r[3] for r in rows if r[2] == p / 40]
        blocks.append([sum(ys), len(ys), [p / 40]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    for s, n, ps in blocks:
        for p in ps:
            assert got[round(p, 6)] == pytest.approx(s / n, abs=1e-9)


def test_fund_flow_over_six_hops(spark):
    """Every wallet at its hop, with the amount of the earliest edge that found it; the plan doesn't grow with its own copies."""
    import random

    from chainsieve.operators.graph import fund_flow_bfs

    rng = random.Random(5)
    edges = [(i, rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 50)), rng.randrange(40)) for i in range(75)] + [(100 + i, 60 + i, 61 + i, 20.0, i) for i in range(8)] + [(200, 0, 60, 9.0, 3)]
    frame = spark.createDataFrame(edges, "trade_id long, src long, dst long, amount_usd double, s long").selectExpr("trade_id", "src", "dst", "amount_usd", "timestamp_seconds(s) AS ts")
    seen, frontier, want = {0}, {0}, {}
    for depth in range(1, 7):
        first = {}
        for i, a, b, usd, ts in edges:
            for here, there in ((a, b), (b, a)):
                if usd >= 5 and here in frontier and there not in seen:
                    first[there] = min(first.get(there, (ts, i, here, usd)), (ts, i, here, usd))
        want |= {w: (depth, v[3]) for w, v in first.items()}
        frontier = set(first)
        seen |= frontier
    out = fund_flow_bfs(frame, spark.createDataFrame([(0,)], "wallet long"), 5.0, 6)
    assert {r.wallet: (r.depth, r.amount) for r in out.collect()} == want
    plan = out._jdf.queryExecution().analyzed().toString()
    assert max(v[0] for v in want.values()) == 6 and plan.count("trade_id") < 400


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.3), (2, 0.05), (3, 0.02)])
def test_pattern_clusters_with_crowded_cells(spark, seed, threshold):
    """Half of the wallets in two neighbouring cells; the components are those of all pairs."""
    import math
    import random

    from chainsieve.operators.patterns import pattern_clusters

    rng = random.Random(seed)
    rows = [(i, rng.uniform(10, 14) if i % 2 else rng.uniform(0, 5000), round(rng.uniform(0.4, 0.6), 3) if i % 2 else rng.random(), rng.randint(20, 24) if i % 2 else rng.randint(1, 4000)) for i in range(240)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bend = lambda d: 1 - math.exp(-abs(d))
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if bend(math.log1p(a[1]) - math.log1p(b[1])) + abs(a[2] - b[2]) + bend(math.log1p(a[3]) - math.log1p(b[3])) < 3 * threshold and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    want = {i: g for g, own in groups.items() if len(own) > 1 for i in own}
    got = pattern_clusters(spark.createDataFrame(rows, "wallet long, avg_hold double, win_rate double, trades long"), threshold)
    assert {r.wallet: r.cluster_id for r in got.collect()} == want


@pytest.mark.parametrize("spread", [3_000_000_000, 5_000, 1])
def test_a_hot_hour_is_cut_by_rows(spark, spread):
    """One key and one hour hold most rows: over the hour, within milliseconds, or all at one microsecond."""
    rnd = random.Random(5)
    rows = [(i * 3, "hot" if i % 20 else "cold", T0 + timedelta(microseconds=7_200_000_000 + rnd.randrange(spread)) if i % 10 else T0 + timedelta(seconds=rnd.randrange(90_000)), i % 7) for i in range(2000)]
    rows += [(6001, "hot", None, 1), (6002, None, T0, 2), (6003, None, None, 3)]
    df = spark.createDataFrame(rows, "trade_id bigint, token string, ts timestamp, amount bigint").repartition(8)
    cut = even_slices(df, ["token"], ("ts", "trade_id"), most=50).cache()
    assert cut.count() == len(rows)
    sizes = cut.groupBy("token", "even_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 and sizes.where("token = 'hot'").count() >= 18
    got = ordered_scan(cut, ["token"], ["ts", "trade_id"], F.col("even_slice"), running={"upto": ("sum", F.col("amount"))}, before={"prev": F.col("trade_id")})
    want, last, total = {}, {}, {}
    for i, token, _, amount in sorted(rows, key=lambda r: (r[2] or datetime.min, r[0])):
        total[token] = total.get(token, 0) + amount
        want[i] = (total[token], last.get(token))
        last[token] = i
    assert {r.trade_id: (r.upto, r.prev) for r in got.collect()} == want


def test_first_in_first_out_over_even_slices(spark):
    trades = spark.createDataFrame(skewed_trades(), SCHEMA)
    plain = {r.trade_id: (round(r.pnl, 6), r.matched_buys) for r in fifo_match(trades, require_prior_buy=True).collect()}
    even = fifo_match(trades, require_prior_buy=True, slice_seconds=30 * 86_400, rows_per_slice=40, even=True)
    assert {r.trade_id: (round(r.pnl, 6), r.matched_buys) for r in even.collect()} == plain


def test_drift_of_merged_summaries(spark):
    """Exact while values are few; beyond the limit the state is bands and the error bound holds."""
    rnd = random.Random(2)
    draw = lambda n, shift: [(rnd.expovariate(1) * 100 + shift, float(rnd.randrange(40)), 1.0) for _ in range(n)]
    parts = [spark.createDataFrame(draw(n, s), "x double, prediction double, performance double") for n, s in ((3000, 0), (2000, 0), (4000, 25))]
    sums = [dr.sample_summary(p, ["x"]) for p in parts]
    both = parts[0].unionByName(parts[1]).withColumn("is_reference", F.lit(True)).unionByName(parts[2].withColumn("is_reference", F.lit(False)))
    want = {r.feature: r.statistic for r in dr.feature_drift(dr.long_features(both, [], ["x", "prediction"], ["is_reference"]), []).collect()}
    for limit, bands in ((100_000, False), (1000, True)):
        ref = dr.merge_summaries(sums[0], sums[1], limit).cache()
        now = dr.merge_summaries(sums[2].limit(0), sums[2], limit)
        assert {r.feature for r in ref.where("banded").select("feature").distinct().collect()} == ({"x"} if bands else set())
        for r in dr.summary_tests(ref, now).collect():
            assert (r.n_reference, r.n_current) == (5000, 4000)
            assert want[r.feature] - r.statistic_error - 1e-12 <= r.statistic <= want[r.feature] + 1e-12
            assert (r.statistic_error > 0) == (bands and r.feature == "x")
        more = ref
        for _ in range(3):  # the same values again: the state stays as it is, its counts grow
            more = dr.merge_summaries(more, ref, limit)
        assert more.count() == ref.count()
        old = dr.drift_report(both, [], ["x"]).first()
        new = dr.summary_report(dr.summary_tests(ref, now), ref, now, ["x"]).first()
        assert (old["drift_detected"], old["drift_type"], old["affected_features"]) == (new["drift_detected"], new["drift_type"], new["affected_features"])


def test_locked_liquidity(spark):
    rows = [("a", T0, "lock", 5.0), ("a", T0 + timedelta(hours=1), "unlock", 5.0), ("b", T0, "lock", 5.0), ("b", T0 + timedelta(hours=1), "unlock", 2.0), ("c", T0, "add", 9.0), ("d", T0 + timedelta(days=9), "lock", 9.0), ("e", T0, "unlock", None)]
    events = spark.createDataFrame(rows, "token string, ts timestamp, type string, value_usd double")
    got = {r.token: (r.lp_locked, r.lp_locked_usd) for r in ft.lp_locked(events, F.lit(T0 + timedelta(days=1))).collect()}
    assert got == {"a": (False, 0.0), "b": (True, 3.0), "c": (False, 0.0), "e": (False, 0.0)}
