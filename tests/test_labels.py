"""Crossings, breaks and extremes against brute force, over series that span many slices."""

import random

import pytest
from pyspark.sql import functions as F

from chainsieve.operators import labels as lb

S = 1_000_000


def series(seed, n, step):
    rng, price, out, at = random.Random(seed), 1.0, [], 1_700_000_000 * S
    for _ in range(n):
        at += rng.choice([0, step, step, 40 * step]) * S
        price = max(0.01, price * rng.choice([0.5, 0.8, 0.9, 1.0, 1.1, 1.3, 2.0]))
        if rng.random() < 0.02:
            price = 1.0
        out.append((at, round(price, 4) if rng.random() > 0.03 else None, rng.choice([10.0, 60_000.0, 90_000.0, None]), rng.choice([5.0, 20_000.0])))
    return out


def frame(spark, tokens):
    rows = [(k, us, p, q, v) for k, pts in tokens.items() for us, p, q, v in pts]
    return spark.createDataFrame(rows, "token string, us long, price double, liquidity_usd double, volume_24h double").select("token", F.timestamp_micros("us").alias("ts"), "price", "liquidity_usd", "volume_24h").repartition(5)


def ordered(pts):
    low = lambda x: (x is not None, x or 0)  # noqa: E731  null first, as structs sort
    return sorted(pts, key=lambda p: (p[0], low(p[1]), low(p[2]), p[3]))


def crossing(pts, us, price, up, down, least, strictly):
    for q in pts:
        if (q[0] > us if strictly else q[0] >= us) and q[1] is not None and q[2] is not None and q[2] >= least:
            if (up is not None and q[1] >= up * price) or (down is not None and q[1] <= down * price):
                return q[0], q[1]
    return None, None


@pytest.mark.parametrize(("seed", "step", "strictly", "hours"), [(1, 600, False, 6), (2, 600, True, 24), (3, 5, False, 1), (4, 20_000, True, None)])
def test_crossings(spark, seed, step, strictly, hours):
    tokens = {k: series(seed * 10 + i, 250, step) for i, k in enumerate("ab")}
    targets = {"2x": (2.0, None), "exit": (5.0, 0.3), "half": (None, 0.5)}
    start = (F.col("p.liq") >= 50_000) & F.col("p.price").isNotNull()
    got = lb.first_crossings(frame(spark, tokens), targets, start=start, min_liquidity=50_000.0, max_days=700, strictly_after=strictly, sustain_hours=1.0, hours=hours)
    found = sorted(((r.token, r.us, r.price, r.name, r.hit_us, r.hit_price) for r in got.collect()), key=str)
    want = [(k, us, p, n, *crossing(ordered(pts), us, p, *t, 50_000.0, strictly)) for k, pts in tokens.items() for us, p, q, _ in pts if q is not None and q >= 50_000 and p is not None for n, t in targets.items()]
    assert found == sorted(want, key=str)
    broken = {(r.token, r.us, r.price, r.name): r.broken_us for r in got.where("u IS NOT NULL AND hit_us IS NOT NULL").collect()}
    for k, us, p, n, hit, _ in want:
        if hit is not None and targets[n][0] is not None:
            breaks = [q[0] for q in tokens[k] if q[0] >= hit and (q[1] is None or q[1] < targets[n][0] * p or q[2] is None or q[2] < 50_000)]
            first, told = min(breaks, default=None), broken[(k, us, p, n)]
            within = first is not None and first <= hit + 3600 * S
            assert told == first if within else told is None or told > hit + 3600 * S


@pytest.mark.parametrize(("seed", "step", "hours"), [(5, 600, 1), (6, 7000, 24), (7, 7000, None)])
def test_extremes(spark, seed, step, hours):
    tokens = {k: series(seed * 10 + i, 200, step) for i, k in enumerate("ab")}
    got = lb.horizon_extremes(frame(spark, tokens), start=F.col("p.vol") > 10, hours=hours)
    found = {(r.token, r.us, r.horizon): (r.end_us, r.max_price) for r in got.collect()}
    want = {}
    for k, pts in tokens.items():
        for us, _, _, v in pts:
            if v > 10:
                for h, hours in (("24h", 24), ("7d", 168), ("30d", 720)):
                    end = us + hours * 3600 * S
                    want[(k, us, h)] = (end, max((p for at, p, _, _ in pts if us <= at <= end and p is not None), default=None))
    assert found == want


def test_every_second_and_empty(spark):
    """A point per second for four hours across slices: cost and rows stay linear, no row holds an array."""
    base = 1_700_000_000 * S
    rising = {"t": [(base + i * S, 1.0 + i / 3000, 60_000.0, 20_000.0) for i in range(14_400)]}
    got = lb.first_crossings(frame(spark, rising), {"2x": (2.0, None)}, start=F.lit(True), min_liquidity=0.0, max_days=2, hours=1)
    assert all("array" not in t and "struct" not in t for _, t in got.dtypes)
    waits = got.groupBy(F.col("hit_us").isNotNull().alias("hit")).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("hit_us") - F.col("us")) / S).alias("w")).collect()
    assert sum(r.n for r in waits) == 14_400 and max(r.w for r in waits if r.hit) >= 3000
    none = frame(spark, rising).limit(0)
    assert lb.first_crossings(none, {"2x": (2.0, None)}, start=F.lit(True), min_liquidity=0.0, max_days=2).count() == 0
    assert lb.horizon_extremes(none, start=F.lit(True)).count() == 0 and lb.outcome_labels(none).count() == 0 and lb.exit_points(none).count() == 0
