"""Boosted trees against brute force, and as tables of many targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainsieve.ml import boosting, models
from chainsieve.ml.boosting import Booster, boost, cut_points


def best_split(x, g, h, penalty, least_rows=1):
    """Gain and the rows that go left, over all cuts between neighbouring values."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    best = (0.0, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= least_rows:
                gain = score(left) + score(~left) - score(np.ones(len(x), bool))
                best = max(best, (gain, tuple(left)), key=lambda b: b[0])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_first_tree_is_the_best(seed):
    """With all rows and a bin per value, the cuts of the root and of its children are those of brute force."""
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 12, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
    spec = Booster(trees=1, depth=2, rate=0.3, rows=1.0, columns=1.0, penalty=1.0, least_weight=0.0)
    base, (tree,) = boost(x, y, spec)
    p = y.mean()
    g, h = p - y, np.full(60, p * (1 - p))
    assert base == pytest.approx(np.log(p / (1 - p)))
    gain, left = best_split(x, g, h, 1.0)
    assert tree["gain"][0] == pytest.approx(gain)
    goes = x[:, tree["feature"][0]] <= tree["threshold"][0]
    for child, rows in ((tree["left"][0], goes), (tree["right"][0], ~goes)):
        gain, _ = best_split(x[rows], g[rows], h[rows], 1.0)
        assert tree["gain"][child] == pytest.approx(gain)
        assert tree["value"][child] == pytest.approx(-0.3 * g[rows].sum() / (h[rows].sum() + 1.0))


def test_leaves_are_bounded_and_gain_most():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(500, 2)), rng.integers(0, 2, 500).astype(float)
    spec = Booster(trees=3, leaves=5, least_rows=20, penalty=0.0, least_weight=0.0, rows=1.0, columns=1.0)
    for tree in boost(x, y, spec)[1]:
        assert sum(f < 0 for f in tree["feature"]) <= 5
    slow = best_split(x, y.mean() - y, np.full(500, y.mean() * (1 - y.mean())), 0.0, 20)
    exact = boost(x, y, Booster(**{**spec.__dict__, "bins": 500}))[1][0]
    assert exact["gain"][0] == pytest.approx(slow[0])


def test_cut_points():
    x = np.array([[1.0, 5.0], [1.0, 6.0], [2.0, 7.0], [3.0, 8.0]])
    assert [c.tolist() for c in cut_points(x, 256)] == [[1.0, 2.0], [5.0, 6.0, 7.0]]
    assert all(len(c) <= 3 for c in cut_points(np.arange(1000.0)[:, None], 4))


def sample(spark, n=3000):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    a, b = (x[:, 0] * x[:, 1] > 0).astype(float), np.where(rng.random(n) < 0.2, np.nan, x[:, 2] > 0.5)
    rows = [(i, *map(float, r), float(p), None if np.isnan(q) else float(q), 1.0) for i, (r, p, q) in enumerate(zip(x, a, b))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, a double, b double, c double"), x, a, b


def test_targets_in_one_fit(spark):
    """Every target learns its own label, whatever the number of parts; the layout of the rows doesn't matter."""
    rows, x, a, b = sample(spark)
    make = models.learners(trees=30)
    for most, per in ((1, 1 << 16), (3, 1000)):
        fits = [boosting.fit(rows.repartition(k), "xyz", "abc", make, row_id=["id"], rows_per_part=per, most_parts=most).cache() for k in (2, 7)]
        keys = ["target", "learner", "part", "tree"]
        first, second = (f.orderBy(*keys).collect() for f in fits)
        assert first == second
        assert {r["target"] for r in first} == set("abc") and max(r["part"] for r in first) == most - 1
        model = boosting.load(fits[0])
        out = boosting.predict(rows, "xyz", model, {f"{t}_{n}": (t, n) for t in "abc" for n in make}, spread=["a_booster"]).orderBy("id").toPandas()
        for n in make:
            assert ((out[f"a_{n}"] > 0.5) == (a > 0.5)).mean() > 0.85
            assert ((out[f"b_{n}"] > 0.5) == (b > 0.5))[~np.isnan(b)].mean() > 0.97
            assert (out[f"c_{n}"] > 0.99).all()  # one value only: no tree
        assert (out["a_booster_spread"].max() > 0) == (most > 1)
        shares = boosting.importance(fits[0], "xyz").where("target = 'b'").groupBy("learner").agg(F.max_by("feature", "importance").alias("f"), F.sum("importance").alias("s")).collect()
        assert all(r["f"] == "z" and r["s"] == pytest.approx(1.0) for r in shares)


def test_regression_and_odd_inputs(spark):
    rows = spark.range(200).selectExpr("id", "CAST(id AS double) AS x", "CAST(NULL AS double) AS y", "CAST(id % 2 * 50 AS double) AS t", "CAST(NULL AS double) AS u")
    spec = {"m": Booster(trees=50, rate=0.3, logistic=False, columns=1.0)}
    trees = boosting.fit(rows.withColumn("x", F.col("id") % 2), ["x", "y"], ["t", "u"], spec)
    assert {r["target"] for r in trees.select("target").collect()} == {"t"}
    out = boosting.predict(rows.withColumn("x", F.col("id") % 2), ["x", "y"], boosting.load(trees), {"p": ("t", "m")})
    assert out.where(F.abs(F.col("p") - F.col("t")) < 1).count() == 200 and out.columns == [*rows.columns, "p"]
    assert boosting.fit(rows.limit(0), ["x"], ["t"], spec).count() == 0


def followed(tree, x):
    i = 0
    while tree["feature"][i] >= 0:
        i = tree["left"][i] if x[tree["feature"][i]] <= tree["threshold"][i] else tree["right"][i]
    return tree["value"][i]


@pytest.mark.parametrize("how", [{"depth": 6}, {"depth": 6, "leaves": 31}, {"depth": 9}, {"depth": 0}])
def test_scores_are_those_of_the_trees_followed_by_hand(how):
    """Trees of up to 64 leaves, deeper ones, stumps without a cut; values on a threshold, missing and endless ones."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 5, 2000), rng.integers(0, 300, 2000)]).astype(float)
    base, trees = boost(x, (x[:, 0] * (x[:, 1] - 2) + rng.normal(size=2000) > 0).astype(float), Booster(trees=6, least_weight=0.0, **how))
    rows = [{**t, "part": p, "tree": i, "base": base, "logistic": False} for p in (0, 2) for i, t in enumerate(trees)]
    asked = np.vstack([x[:200], np.full((1, 3), np.nan), np.full((1, 3), np.inf), np.full((1, 3), -np.inf)])
    want = base + np.array([sum(followed(t, r) for t in trees) for r in asked])
    assert np.allclose(boosting.Forest(rows).members(asked), want[:, None], rtol=0, atol=1e-12)


def test_scoring_is_spread_and_not_repeated(spark, monkeypatch):
    """One file is scored by several tasks; what passes over scores more than once reads them from a checkpoint."""
    from chainsieve.ml import training

    rows = spark.range(400).selectExpr("id", "CAST(id % 17 AS double) AS x", "timestamp_seconds(id) AS ts", "CAST(id % 2 AS double) AS label").coalesce(1)
    make = lambda: models.learners(trees=2, depth=2)
    base = models.base_models(rows, ["x"], "id", make=make)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = boosting.predict(rows, ["x"], boosting.load(base), {"p": ("all", "booster")})
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plans = {}
    plan = lambda df: df._jdf.queryExecution().toString()
    for kind in (models.LogisticRegression, models.RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, df, fit=kind.fit, name=kind.__name__: plans.update({name: plan(df)}) or fit(self, df))
    models.stack_models(rows, ["x"], "id", make=make)
    models.route_models(rows, ["x"], base)
    plans["walk"] = plan(training.walk_forward_train(rows, ["x"], ["ts", "id"], n_splits=2, make=make))
    assert len(plans) == 3 and not [name for name, p in plans.items() if "MapInArrow" in p]
    fits = []
    monkeypatch.setattr(models.LinearRegression, "fit", lambda self, df: fits.append(plan(df)))
    models.train_risk_models(rows.withColumn("rug_risk", F.col("x")), ["x"], boosted=False)
    assert len(fits) == 1 and "RebalancePartitions" in fits[0]


def rate_of(base):
    return 1 / (1 + np.exp(-base))


@pytest.mark.parametrize("how", [{"depth": 4}, {"depth": 6, "leaves": 9, "penalty": 0.0, "least_rows": 20}, {"depth": 3, "logistic": False, "bins": 16}, {"depth": 0}])
def test_rows_beyond_a_task_are_all_fitted_on(spark, how):
    """One part in many shards grows the trees that one task would grow of all its rows, also of rows that are equal."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=4000), rng.integers(0, 5, 4000), -np.exp(rng.normal(size=4000) * 9), rng.integers(0, 2, 4000)])
    x[500:1500] = x[500]  # equal rows, more than a shard has
    y = (x[:, 0] * (x[:, 1] - 2) + rng.normal(size=4000) > 0).astype(float)
    rows = spark.createDataFrame([(*map(float, r), float(v), float(v) if r[1] < 3 else None, 1.0) for r, v in zip(x, y)], "a double, b double, c double, d double, y double, z double, one double")
    spec = Booster(trees=4, rate=0.3, rows=1.0, columns=1.0, **how)
    trees = boosting.fit(rows, "abcd", ["y", "z", "one"], {"m": spec}, rows_per_part=300, most_parts=1).orderBy("target", "tree").collect()
    some = x[:, 1] < 3
    for target, data, labels in (("y", x, y), ("z", x[some], y[some])):
        base, want = boost(data, labels, spec)
        got = [r for r in trees if r["target"] == target]
        assert got[0]["base"] == pytest.approx(base) and len(got) == len(want) == 4
        for r, t in zip(got, want):
            assert r["feature"] == t["feature"] and r["threshold"] == t["threshold"] and r["left"] == t["left"] and r["right"] == t["right"]
            assert r["value"] == pytest.approx(t["value"]) and r["gain"] == pytest.approx(t["gain"])
    assert [r["feature"] for r in trees if r["target"] == "one"] == [[-1]]


def test_parts_in_shards_hold_every_row(spark):
    """Several parts of many shards: the layout of the rows doesn't matter, no row is left out, trees see the share of rows they should."""
    rows, x, a, b = sample(spark)
    make = models.learners(trees=34, depth=3)  # margins are computed anew on the way
    fits = [boosting.fit(rows.repartition(k), "xyz", "abc", make, row_id=["id"], rows_per_part=200, most_parts=2).cache() for k in (2, 7)]
    first, second = (f.orderBy("target", "learner", "part", "tree").collect() for f in fits)
    assert len(first) == len(second) == 2 * 2 * 2 * 34 + 4 and {r["part"] for r in first} == {0, 1}
    for r, t in zip(first, second):
        assert (r["feature"], r["threshold"]) == (t["feature"], t["threshold"]) and r["value"] == pytest.approx(t["value"])
    rates = [rate_of(r["base"]) for r in first if r["target"] == "a" and r["learner"] == "booster" and not r["tree"]]
    assert min(rates) < a.mean() < max(rates)
    model = boosting.load(fits[0])
    out = boosting.predict(rows, "xyz", model, {f"{t}_{n}": (t, n) for t in "abc" for n in make}).orderBy("id").toPandas()
    for n in make:
        assert ((out[f"a_{n}"] > 0.5) == (a > 0.5)).mean() > 0.85
        assert ((out[f"b_{n}"] > 0.5) == (b > 0.5))[~np.isnan(b)].mean() > 0.97
        assert (out[f"c_{n}"] > 0.99).all()
    from chainsieve.ml.sharded import drawn

    at = np.arange(100_000, dtype=np.uint64) << np.uint64(7)
    seen = [drawn(at, t, make["booster"]) for t in (0, 1)]
    assert [s.mean() for s in seen] == pytest.approx([0.8, 0.8], abs=0.01) and (seen[0] & seen[1]).mean() == pytest.approx(0.64, abs=0.01)


def fitted_on_all(monkeypatch):
    """Fits see tasks of 100 rows and one part; their start values are recorded per target."""
    bases, fit = {}, boosting.fit

    def small(*a, **how):
        trees = fit(*a, **how, rows_per_part=100, most_parts=1).cache()
        bases.update({r["target"]: r["base"] for r in trees.where("tree = 0").collect()})
        return trees

    monkeypatch.setattr(boosting, "fit", small)
    return bases


def labelled(spark, n=900):
    """The label is common among the hash classes that come last, so a share of the rows has another rate."""
    return spark.range(n).selectExpr("id", "CAST(id % 17 AS double) AS x", "timestamp_seconds(id) AS ts", f"CAST(pmod(xxhash64(id, CAST(id % 17 AS double)), {n // 100}) > 2 AS double) AS label")


def test_base_models_and_router_see_all_rows(spark, monkeypatch):
    """Start values are those of all rows, and the router's thresholds the quantiles of all rows."""
    bases, rows = fitted_on_all(monkeypatch), labelled(spark)
    trees = models.base_models(rows, ["x"], "id", make=lambda: models.learners(trees=2, depth=2))
    assert rate_of(bases["all"]) == pytest.approx(rows.agg(F.avg("label")).first()[0])
    # 20,000 rows, of which one has a feature of its own: a sample of 10,000 misses it half the time
    many = spark.range(20_000).selectExpr("id", "CAST(id = 777 AS double) AS x", "CAST(id % 3 AS double) AS z", "CAST(NULL AS double) AS w", "CAST(id % 2 AS double) AS label")
    from chainsieve.ml.sharded import feature_cuts

    assert [c.tolist() for c in feature_cuts(many, ["x", "z", "w"], 32)] == [[0.0], [0.0, 1.0], []]
    spread = spark.range(20_000).selectExpr("exp(id % 9973 / 500D) - 50 AS x", "-id / 7D AS z")
    want = cut_points(np.column_stack([spread.toPandas()[c] for c in "xz"]), 32)
    assert all((a == b).all() for a, b in zip(feature_cuts(spread, ["x", "z"], 32), want))
    seen = {}
    fit = models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df: seen.update(bins=self.getMaxBins(), n=df.count()) or fit(self, df))
    both = models.base_models(many, ["x", "z", "w"], "id", make=lambda: models.learners(trees=1, depth=1))
    router = models.route_models(many, ["x", "z", "w"], both, forest=2)
    assert seen["n"] == 20_000 and seen["bins"] ** 2 >= seen["n"]
    out = models.predict_routed(many, ["x", "z", "w"], both, router)
    assert out.count() == 20_000 and out.columns == [*many.columns, "booster", "leafwise", "routed", "route"]


def test_stack_sees_all_rows(spark, monkeypatch):
    bases, rows = fitted_on_all(monkeypatch), labelled(spark)
    models.stack_models(rows, ["x"], "id", cv=3, make=lambda: models.learners(trees=2, depth=2))
    rate = lambda df: df.agg(F.avg("label")).first()[0]
    want = {"all": rate(rows), **{f"fold{k}": rate(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) != k)) for k in range(3)}}
    assert {t: rate_of(b) for t, b in bases.items()} == pytest.approx(want)


def test_risk_models_see_all_rows(spark, monkeypatch):
    bases, rows = fitted_on_all(monkeypatch), labelled(spark).withColumns({"rug_risk": F.col("id") * 1.5, "dev_risk": F.when(F.col("id") % 3 == 0, F.col("id"))})
    models.train_risk_models(rows, ["x"], trees=2)
    assert bases == pytest.approx({"rug_risk": 449.5 * 1.5, "dev_risk": 448.5})


def test_walk_forward_sees_all_earlier_rows(spark, monkeypatch):
    from chainsieve.ml import training

    bases, rows = fitted_on_all(monkeypatch), labelled(spark)
    training.walk_forward_train(rows, ["x"], ["ts", "id"], n_splits=2, gap=7, make=lambda: models.learners(trees=2, depth=2))
    want = {f"split{k}": rows.where(F.col("id") < 300 * (k + 1) - 7).agg(F.avg("label")).first()[0] for k in range(2)}
    assert {t: rate_of(b) for t, b in bases.items()} == pytest.approx(want)
