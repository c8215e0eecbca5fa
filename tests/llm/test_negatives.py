"""Hard-negative mining against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from chainsieve.llm import negatives  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, id string, cluster int, place int, score double"


def brute(rows, anchors, k=5, m=10):
    good = [(i, np.floor(256 * np.array(v, float)), y) for i, v, y, *_ in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v, y in good:
        if anchors(i):
            asked[i] = min(asked.get(i, (y, tuple(v))), (y, tuple(v)))
    out = []
    for i, (y, v) in asked.items():
        scored = sorted((-int(np.dot(v, w)), j, z) for j, w, z in good if j != i and len(w) == len(v))
        for s, j, z in [x for x in scored if x[2] == y][:k]:
            fits = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fits)]
    return sorted(out)


def vectors(seed: int, n: int, width: int, close: bool = False) -> list[tuple]:
    rng = random.Random(seed)
    around = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    make = lambda: [x + rng.gauss(0, 0.2) for x in rng.choice(around)] if close else [rng.gauss(0, 1) for _ in range(width)]
    return [(i, make(), rng.randrange(4), "x", 1, 2, 3.0) for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1), (1000, None, 1), (1002, [], 1), (1004, [1.0, None], 2), (1006, [float("nan"), 1.0], 2), (1008, [1.0, float("inf")], 2), (1010, [1.0, 1.0], None),
    (1012, [0.0, 0.0], 1), (1012, [0.5, 0.5], 1), (1014, [0.0, 0.0], 2), (1016, [-1.0, 0.5], 1), (1018, [1.0, 1.0], 2), (1018, [1.0, 1.0], 2), (1020, [1.0, 2.0, 3.0], 1), (1022, [1.0, 2.0, 2.5], 1),
    (1024, [0.5, 1.0, 1.0], 2), (1026, [3.0], 1), (1028, [1e3, -1e3], 1), (1030, [5e2, -4e2], 2), (1032, [-7.0, -7.0], 1),
]


@pytest.mark.parametrize(("close", "run"), [(False, 1024), (True, 16), (True, 64)])
def test_brute_force(spark, monkeypatch, close, run):
    rows = vectors(3, 300, 6, close) + vectors(4, 60, 2, close)[:0] + [(*r, "x", 1, 2, 3.0) for r in ODD]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(negatives, "RUN", run)
    got = negatives.hard_negatives(frame, F.col("id") % 2 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 2 == 0)


def test_cut_into_shards_and_waves(spark, monkeypatch):
    rows = vectors(5, 400, 4, True)
    for name, value in {"SHARD": 50, "WAVE": 30, "BLOCK": 7, "RUN": 9}.items():
        monkeypatch.setattr(negatives, name, value)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 3 == 0, positives=3, negatives=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 3 == 0, 3, 4)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("id") % 2 == 0).collect() == []
    one = spark.createDataFrame(vectors(1, 1, 3), SCHEMA)
    assert negatives.hard_negatives(one, F.col("id") % 2 == 0).collect() == []


@pytest.mark.parametrize("seed", range(10))
def test_bounds_hold_and_end_the_walk(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * (rng.normal(size=(800, 5)) + (seed % 3) * 2))
    members = np.floor(256 * (rng.normal(scale=0.3, size=(20, 5)) + rng.normal(size=5) * 2))
    members[0] = 0
    bound = negatives.upper_bounds(x, members)
    length = np.sqrt((members**2).sum(1))
    assert (members @ x.T <= length[:, None] * bound + 1e-6).all()
    order = np.argsort(-bound)
    a, _, row, score = negatives.walk(x[order], bound[order], np.arange(800), members, lambda a, rows, s, p: np.ones(s.shape, bool), np.full((20, 1), -np.inf), 7)
    want = -np.sort(-(members @ x.T), axis=1)[:, :7]
    assert all(np.array_equal(np.sort(score[a == i])[::-1], want[i]) for i in range(20))
