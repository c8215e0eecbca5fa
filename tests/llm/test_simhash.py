"""SimHash near-duplicates against brute force."""

import random
import re
import sys
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from chainsieve.llm import simhash  # noqa: E402
from chainsieve.operators.graph import connected_components  # noqa: E402


def slow_fingerprint(text, k=4):
    w = H.words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps: dict, bits=4) -> dict:
    """Smallest key reachable, of {key: fingerprint}."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("size", [3, 4])
def test_positions(size):
    choices = simhash.positions(size)
    assert len(choices) == {3: 20, 4: 70}[size]
    assert all(any(set(c) <= set(four) for c in choices) for four in combinations(range(8), 4))


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 64)  # shingles across steps
    for _, text in [(r[0], r[1]) for r in H.odd_documents()]:
        if len(text or "") < 20_000:
            assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint("ÀB cd\x0bEF\x1cgh \x85 x y") == slow_fingerprint("ÀB cd\x0bEF\x1cgh \x85 x y")


def test_documents(spark):
    rows = [r for r in H.odd_documents() if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(rows, H.DOCS).withColumn("fp", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    numbered = {(r[0] if r[0] is not None else 10_000 + i, r[0], i): slow_fingerprint(r[1]) for i, r in enumerate(rows)}
    want = slow_components(numbered)
    expected = [(k[1], f"{fp:016x}", want[k][1]) for k, fp in numbered.items()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert simhash.near_duplicates(spark.createDataFrame([], H.DOCS)).collect() == []
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in alone if r.doc_id) == [(3, 3)] and {r.component_id for r in alone if r.doc_id is None} == {None}


def crowd(seed: int, n: int) -> list[int]:
    """Fingerprints around a few centres, some of them chained, and others anywhere."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n // 4)}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        at = centre
        while len(out) < n and rng.random() > 3 / n:
            x = at if rng.random() < 0.3 else centre
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 7])):
                x ^= 1 << b
            out.add(x)
            at = x
    return sorted(out)


@pytest.mark.parametrize(("seed", "limit", "size"), [(1, 8192, None), (2, 8192, 4), (3, 20, 3), (4, 5, 3), (5, 5, 4)])
def test_links(spark, seed, limit, size):
    """The same components whether lists are short or are compared in blocks."""
    fps = crowd(seed, 400)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    classes = spark.createDataFrame([(x, 1 + i % 3) for i, x in enumerate(signed)], "fp long, n long")
    found = simhash.links(classes, limit=limit, size=size)
    got = {r.vertex: r.component for r in connected_components(found).collect()}
    want = slow_components(dict(zip(signed, fps)))
    assert {x: got.get(x, x) for x in signed} == want
