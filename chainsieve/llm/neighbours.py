"""Approximate nearest neighbours through learned partitions.

A neighbour graph over a bounded sample is cut into parts of equal size with few
edges between them; a small classifier learns to tell a vector's part, from the parts
of its neighbours. It puts every row of the table into a part and sends a query to
its most probable parts, where all rows are scored exactly. How many parts a query
visits is set on sample vectors kept back from the fit, for a stated recall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.topk import best, matrix, merged, packed, usable, width_of

#: Vectors that the partition is learned on, at most about; rows per part aimed at; rows and queries in one cell.
SAMPLE, PER_PART, CELL, BLOCK = 4000, 1500, 8192, 4096
#: Fewest and most parts.
PARTS = (8, 64)
#: Widths of vectors that get a learned partition, those with most rows; rows of any other are one part, searched whole.
WIDTHS = 4
FOUND = "query_id long, ids array<long>, scores array<double>"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row of x, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Parts of equal size (within one) by recursive bisection of the graph.

    A half is split at the median of a smooth vector on the graph (the slowest
    eigenvector, by power iteration); then pairs swap sides while that cuts fewer edges.
    """
    n = len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        own, first, count = todo.pop()
        if count == 1 or len(own) < 2:
            label[own] = first
            continue
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        inside = (place[a] >= 0) & (place[b] >= 0)
        p, q = place[a[inside]], place[b[inside]]
        degree = np.maximum(np.bincount(p, minlength=len(own)), 1)
        v = rng.standard_normal(len(own))
        for _ in range(60):
            v -= (v * degree).sum() / degree.sum()
            v = 0.5 * v + 0.5 * np.bincount(p, v[q], len(own)) / degree
            v /= max(np.abs(v).max(), 1e-300)
        left = count // 2
        size = len(own) * left // count
        order = np.argsort(v, kind="stable")
        side = np.ones(len(own), bool)
        side[order[:size]] = False
        for _ in range(20):
            right = np.bincount(p, side[q].astype(float), len(own))
            gain = np.where(side, degree - 2 * right, 2 * right - degree)
            out_, in_ = np.flatnonzero(~side), np.flatnonzero(side)
            out_, in_ = out_[np.argsort(-gain[out_], kind="stable")], in_[np.argsort(-gain[in_], kind="stable")]
            m = min(len(out_), len(in_))
            m = int((gain[out_[:m]] + gain[in_[:m]] > 0).sum())
            if not m:
                break
            m = max(1, m // 4)  # gains change with each swap
            side[out_[:m]], side[in_[:m]] = True, False
        todo.append((own[~side], first, left))
        todo.append((own[side], first + left, count - left))
    return label


@dataclass
class Router:
    """One hidden layer from a vector to the probabilities of its parts."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300) - self.mean
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def fit_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, rounds: int = 60, seed: int = 0) -> Router:
    """Cross-entropy against ``target`` (the shares of parts among a row and its neighbours), by Adam."""
    rng = np.random.default_rng(seed)
    unit = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)
    mean = unit.mean(0)
    unit = unit - mean
    d, parts = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, hidden)) * math.sqrt(2 / d) * 2, np.zeros(hidden), rng.standard_normal((hidden, parts)) * math.sqrt(1 / hidden), np.zeros(parts)]
    m, s, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for r in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            i = order[a : a + 256]
            h = np.maximum(unit[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - target[i]) / len(i)
            dh = (dz @ w[2].T) * (h > 0)
            grads = [unit[i].T @ dh + 1e-5 * w[0], dh.sum(0), h.T @ dz + 1e-5 * w[2], dz.sum(0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - 2e-3 * (1 - r / rounds) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, *w)


def learn(x: np.ndarray, parts: int, k: int, recall: float) -> Router:
    """A router from sample vectors, with the probes that reach ``recall`` of the k nearest on a tenth kept back.

    In a sample the k nearest lie farther off than in the table, so k is that share of
    the neighbours asked for (three at least) that a sample of this size has.
    """
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(np.zeros(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    held, own = x[::10], np.delete(x, np.s_[::10], axis=0)
    unit = own / np.maximum(np.sqrt((own**2).sum(1, keepdims=True)), 1e-300)
    graph = neighbour_graph(unit, min(12, len(own) - 1))
    label = balanced_parts(graph, parts)
    target = np.eye(parts)[label] * 0.5 + np.eye(parts)[label[graph]].mean(1) * 0.5
    router = fit_router(own, target)
    at = router.part(own)
    near = neighbours_of(held, own, min(k, len(own)))
    rank = np.argsort(np.argsort(-router.logits(held), axis=1, kind="stable"), axis=1)
    visits = np.sort(np.take_along_axis(rank, at[near], axis=1).ravel())
    router.probes = int(visits[min(len(visits) - 1, math.ceil(recall * len(visits)))]) + 1
    return router


def neighbours_of(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]


def sequential(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added component by component, so equal vectors get equal scores."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def scored(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int):
    """The k best rows of one cell for each query."""
    parts = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[q_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        take = min(k, s.shape[1])
        kth = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
        i, j = np.nonzero((s >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]) & (s > -np.inf))
        exact = sequential(q[a + i], x[j])
        top = best(i, ids[j], exact, k)
        parts.append((i[top] + a, ids[j][top], exact[top]))
    return tuple(np.concatenate([p[n] for p in parts]) for n in range(3))


def approximate_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96, sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query, ties to the smaller id.

    The partition is learned on about ``sample`` vectors, picked by a hash of the id;
    every row is indexed. A vector that is null, empty or zero, or holds a null or
    non-finite component, takes no part, nor does a null id. Vectors of different
    widths are not compared: the four widths with most rows have a partition each, any
    other width is one part and searched exactly. A query skips all rows with its id;
    of repeated queries of one width the least vector is searched, and an id with
    queries of several widths gets the best of all. A part is split into cells of
    bounded size, so copies of one vector that fill a part are scored in many tasks.
    """
    spark = vectors.sparkSession
    ready = usable(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0.0))
    facts = ready.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()  # a row per width
    facts.sort(key=lambda r: (-r["n"], r["w"]))
    learned = {r["w"]: r["n"] for r in facts[:WIDTHS]}
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id", "v"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for w, n in learned.items():
        share = F.when(F.size("v") == w, F.lit(min(1.0, sample / n))).otherwise(share)
    picked: dict[int, list] = {w: [] for w in learned}
    for r in ready.where(chance < share).distinct().collect():  # about ``sample`` rows per learned width
        picked[len(r["v"])].append((r["id"], r["v"]))
    routers, parts = {}, 0
    for r in facts:
        w, n = r["w"], r["n"]
        x = np.array([v for _, v in sorted(picked.get(w, ()))]).reshape(-1, w)
        x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])] if len(x) else x  # copies of one vector teach nothing
        router = learn(x, min(max(n // PER_PART, PARTS[0]), PARTS[1]), max(3, math.ceil(k * len(x) / n)), recall) if w in learned else None
        routers[w] = (parts, router)
        parts += router.w2.shape[1] if router else 1
    routing = spark.sparkContext.broadcast(routers)  # at most width x hidden + hidden x parts numbers per learned width

    def asked(column: pa.Array, answer: Callable[[Router, np.ndarray], np.ndarray]) -> list:
        """The parts (a number or a row of numbers) for each vector, numbered over all widths."""
        out, lengths = [None] * len(column), pc.list_value_length(column).to_numpy(zero_copy_only=False)
        for w in np.unique(lengths):
            at, (first, router) = np.flatnonzero(lengths == w), routing.value[int(w)]
            own = answer(router, matrix(column.take(pa.array(at)), int(w))) if router else np.zeros((len(at), 1), int)
            for i, p in zip(at, (own + first).tolist()):
                out[i] = p
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [p[0] for p in asked(batch.column(1), lambda r, v: r.part(v)[:, None])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["id", "v", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = asked(batch.column(1), lambda r, v: r.routes(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.list_(pa.int32()))], names=["query", "q", "parts"])

    placed = ready.select("id", "v").mapInArrow(place, "id long, v array<double>, part int")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one number per part
    cells = {p: max(1, math.ceil(c / CELL)) for p, c in sizes.items()}
    blocks = max(1, math.ceil(sum(r["q"] for r in facts) / BLOCK))
    of_part = F.create_map(*[F.lit(v) for p, c in cells.items() for v in (p, c)]) if cells else F.create_map(F.lit(0), F.lit(1))
    cell = F.pmod(F.xxhash64(F.lit("cell"), "id", "v"), of_part[F.col("part")]).cast("int")
    rows = placed.select("part", cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asking = ready.where(is_query).groupBy("id", F.size("v")).agg(F.min("v").alias("v")).select("id", "v").mapInArrow(route, "query long, q array<double>, parts array<int>")
    asking = asking.select("query", "q", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("of_block"), F.explode("parts").alias("of_part")).where(of_part[F.col("of_part")].isNotNull())
    asking = asking.select("of_part", F.explode(F.sequence(F.lit(0), of_part[F.col("of_part")] - 1)).alias("of_cell"), "of_block", "query", "q")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        width = width_of(left.column("v"), right.column("q"))  # a part holds vectors of one width
        x, q = matrix(left.column("v"), width), matrix(right.column("q"), width)
        if not len(x) or not len(q):
            return packed(np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        q_ids = right.column("query").to_numpy()
        return packed(q_ids, scored(x, left.column("id").to_numpy(), q, q_ids, k))

    found = rows.groupBy("part", "cell", "block").cogroup(asking.groupBy("of_part", "of_cell", "of_block")).applyInArrow(meet, FOUND)
    return merged(found, k, F.col("score"))
