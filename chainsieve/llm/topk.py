"""Exact top-k by inner product with ball trees.

Rows are dealt to shards, and each shard builds a ball tree over its vectors. For a
query q a node with centre c and radius r holds no score above q.c + |q| r; leaves
are visited in the order of that bound, and not at all once it lies below the k-th
score so far. A query first searches its home shard; the k-th score found there goes
along to all other shards, so they begin with a bound instead of none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, SHARD, BLOCK = 64, 8192, 4096
FOUND = "query_id long, ids array<long>, scores array<double>"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (doubles) of the rows whose vector has only finite components, and some."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & finite)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray) or not len(flat):
        return np.zeros((0, width))
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def width_of(*columns: pa.ChunkedArray) -> int:
    """The width of the vectors in a group, all of one width; either column may be empty."""
    return next((len(c[0]) for c in columns if len(c)), 1)


class BallTree:
    """Balls over halves of halves; ``lo, hi`` are ranges of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.parent = [0], [len(x)], [-1]
        leaves, at = [], 0
        while at < len(self.lo):
            lo, hi = self.lo[at], self.hi[at]
            own = self.order[lo:hi]
            if hi - lo > leaf:
                far = x[own[np.argmax(((x[own] - x[own[0]]) ** 2).sum(1))]]
                other = x[own[np.argmax(((x[own] - far) ** 2).sum(1))]]
                along = x[own] @ (far - other)
                mid = (hi - lo) // 2
                self.order[lo:hi] = own[np.argpartition(along, mid)]
                self.lo += [lo, lo + mid]
                self.hi += [lo + mid, hi]
                self.parent += [at, at]
            else:
                leaves.append(at)
            at += 1
        self.leaves = np.array(leaves)
        self.centre = np.array([x[self.order[a:b]].mean(0) if b > a else np.zeros(x.shape[1]) for a, b in zip(self.lo, self.hi)])
        self.radius = np.array([math.sqrt(((x[self.order[a:b]] - c) ** 2).sum(1).max()) if b > a else 0.0 for a, b, c in zip(self.lo, self.hi, self.centre)])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of every query's scores in every leaf: no ball of a leaf's ancestors allows more."""
        length = np.sqrt((q**2).sum(1))
        own = q @ self.centre.T + length[:, None] * self.radius
        own += 1e-9 * (np.abs(own) + length[:, None] * (1 + np.abs(self.centre).max(initial=0)))
        for at in range(1, len(self.lo)):
            np.minimum(own[:, at], own[:, self.parent[at]], out=own[:, at])
        return own[:, self.leaves]


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best entries, by score, then smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.ones(len(q), bool)
    first[1:] = q[1:] != q[:-1]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best per query with a score of ``least`` or more; a query's own id is no candidate."""
    kth = least.astype(float).copy()
    none = np.zeros(0, np.int64)
    held = (none, none, np.zeros(0))
    if not len(x) or not len(q):
        return held
    tree = BallTree(x)
    bound = tree.bounds(q)

    def merge(new: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        nonlocal held
        joined = [np.concatenate([h, *(p[i] for p in new)]) for i, h in enumerate(held)]
        top = best(*joined, k)
        held = tuple(c[top] for c in joined)
        count = np.bincount(held[0], minlength=len(q))
        last = np.cumsum(count) - 1
        full = count >= k
        kth[full] = np.maximum(kth[full], held[2][last[full]])

    new, size = [], 0
    # each round takes the next best leaf of every query; equal leaves are scored together
    ranked = np.argsort(-bound, axis=1)
    for step in range(bound.shape[1]):
        leaf = ranked[:, step]
        open_ = np.flatnonzero(bound[np.arange(len(q)), leaf] >= kth)
        if not len(open_):
            break
        by = open_[np.argsort(leaf[open_], kind="stable")]
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            node = tree.leaves[leaf[part[0]]]
            own = tree.order[tree.lo[node] : tree.hi[node]]
            scores = q[part] @ x[own].T
            a, b = np.nonzero(scores >= kth[part][:, None])
            other = ids[own[b]] != q_ids[part[a]]
            a, b = a[other], b[other]
            new.append((part[a], ids[own[b]], scores[a, b]))
            size += len(a)
        if step < 2 or size > 20_000:
            merge(new)
            new, size = [], 0
    merge(new)
    return held


def packed(query_ids: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    """One row per query with some result."""
    q, ids, scores = held
    first = np.flatnonzero(np.diff(q, prepend=-1))
    edges = np.append(first, len(q)).astype(np.int32)
    return pa.table(
        {
            "query_id": pa.array(query_ids[q[first]], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(edges), pa.array(ids, pa.int64())),
            "scores": pa.ListArray.from_arrays(pa.array(edges), pa.array(scores, pa.float64())),
        }
    )


def merged(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The k best of each query over all partial results, ranked."""
    blocks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(table: pa.Table) -> pa.Table:
        ids, scores = table.column("ids").combine_chunks(), table.column("scores").combine_chunks()
        lengths = np.diff(ids.offsets.to_numpy())
        query = np.repeat(table.column("query_id").to_numpy(), lengths)
        ids, scores = ids.flatten().to_numpy(), scores.flatten().to_numpy()
        top = best(query, ids, scores, k)
        query = query[top]
        first = np.ones(len(query), bool)
        first[1:] = query[1:] != query[:-1]
        at = np.arange(len(query))
        rank = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
        return pa.table({"query_id": query, "rank": rank.astype(np.int32), "vec_id": ids[top], "score": scores[top]})

    block = F.pmod(F.xxhash64("query_id"), F.lit(16 * blocks)).alias("block")
    rows = found.withColumn("block", block).groupBy("block").applyInArrow(run, "query_id long, rank int, vec_id long, score double")
    return rows.select("query_id", "rank", "vec_id", score.alias("score"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    Components become floor(scale * x). ``is_query`` is a condition on ``id``. A
    vector that is null or empty, or holds a null or non-finite component, takes no
    part, nor does a null id. Vectors of different widths are not compared. Rows with
    one id are separate candidates, and a query skips all rows with its id; of repeated
    query rows of one width the least vector is searched, and an id with query rows of
    several widths gets the best of all. Scores are exact while the sum of squares of a
    vector stays under 2^53. Queries and rows meet in cells of a width, a shard and a
    block of queries, each of bounded size.
    """
    ready = usable(vectors, id_col, vector_col).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))
    facts = ready.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(math.ceil(facts["n"] / SHARD), min(partitions, math.ceil(facts["n"] / 1024)), 1)
    blocks = max(1, math.ceil(facts["q"] / BLOCK))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int")
    rows = ready.select("id", "v", is_query.alias("asks"), F.size("v").alias("width"), shard.alias("shard"))
    queries = rows.where("asks").groupBy("id", "width", "shard").agg(F.min("v").alias("v"))

    def home(table: pa.Table) -> pa.Table:
        x, ids = matrix(table.column("v"), width_of(table.column("v"))), table.column("id").to_numpy()
        asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False).astype(bool))
        asks = asks[np.lexsort((*x[asks].T[::-1], ids[asks]))]  # of rows with one id, the least vector asks
        asks = asks[np.diff(ids[asks], prepend=ids[asks[0]] - 1) != 0] if len(asks) else asks
        return packed(ids[asks], search(x, ids, x[asks], ids[asks], np.full(len(asks), -np.inf), k))

    first = rows.groupBy("width", "shard").applyInArrow(home, FOUND)

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        width = width_of(left.column("v"), right.column("q"))
        x, q = matrix(left.column("v"), width), matrix(right.column("q"), width)
        q_ids = right.column("query").to_numpy()
        return packed(q_ids, search(x, left.column("id").to_numpy(), q, q_ids, right.column("least").to_numpy(), k))

    none = F.lit(float("-inf"))
    least = first.groupBy(F.col("query_id").alias("id")).agg(F.max(F.when(F.size("scores") >= k, F.array_min("scores")).otherwise(none)).alias("least"))
    asked = queries.join(least, "id", "left").select("width", F.col("shard").alias("home"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v", F.coalesce("least", none).alias("least"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != F.col("home"))
    offered = rows.select("width", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = asked.select(F.col("width").alias("of_width"), F.col("shard").alias("of"), F.col("block").alias("part"), F.col("id").alias("query"), F.col("v").alias("q"), "least")
    second = offered.groupBy("width", "shard", "block").cogroup(asked.groupBy("of_width", "of", "part")).applyInArrow(elsewhere, FOUND)
    return merged(first.unionByName(second), k, F.col("score").cast("long"))


#: The same rows in DuckDB, by brute force.
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
