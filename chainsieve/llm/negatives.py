"""Hard-negative mining over lists that the anchors of a cluster share.

Anchors are clustered by direction. Rows are dealt to shards; in each shard a cluster
sorts the shard's rows once, by an upper bound of the score that any of its anchors of
length one can have with them: the row's length times the cosine of its angle to the
cluster's centre less the cluster's own half-angle. Every anchor of the cluster walks
that list, and stops where its length times the next bound lies under the worst score
that it still wants: no later row can have a better one.

Rows move once per wave of anchors, and the anchors of a wave once to each shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.llm.topk import matrix

#: Rows of a shard, anchors of a wave, anchors and rows that are multiplied at once.
SHARD, WAVE, BLOCK, RUN = 16384, 65536, 512, 1024
#: Anchors that the centres are fitted on (those of least hash), centres at most, steps of the fit.
SAMPLE, CENTRES, STEPS = 4096, 64, 8
FOUND = "anchor_id long, place int, id long, score double"


def directions(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x**2).sum(1))[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are every so many rows."""
    unit = directions(x)
    out = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(STEPS):
        near = (unit @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, near, unit)
        out = np.where((total**2).sum(1, keepdims=True) > 0, directions(total), out)
    return out


def upper_bounds(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """For each row of x, no less than its inner product with any member, divided by the member's length."""
    unit, length = directions(members), np.sqrt((x**2).sum(1))
    centre = directions(unit.sum(0, keepdims=True))[0]
    if not centre.any():
        return length
    angle = lambda rows: np.arccos(np.clip(rows @ centre, -1, 1))
    own = angle(unit[(unit**2).sum(1) > 0])
    return length * (np.cos(np.maximum(0, angle(directions(x)) - own.max(initial=0))) + 1e-7)  # more than what rounding loses


def walk(x: np.ndarray, bound: np.ndarray, ids: np.ndarray, q: np.ndarray, fits, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place, row, score): the k best rows at each of an anchor's places.

    The list is in descending order of ``bound``. ``least[anchor, place]`` is the lowest
    score wanted; ``fits(anchors, rows, scores, place)`` says which scores count.
    """
    n, places = least.shape
    length = np.sqrt((q**2).sum(1))
    worst = least.astype(float).copy()
    none = np.zeros(0, np.int64)
    held = (none, none, np.zeros(0))  # anchor * places + place, row, score
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal held, new
        slot, row, score = (np.concatenate([h, *(p[i] for p in new)]) for i, h in enumerate(held))
        order = np.lexsort((ids[row], -score, slot))
        s = slot[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        at = np.arange(len(s))
        top = order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]
        held, new = (slot[top], row[top], score[top]), []
        count = np.bincount(held[0], minlength=n * places)
        full = np.flatnonzero(count >= k)
        last = held[2][np.cumsum(count)[full] - 1]
        worst.reshape(-1)[full] = np.maximum(worst.reshape(-1)[full], last)

    active = np.flatnonzero(np.isfinite(worst).any(1) | (worst == -np.inf).any(1))
    for at in range(0, len(x), RUN):
        wanted = worst[active].min(1)
        active = active[length[active] * bound[at] + 1e-6 >= wanted]
        if not len(active):
            break
        rows = np.arange(at, min(at + RUN, len(x)))
        scores = q[active] @ x[rows].T
        for p in range(places):
            a, b = np.nonzero((scores >= worst[active, p][:, None]) & fits(active, rows, scores, p))
            new.append((active[a] * places + p, rows[b], scores[a, b]))
        merge()
    return held[0] // places, held[0] % places, held[1], held[2]


def _in_shard(left: pa.Table, right: pa.Table, k: int, same_label: bool) -> pa.Table:
    """What a shard's rows (left) give to a wave's anchors (right), cluster by cluster."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    if left.num_rows and right.num_rows:
        width = len(left.column("v")[0])
        x, q = matrix(left.column("v"), width), matrix(right.column("q"), width)
        ids, label = left.column("id").to_numpy(), left.column("label").to_numpy()
        anchor, own, cluster = (right.column(c).to_numpy() for c in ("anchor_id", "own", "cluster"))
        low, high = (np.array(right.column(c).to_pylist(), float).reshape(len(q), -1) for c in ("low", "high"))
        for c in np.unique(cluster):
            members = np.flatnonzero(cluster == c)
            bound = upper_bounds(x, q[members])
            order = np.argsort(-bound, kind="stable")
            xs, bs, is_, ls = x[order], bound[order], ids[order], label[order]
            for part in np.array_split(members, math.ceil(len(members) / BLOCK)):

                def fits(a: np.ndarray, rows: np.ndarray, scores: np.ndarray, p: int, part: np.ndarray = part) -> np.ndarray:
                    a = part[a]
                    same = ls[rows] == own[a][:, None]
                    return (same & (is_[rows] != anchor[a][:, None]) if same_label else ~same) & (scores <= high[a, p][:, None])

                a, p, row, score = walk(xs, bs, is_, q[part], fits, low[part], k)
                out.append((anchor[part[a]], p, is_[row], score))
    a, p, i, s = (np.concatenate([o[j] for o in out]) for j in range(4))
    return pa.table({"anchor_id": pa.array(a, pa.int64()), "place": pa.array(p, pa.int32()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})


def _clusters(anchors: DataFrame, n: int) -> Column:
    """The number of the nearest centre to ``q``, as a column."""
    sample = anchors.orderBy(F.xxhash64("anchor_id"), "anchor_id").select("q").limit(SAMPLE).collect()
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(len(r["q"]), []).append(r["q"])
    fitted = {w: centres(np.array(v, float), min(CENTRES, math.ceil(n / 64))) for w, v in by_width.items()}

    @F.pandas_udf("int")
    def nearest(q: pd.Series) -> pd.Series:
        return pd.Series([int((fitted[len(v)] @ v).argmax()) if len(v) in fitted else 0 for v in q], dtype="int32")

    return nearest("q")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are integer inner products, higher first,
    ties to the smaller id, and exact while a vector's sum of squares stays under 2^53.
    An anchor's positives are its ``positives`` best other rows of its label. For each of
    them come the ``negatives`` best rows of other labels whose score s satisfies
    low * p <= 100 * s <= high * p, with p the positive's score; an anchor or positive
    without such rows returns none. ``is_anchor`` is a condition on ``id``.

    Rows with a null id, label or vector, an empty vector or one with a null or
    non-finite component take no part. Vectors of different widths are not compared.
    Rows with one id are separate candidates, but never those of an anchor with that id;
    of repeated anchor rows the least (label, vector) asks once. Other columns are not read.
    """
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = raw.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"), F.size("v").alias("width"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("q")).first()
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(math.ceil(facts["n"] / SHARD), min(partitions, math.ceil(facts["n"] / 1024)), 1)
    waves = max(1, math.ceil(facts["q"] / WAVE))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int").alias("shard")
    offered = rows.select("width", shard, F.explode(F.sequence(F.lit(0), F.lit(waves - 1))).alias("wave"), "id", "label", "v")
    anchors = rows.where(is_anchor).groupBy(F.col("id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a")).select("anchor_id", F.col("a.label").alias("own"), F.col("a.v").alias("q"))
    anchors = anchors.withColumn("cluster", _clusters(anchors, facts["q"]))

    def asked(who: DataFrame, k: int, same_label: bool) -> DataFrame:
        everywhere = who.select(
            F.size("q").alias("width"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("anchor_id"), F.lit(waves)).cast("int").alias("wave"), *who.columns)
        cells = ("width", "shard", "wave")
        return offered.groupBy(*cells).cogroup(everywhere.groupBy(*cells)).applyInArrow(lambda a, b: _in_shard(a, b, k, same_label), FOUND)

    def best(found: DataFrame, k: int, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    any_score = F.array(F.lit(float("-inf"))).alias("low"), F.array(F.lit(float("inf"))).alias("high")
    first = best(asked(anchors.select("*", *any_score), positives, True), positives, "anchor_id")
    own = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("own_positives"))
    # an unused place wants scores between infinity and its opposite: none
    place = lambda value, rest: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(value(F.get("own_positives", i)["score"]), F.lit(rest)))
    wanted = anchors.join(own, "anchor_id").withColumns(
        {"low": place(lambda s: F.ceil(s * low / 100).cast("double"), float("inf")), "high": place(lambda s: F.floor(s * high / 100).cast("double"), float("-inf"))})
    second = best(asked(wanted.drop("own_positives"), negatives, False), negatives, "anchor_id", "place")
    named = own.select("anchor_id", F.explode("own_positives").alias("p")).select("anchor_id", (F.col("p.rank") - 1).alias("place"), F.col("p.id").alias("positive_id"), F.col("p.score").cast("long").alias("positive_score"))
    return second.join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))


#: The registered query in DuckDB, by brute force.
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
