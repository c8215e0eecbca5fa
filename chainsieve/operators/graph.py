"""Fund-flow graph operators on edge lists (src, dst, type, ts, amount_usd)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.session import cut_lineage


def trade_graph(trades: DataFrame) -> DataFrame:
    """Edge from seller to buyer per trade."""
    buy = F.col("side") == "buy"
    return trades.select(
        "trade_id", "ts", "amount_usd", F.when(buy, F.col("counterparty")).otherwise(F.col("wallet")).alias("src"),
        F.when(buy, F.col("wallet")).otherwise(F.col("counterparty")).alias("dst"), F.lit("trade").alias("type"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("wallet")).distinct()


def links(edges: DataFrame) -> DataFrame:
    """Distinct undirected pairs with ``a < b``."""
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst")).select(
        F.explode(F.array(F.struct(F.col("src").alias("wallet"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("wallet"), F.col("src").alias("other")))).alias("p")
    ).select("p.*").distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    deg = neighbour_pairs(edges).groupBy("wallet").agg(F.count(F.lit(1)).alias("neighbors"))
    size = vertices(edges).agg(F.count(F.lit(1)).alias("v"))  # one row
    score = F.when(F.col("v") > 1, F.col("neighbors") / (F.col("v") - 1)).otherwise(0.0)
    return deg.crossJoin(F.broadcast(size)).select("wallet", "neighbors", score.alias("centrality_score"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per wallet.

    Links point from the lower to the higher (degree, id), so no vertex starts
    more than about sqrt(2 E) links and a hub never fans out over its neighbours.
    """
    und = links(edges)
    both = und.select(F.explode(F.array("a", "b")).alias("v"))
    deg = both.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    da, db = deg.select(F.col("v").alias("a"), F.col("d").alias("da")), deg.select(F.col("v").alias("b"), F.col("d").alias("db"))
    fwd = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = und.join(da, "a").join(db, "b").select(
        F.when(fwd, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(fwd, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = out.alias("x").join(out.alias("y"), F.col("x.u") == F.col("y.u")).where(F.col("x.v") < F.col("y.v")).select(
        F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    closed = wedge.join(und, ["a", "b"], "left_semi")
    return closed.select(F.explode(F.array("u", "a", "b")).alias("wallet")).groupBy("wallet").agg(F.count(F.lit(1)).alias("triangles"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    deg = neighbour_pairs(edges).groupBy("wallet").agg(F.count(F.lit(1)).alias("k"))
    score = F.when(F.col("k") >= 2, F.coalesce("triangles", F.lit(0)) / (F.col("k") * (F.col("k") - 1) / 2.0)).otherwise(0.0)
    return deg.join(triangles(edges), "wallet", "left").select("wallet", score.alias("clustering_coefficient"))


def funding_sources(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type") == "fund_flow").groupBy(F.col("dst").alias("wallet")).agg(F.count_distinct("src").alias("common_funding_sources"))


def smart_connections(edges: DataFrame, known: DataFrame) -> DataFrame:
    hits = neighbour_pairs(edges).join(known.select(F.col("wallet").alias("other")), "other", "left_semi")
    return hits.groupBy("wallet").agg(F.count(F.lit(1)).alias("connected_smart_wallets"))


def graph_neighbors(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """Counterparties of each wallet, lowest ids first; ``cap`` is the size of a report."""
    if cap is None:
        return neighbour_pairs(edges)
    w = Window.partitionBy("wallet").orderBy("other")
    return neighbour_pairs(edges).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


def graph_signals(edges: DataFrame, known: DataFrame) -> DataFrame:
    base = degree_centrality(edges).withColumnRenamed("neighbors", "total_connections")
    for part in (clustering_coefficient(edges), funding_sources(edges), smart_connections(edges, known)):
        base = base.join(part, "wallet", "left")
    zero = {"clustering_coefficient": 0.0, "common_funding_sources": 0, "connected_smart_wallets": 0}
    return base.fillna(zero)


def fund_flow_bfs(edges: DataFrame, seeds: DataFrame, min_amount: float = 0.0, depth: int = 2) -> DataFrame:
    """Wallets reached from each seed within ``depth`` undirected hops.

    Each wallet keeps the hop that discovered it: the earliest (ts, id) edge, and
    its amount as strength. ``seeds`` has one column ``wallet``. From the second hop on,
    what a hop finds is written before the next one starts.
    """
    hop = edges.where(F.col("amount_usd") >= min_amount).select(
        F.explode(F.array(F.struct(F.col("src").alias("here"), F.col("dst").alias("there")), F.struct(F.col("dst").alias("here"), F.col("src").alias("there")))).alias("p"),
        "ts", "trade_id", "amount_usd").select("p.*", "ts", "trade_id", "amount_usd")
    frontier = seeds.select(F.col("wallet").alias("seed"), "wallet")
    visited, found = frontier, None
    for d in range(1, depth + 1):
        first = F.struct("ts", "trade_id", "here")
        step = (
            hop.join(frontier.withColumnRenamed("wallet", "here"), "here")
            .join(visited.withColumnRenamed("wallet", "there"), ["seed", "there"], "left_anti")
            .groupBy("seed", "there").agg(F.min_by("amount_usd", first).alias("amount"))
            .select("seed", F.col("there").alias("wallet"), F.lit(d).alias("depth"), "amount")
        )
        if 1 < d < depth:  # a later hop would hold the plans of all earlier ones several times over
            step = cut_lineage(step)
        found = step if found is None else found.unionByName(step)
        frontier = step.select("seed", "wallet")
        visited = visited.unionByName(frontier)
    return found.withColumn("strength", F.least(F.lit(1.0), F.col("amount") / 10000.0))


def connected_components(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(vertex, component = smallest member) by alternating large-star and small-star steps.

    Every round joins edges with a per-vertex minimum, so no neighbour list is
    ever gathered; the number of rounds grows with log of the diameter. Lineage
    is cut by a reliable checkpoint per round. Rounds go on until nothing changes;
    ``max_rounds`` raises where that takes longer.
    """
    edges = cut_lineage(pairs.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    mark = None
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        # large star: every larger neighbour is attached to the smallest of the neighbourhood
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the vertex itself are attached to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (state["n"], state["h"]):
            break
        mark = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)


def fund_flow_clusters(edges: DataFrame, min_transfers: int = 2) -> DataFrame:
    """Groups of wallets tied by at least two transfers either way; id = smallest member."""
    tied = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_transfers)
    return connected_components(tied).select(F.col("vertex").alias("wallet"), F.col("component").alias("cluster_id"))


def cluster_of(clusters: DataFrame, wallets: DataFrame) -> DataFrame:
    return wallets.join(clusters, "wallet", "left")


def cluster_members(clusters: DataFrame, wallets: DataFrame) -> DataFrame:
    """Other members of each given wallet's cluster."""
    mine = wallets.join(clusters, "wallet").select(F.col("wallet").alias("of_wallet"), "cluster_id")
    return clusters.join(mine, "cluster_id").where(F.col("wallet") != F.col("of_wallet")).select("of_wallet", "cluster_id", "wallet")


