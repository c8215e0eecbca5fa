"""Registered queries: pattern clusters, timelines, nested documents, set operations and table checks."""

from pyspark.sql import functions as F

from chainsieve.operators import features as ft
from chainsieve.operators import graph as g
from chainsieve.operators import patterns as pt
from chainsieve.operators import risk as rk
from chainsieve.operators import wallet as w
from chainsieve.operators.matching import fifo_match
from chainsieve.plans import reports as rp
from chainsieve.plans.catalog_features import TRANSFERS, market, token_transfers
from chainsieve.plans.catalog_wallet import UNREAL
from chainsieve.plans.registry import query
from chainsieve.schemas import duplicate_keys
from chainsieve.sources import readers as rd
from chainsieve.tables import as_of


def _clusters_sql(limit):
    return f"""WITH RECURSIVE sg AS (SELECT wallet, avg(holding_hours) AS h, avg((pnl > 0)::INT) AS wr, count(*) AS n FROM v_closed GROUP BY wallet), s2 AS (SELECT wallet, greatest(h, 0) AS h, wr, n FROM sg),
 pr AS MATERIALIZED (SELECT a.wallet AS a, b.wallet AS b FROM s2 a JOIN s2 b ON a.wallet <> b.wallet AND abs(a.h - b.h) / (greatest(a.h, b.h) + 1) + abs(a.wr - b.wr) + abs(a.n - b.n) / (greatest(a.n, b.n) + 1) < {limit}),
 rc AS (SELECT DISTINCT a AS wallet, a AS m FROM pr UNION SELECT pr.b, rc.m FROM rc JOIN pr ON pr.a = rc.wallet WHERE rc.m < pr.b)
 SELECT wallet, min(m) AS cluster_id FROM rc GROUP BY wallet"""


@query("pattern_clusters", _clusters_sql(0.9))
def _(t):
    return pt.pattern_clusters(pt.trading_signature(fifo_match(t.trades)))


@query("pattern_clusters_tight", _clusters_sql(0.12))
def _(t):
    return pt.pattern_clusters(pt.trading_signature(fifo_match(t.trades)), 0.04)


@query("cluster_members", """WITH RECURSIVE td AS MATERIALIZED (SELECT a, b FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM v_edges WHERE src <> dst) GROUP BY a, b HAVING count(*) >= 2),
 sy AS MATERIALIZED (SELECT a, b FROM td UNION SELECT b, a FROM td), rc AS (SELECT DISTINCT a AS wallet, a AS m FROM sy UNION SELECT sy.b, rc.m FROM rc JOIN sy ON sy.a = rc.wallet WHERE rc.m < sy.b), cl AS (SELECT wallet, min(m) AS cluster_id FROM rc GROUP BY wallet)
 SELECT x.wallet AS of_wallet, x.cluster_id, y.wallet FROM cl x JOIN cl y ON x.cluster_id = y.cluster_id AND x.wallet <> y.wallet WHERE x.wallet IN (FROM v_busiest)""")
def _(t):
    return g.cluster_members(g.fund_flow_clusters(t.edges), t.busiest)


# ---------------------------------------------------------------- timelines and documents
def _pool_events(t):
    kind = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "view", "remove").when(F.col("event_type") == "click", "lock").otherwise("unlock")
    return t.events.select((F.col("event_id") % 10).cast("int").alias("token"), "ts", kind.alias("type"), F.col("value").alias("value_usd"))


LOCK_NOW = "2024-01-15 00:00:00"


@query("lp_locked", f"""WITH s AS (SELECT event_id % 10 AS token, CAST(sum(CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 0 WHEN 'click' THEN CAST(value AS DECIMAL(30,12)) ELSE -CAST(value AS DECIMAL(30,12)) END) AS DOUBLE) AS held
 FROM events WHERE ts <= TIMESTAMP '{LOCK_NOW}' GROUP BY 1) SELECT CAST(token AS INT) AS token, held > 0 AS lp_locked, round(greatest(held, 0), 6) AS lp_locked_usd FROM s""")
def _(t):
    return ft.lp_locked(_pool_events(t), F.lit(LOCK_NOW).cast("timestamp"))


def _token_posts(t):
    return t.posts.withColumn("token", (F.col("post_id") % 10).cast("int"))


def _developers(t):
    return t.trades.groupBy("token").agg(F.min_by("wallet", "ts").alias("address"))


def _timelines(t):
    return rp.timelines(rp.liquidity_timeline(_pool_events(t)), rp.mention_timeline(_token_posts(t)), rp.developer_timeline(token_transfers(t), _developers(t)))


def _words(ws):
    return " + ".join(f"contains(lower(text), '{x}')::INT" for x in ws)


@query("timelines", f"""WITH {TRANSFERS}, dv AS (SELECT token, min_by(wallet, ts) AS address FROM v_trades GROUP BY token)
 SELECT event_id % 10 AS token, 'liquidity' AS timeline, ts, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'remove' WHEN 'click' THEN 'lock' ELSE 'unlock' END AS label, round(value, 6) AS amount, NULL::DOUBLE AS score FROM events
 UNION ALL SELECT post_id % 10, 'mentions', date_trunc('hour', ts)::TIMESTAMP, source, count(*), round(avg(sign(({_words(ft.POSITIVE)}) - ({_words(ft.NEGATIVE)}))), 6) FROM v_posts GROUP BY ALL
 UNION ALL SELECT xf.token, 'dev_transfers', ts, 'out', round(amount_usd, 6), NULL FROM xf JOIN dv ON dv.token = xf.token AND dv.address = xf.src
 UNION ALL SELECT xf.token, 'dev_transfers', ts, 'in', round(amount_usd, 6), NULL FROM xf JOIN dv ON dv.token = xf.token AND dv.address = xf.dst""")
def _(t):
    return _timelines(t)


@query("max_trades", "SELECT wallet, trade_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, trade_id) AS rn FROM v_trades) WHERE rn <= 5")
def _(t):
    return rp.max_trades(t.trades, 5).select("wallet", "trade_id", "ts")


@query("token_score")
def _(t):
    tokens = t.trades.select("token").distinct()
    risk = rk.contract_risk(t.security_flags).select("token", "risk_score", "risk_level", "flags")
    m = ft.liquidity_features(ft.market_features(market(t), as_of())).drop("pair_created_at")
    held = ft.holders_from_transfers(token_transfers(t))
    features = m.join(ft.holder_stats(held).drop("supply"), "token", "left")
    doc = rp.token_score(rk.base_rate_heatmap(tokens), risk, features, _timelines(t), ft.top_holders(held), as_of=as_of())
    return doc.select("token", F.to_json(F.struct("*")).alias("document"))


def wallet_documents(t):
    closed = fifo_match(t.trades)
    ranks = w.rank_wallets(w.wallet_metrics(closed, per_chain=False), "pnl").select("wallet", "rank", "total", "percentile")
    marked = w.price_change_5m(t.trades)
    patterns = w.behavior_patterns(closed, marked, t.listings, w.alternation_wash_score(t.trades))
    held = w.unrealized_pnl(t.positions, w.current_prices(t.prices))
    return rp.wallet_report(w.win_rates(closed, as_of()), w.realized_pnl(closed), w.breakdown(closed, "token"), closed, patterns, ranks, unrealized=held, as_of=as_of())


@query("wallet_report")
def _(t):
    return wallet_documents(t).select("wallet", F.to_json(F.struct("*")).alias("document"))


@query("wallet_report_cells", f"""WITH u AS (SELECT wallet, sum(unrealized_pnl) AS total, count(*) AS positions FROM ({UNREAL}) GROUP BY wallet),
 c AS (SELECT wallet, count(DISTINCT token) AS tokens, count(*) AS n, sum(pnl) AS pnl, count(*) FILTER (WHERE pnl > 0) AS wins, max(exit_ts) AS newest FROM v_closed GROUP BY wallet)
 SELECT c.wallet, tokens, least(n, 100) AS trades, round(pnl, 4) AS realized, wins, newest, rank() OVER (ORDER BY round(pnl, 6) DESC) AS place, round(total, 4) AS unrealized, positions FROM c LEFT JOIN u ON u.wallet = c.wallet""", digits=4)
def _(t):
    """The documents' parts as columns; wallets with equal profit share the better place."""
    doc = wallet_documents(t)
    add = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    parts = doc.select(
        "wallet", F.size("token_breakdown").cast("long").alias("tokens"), F.size("trades").cast("long").alias("trades"), add(F.transform("token_breakdown", lambda x: x["total_pnl"]), F.lit(0.0)).alias("realized"),
        add(F.transform("token_breakdown", lambda x: x["wins"].cast("long")), F.lit(0).cast("long")).alias("wins"),
        F.get("trades", F.lit(0))["exit_ts"].alias("newest"), F.col("ranking.rank").alias("rank"), F.col("unrealized_pnl.total").alias("unrealized"), F.col("unrealized_pnl.positions").alias("positions"))
    tied = parts.groupBy(F.round("realized", 6).alias("r")).agg(F.min("rank").cast("long").alias("place"))
    return parts.withColumn("r", F.round("realized", 6)).join(tied, "r").drop("r", "rank")


# ---------------------------------------------------------------- set operations
@query("token_set_operations", """WITH h AS (SELECT DISTINCT wallet, token FROM v_trades), m AS (SELECT DISTINCT token FROM v_trades WHERE wallet IN (FROM v_busiest)),
 c AS (SELECT h.wallet, count(*) AS n, count(m.token) AS shared FROM h LEFT JOIN m ON m.token = h.token GROUP BY h.wallet) SELECT wallet, shared AS in_both, n + (SELECT count(*) FROM m) - shared AS in_either FROM c""")
def _(t):
    held = t.trades.select("wallet", "token").distinct()
    mine = held.join(t.busiest, "wallet", "left_semi").select("token", F.lit(1).alias("shared"))
    size = mine.agg(F.count(F.lit(1)).alias("size"))  # one row
    n = held.join(mine, "token", "left").groupBy("wallet").agg(F.count(F.lit(1)).alias("n"), F.count("shared").alias("in_both"))
    return n.crossJoin(F.broadcast(size)).select("wallet", "in_both", (F.col("n") + F.col("size") - F.col("in_both")).alias("in_either"))


@query("flag_union", """WITH u AS (SELECT s_nationkey AS chain, unnest([CASE WHEN s_suppkey % 2 = 0 THEN 'proxy' END, CASE WHEN s_suppkey % 3 = 0 THEN 'mintable' END, CASE WHEN s_suppkey % 5 = 0 THEN 'honeypot' END]) AS f FROM supplier)
 SELECT chain, string_agg(f, ',' ORDER BY f) AS flags FROM (SELECT DISTINCT chain, f FROM u WHERE f IS NOT NULL) GROUP BY chain""")
def _(t):
    k = F.col("s_suppkey")
    found = F.array_compact(F.array(F.when(k % 2 == 0, F.lit("proxy")), F.when(k % 3 == 0, F.lit("mintable")), F.when(k % 5 == 0, F.lit("honeypot"))))
    each = t.raw("supplier").select(F.col("s_nationkey").alias("chain"), F.explode(found).alias("f")).distinct()
    return each.groupBy("chain").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("flags"))  # at most one entry per kind of flag


# ---------------------------------------------------------------- tables
@query("duplicate_trade_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("contract_feed", """SELECT s_suppkey AS token, s_suppkey % 3 <> 0 AS is_verified, CASE WHEN s_suppkey % 3 <> 0 THEN 'v0.' || (s_suppkey % 9) ELSE '' END AS compiler_version, s_suppkey % 5 = 0 AS is_proxy FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    source = F.when(k % 3 != 0, F.lit("contract X {}")).otherwise("")
    raw = t.raw("supplier").select(k.alias("token"), F.to_json(F.struct(
        source.alias("SourceCode"), F.when(k % 3 != 0, F.concat(F.lit("v0."), (k % 9).cast("string"))).otherwise("").alias("CompilerVersion"),
        F.when(k % 5 == 0, "1").otherwise("0").alias("Proxy"), F.col("s_name").alias("ContractName"))).alias("payload"))
    return rd.contract_feed(raw).select("token", "is_verified", "compiler_version", "is_proxy")


