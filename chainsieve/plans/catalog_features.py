"""Registered queries: token, holder, pool, social and stored features; risk; reports' parts."""

import uuid

from pyspark.sql import functions as F

from chainsieve import schemas
from chainsieve.operators import features as ft
from chainsieve.operators import risk as rk
from chainsieve.operators import wallet as w
from chainsieve.operators.matching import fifo_match
from chainsieve.plans.catalog_wallet import SANDWICH, TIMING, WASH
from chainsieve.plans.registry import query
from chainsieve.session import checkpoint_dir
from chainsieve.sources import writers
from chainsieve.tables import as_of, money

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def market(t):
    """One market row per token: last day's volume and trade counts, latest liquidity."""
    day = F.col("ts") >= as_of() - F.expr("INTERVAL 24 HOURS")
    usd = money("amount_usd")
    flow = t.trades.groupBy("token").agg(
        F.coalesce(F.sum(F.when(day, usd)), F.lit(0)).cast("double").alias("volume_24h"), F.count_if(day & (F.col("side") == "buy")).alias("txns_24h_buys"),
        F.count_if(day & (F.col("side") == "sell")).alias("txns_24h_sells"), F.min("ts").alias("pair_created_at"), F.sum(usd).cast("double").alias("cap"))
    liq = t.prices.groupBy("token").agg(F.max_by("liquidity_usd", "ts").alias("liquidity_usd"))
    return flow.join(liq, "token").withColumn("market_cap", F.when(F.col("token") % 5 == 0, 0.0).otherwise(F.col("cap"))).drop("cap")


MARKET = f"""mk AS (SELECT f.*, l.liquidity_usd, CASE WHEN f.token % 5 = 0 THEN 0.0 ELSE cap END AS market_cap FROM (
  SELECT token, CAST(coalesce(sum(CAST(amount_usd AS DECIMAL(18,2))) FILTER (WHERE ts >= {NOW} - INTERVAL 24 HOUR), 0) AS DOUBLE) AS volume_24h,
   count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 24 HOUR AND side = 'buy') AS b, count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 24 HOUR AND side = 'sell') AS s,
   min(ts) AS made, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS cap FROM v_trades GROUP BY token) f
  JOIN (SELECT token, max_by(liquidity_usd, ts) AS liquidity_usd FROM v_prices GROUP BY token) l ON l.token = f.token)"""


@query("market_features", f"""WITH {MARKET} SELECT token, round(CASE WHEN market_cap > 0 THEN volume_24h / market_cap ELSE 0 END, 6) AS volume_to_mcap_ratio, b + s AS txns_24h_total,
 round(CASE WHEN b + s > 0 THEN b / (b + s) ELSE 0.5 END, 6) AS buy_sell_ratio, round((epoch_us({NOW}) - epoch_us(made)) / 3600000000.0, 6) AS token_age_hours FROM mk""")
def _(t):
    return ft.market_features(market(t), as_of()).select("token", "volume_to_mcap_ratio", "txns_24h_total", "buy_sell_ratio", "token_age_hours")


@query("liquidity_features", f"""WITH {MARKET} SELECT token, round(CASE WHEN market_cap > 0 THEN liquidity_usd / market_cap ELSE 0 END, 6) AS liquidity_to_mcap, round(liquidity_usd * 0.01, 6) AS liquidity_depth_1pct,
 round(liquidity_usd * 0.05, 6) AS liquidity_depth_5pct, round(liquidity_usd * 0.1, 6) AS liquidity_depth_10pct FROM mk""")
def _(t):
    return ft.liquidity_features(market(t)).select("token", "liquidity_to_mcap", "liquidity_depth_1pct", "liquidity_depth_5pct", "liquidity_depth_10pct")


@query("pool_depth", "SELECT p_partkey AS pool, round(coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END, 1) * 0.01 / 2, 6) AS depth_1pct, round(coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END, 1) * 0.05 / 2, 6) AS depth_5pct FROM part")
def _(t):
    pools = t.raw("part").select(F.col("p_partkey").alias("pool"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("reserves_token"))
    return ft.pool_depth(pools).drop("reserves_token")


def pool_events(t):
    kind = F.when(F.col("event_type") == "purchase", "add_liquidity").when(F.col("event_type") == "view", "remove_liquidity").when(F.col("event_type") == "click", "lock").otherwise("unlock")
    return t.events.select((F.col("event_id") % 50).alias("pool"), "ts", kind.alias("type"), F.col("value").alias("value_usd"))


POOLEV = "pe AS (SELECT event_id % 50 AS pool, ts, CASE event_type WHEN 'purchase' THEN 'add_liquidity' WHEN 'view' THEN 'remove_liquidity' WHEN 'click' THEN 'lock' ELSE 'unlock' END AS type, value AS value_usd FROM events)"


@query("pool_activity", f"""WITH {POOLEV}, r AS (SELECT *, epoch_us({NOW}) - epoch_us(ts) < 72 * 3600000000 AS hot FROM pe)
 SELECT pool, count(*) FILTER (WHERE hot AND type = 'add_liquidity') AS liq_add_count, count(*) FILTER (WHERE hot AND type = 'remove_liquidity') AS liq_remove_count,
 CAST(sum(CASE WHEN hot AND type = 'add_liquidity' THEN CAST(value_usd AS DECIMAL(18,2)) WHEN hot AND type = 'remove_liquidity' THEN -CAST(value_usd AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS net_liq_change_usd FROM r GROUP BY pool""")
def _(t):
    return ft.pool_activity(pool_events(t), as_of(), 72)


@query("liquidity_concentration", "SELECT s_nationkey AS pool, round(sum(x * x) / sum(x) ** 2, 6) AS liquidity_concentration FROM (SELECT s_nationkey, abs(s_acctbal) + 1 AS x FROM supplier) GROUP BY s_nationkey")
def _(t):
    return ft.liquidity_concentration(t.raw("supplier").select(F.col("s_nationkey").alias("pool"), (F.abs("s_acctbal") + 1).alias("liquidity")))


HOLD = """hs AS (SELECT token, count(*) AS n, sum(balance) AS supply, sum(balance) FILTER (WHERE dr <= 10) / sum(balance) * 100 AS t10, sum(balance) FILTER (WHERE dr <= 50) / sum(balance) * 100 AS t50,
  2 * sum(ar * balance) / (count(*) * sum(balance)) - (count(*) + 1) / count(*) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance DESC, address) AS dr,
  row_number() OVER (PARTITION BY token ORDER BY balance, address) AS ar FROM v_holders) GROUP BY token)"""


@query("holder_stats", f"WITH {HOLD} SELECT token, n AS holder_count, round(t10, 6) AS top_10_pct, round(t50, 6) AS top_50_pct, round(gini, 6) AS gini_coefficient FROM hs")
def _(t):
    return ft.holder_stats(t.holders).drop("supply")


@query("holder_features", f"""WITH {HOLD} SELECT token, n AS holder_count, round(t10, 6) AS top_10_pct, round(t50, 6) AS top_50_pct, round(gini, 6) AS gini_coefficient,
 round(coalesce((SELECT sum(balance) FROM v_holders h WHERE h.token = hs.token AND address IN (SELECT wallet FROM v_smart)), 0) / supply * 100, 6) AS smart_money_pct FROM hs""")
def _(t):
    return ft.holder_features(t.holders, t.known_smart)


@query("smart_wallet_membership", "SELECT token, address, address IN (SELECT wallet FROM v_smart) AS is_smart FROM v_holders")
def _(t):
    known = t.known_smart.select(F.col("wallet").alias("address"), F.lit(True).alias("k"))
    return t.holders.join(known, "address", "left").select("token", "address", F.coalesce("k", F.lit(False)).alias("is_smart"))


@query("top_holders", f"""SELECT token, rank, address, balance, round(balance / s * 100, 6) AS percentage, false AS is_contract FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance DESC, address) AS rank,
 sum(balance) OVER (PARTITION BY token) AS s FROM v_holders) WHERE rank <= 10""")
def _(t):
    return ft.top_holders(t.holders)


def token_transfers(t):
    return t.edges.join(t.trades.select("trade_id", "token", "amount_tokens"), "trade_id").select("token", "src", "dst", "ts", F.col("amount_tokens").alias("amount"), "amount_usd")


TRANSFERS = "xf AS (SELECT t.token, e.src, e.dst, e.ts, t.amount_tokens AS amount, t.amount_usd FROM v_edges e JOIN v_trades t ON t.trade_id = e.trade_id)"
DERIVED = "hd AS (SELECT token, address, sum(d) AS balance FROM (SELECT token, dst AS address, amount AS d FROM xf UNION ALL SELECT token, src, -amount FROM xf) GROUP BY 1, 2 HAVING sum(d) > 0)"


@query("holders_from_transfers", f"WITH {TRANSFERS}, {DERIVED} SELECT token, address, round(balance, 6) AS balance FROM hd")
def _(t):
    return ft.holders_from_transfers(token_transfers(t))


@query("smart_money_flow", f"""WITH {TRANSFERS}, lg AS (SELECT token, src AS w, 0 AS b, amount_usd FROM xf UNION ALL SELECT token, dst, 1, amount_usd FROM xf)
 SELECT token, count(*) AS smart_money_activity, CAST(sum(b) AS BIGINT) AS smart_buys, CAST(count(*) - sum(b) AS BIGINT) AS smart_sells, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS smart_money_volume,
 round(sum(b) / count(*), 6) AS smart_money_buy_ratio FROM lg WHERE w IN (SELECT wallet FROM v_smart) GROUP BY token""")
def _(t):
    return ft.smart_money_flow(token_transfers(t).withColumn("amount", F.col("amount_usd")), t.known_smart)


DEV_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query("dev_and_growth", f"""WITH {TRANSFERS}, dv AS (SELECT token, min_by(wallet, ts) AS address FROM v_trades GROUP BY token),
 now_x AS (SELECT * FROM xf WHERE ts <= {DEV_NOW}), bef_x AS (SELECT * FROM xf WHERE ts <= {DEV_NOW} - INTERVAL 24 HOUR),
 h1 AS (SELECT token, address, sum(d) AS balance FROM (SELECT token, dst AS address, amount AS d FROM now_x UNION ALL SELECT token, src, -amount FROM now_x) GROUP BY 1, 2 HAVING sum(d) > 0),
 h0 AS (SELECT token, address, sum(d) AS balance FROM (SELECT token, dst AS address, amount AS d FROM bef_x UNION ALL SELECT token, src, -amount FROM bef_x) GROUP BY 1, 2 HAVING sum(d) > 0),
 a AS (SELECT token, sum(balance) AS s, count(*) AS n FROM h1 GROUP BY token)
 SELECT a.token, round(coalesce((SELECT sum(balance) FROM h1 JOIN dv ON dv.token = h1.token AND dv.address = h1.address WHERE h1.token = a.token), 0) * 100 / s, 6) AS dev_holding_percentage,
  (SELECT count(*) FROM xf JOIN dv ON dv.token = xf.token AND dv.address = xf.src WHERE xf.token = a.token AND ts > {DEV_NOW} - INTERVAL 24 HOUR AND ts <= {DEV_NOW}) AS dev_sells_24h,
  round((n - (SELECT count(*) FROM h0 WHERE h0.token = a.token)) / (SELECT count(*) FROM h0 WHERE h0.token = a.token), 6) AS holder_growth_24h FROM a""")
def _(t):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    x = token_transfers(t)
    devs = t.trades.groupBy("token").agg(F.min_by("wallet", "ts").alias("address"))
    return ft.dev_and_growth(ft.holders_from_transfers(x.where(F.col("ts") <= now)), x, devs, now)


# ---------------------------------------------------------------- social
POST_NOW = "2024-01-03 00:00:00"
IN24 = f"ts >= TIMESTAMP '{POST_NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{POST_NOW}'"


def post_now():
    return F.lit(POST_NOW).cast("timestamp")


@query("mention_volume", f"SELECT coalesce(source, 'total') AS source, count(*) AS mentions FROM v_posts WHERE {IN24} GROUP BY ROLLUP (source)")
def _(t):
    return ft.mention_volume(t.posts, post_now())


VEL = f"""SELECT source, count(*) FILTER (WHERE ts >= TIMESTAMP '{POST_NOW}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{POST_NOW}') / 1 AS v1, count(*) FILTER (WHERE ts >= TIMESTAMP '{POST_NOW}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{POST_NOW}') / 6 AS v6,
 count(*) FILTER (WHERE {IN24}) / 24 AS v24, count(*) FILTER (WHERE {IN24}) AS n24 FROM v_posts GROUP BY source"""


@query("mention_velocity", f"SELECT source, round(v1, 6) AS mention_velocity_1h, round(v6, 6) AS mention_velocity_6h, round(v24, 6) AS mention_velocity_24h, round(CASE WHEN v6 > 0 THEN v1 / v6 ELSE 0 END, 6) AS mention_acceleration FROM ({VEL})")
def _(t):
    return ft.mention_velocity(t.posts, post_now(), ["source"])


@query("engagement", """SELECT source, CAST(sum(like_count) AS BIGINT) AS total_likes, CAST(sum(retweet_count) AS BIGINT) AS total_retweets, CAST(sum(reply_count) AS BIGINT) AS total_replies,
 CAST(sum(like_count + retweet_count + reply_count) AS BIGINT) AS total_engagement, round(sum(like_count + retweet_count + reply_count) / count(*), 6) AS avg_engagement_per_tweet FROM v_posts GROUP BY source""")
def _(t):
    return ft.engagement(t.posts, ["source"])


@query("mention_stats", """SELECT source, count(*) AS mention_volume, count(DISTINCT author_id) AS unique_authors, CAST(sum(like_count) AS BIGINT) AS total_likes, CAST(sum(retweet_count) AS BIGINT) AS total_retweets,
 round(sum(like_count + retweet_count) / count(*), 6) AS avg_engagement FROM v_posts GROUP BY source""")
def _(t):
    return ft.mention_stats(t.posts, ["source"])


@query("kol_mentions", """SELECT source, count(*) FILTER (WHERE retweet_count * 100 >= 10000) AS kol_mentions, CAST(coalesce(sum(retweet_count * 100) FILTER (WHERE retweet_count * 100 >= 10000), 0) AS BIGINT) AS kol_total_reach,
 round(coalesce(avg(retweet_count * 100) FILTER (WHERE retweet_count * 100 >= 10000), 0), 6) AS kol_avg_followers FROM v_posts GROUP BY source""")
def _(t):
    return ft.kol_mentions(t.posts, keys=["source"])


def _words(ws):
    return " + ".join(f"contains(lower(text), '{x}')::INT" for x in ws)


SENT = f"sp AS (SELECT *, sign(({_words(ft.POSITIVE)}) - ({_words(ft.NEGATIVE)})) AS s FROM v_posts)"


@query("sentiment", f"""WITH {SENT} SELECT source, round(avg((s = 1)::INT), 6) AS sentiment_positive_ratio, round(avg((s = -1)::INT), 6) AS sentiment_negative_ratio, round(avg((s = 0)::INT), 6) AS sentiment_neutral_ratio,
 round(avg(s), 6) AS sentiment_score FROM sp GROUP BY source""")
def _(t):
    return ft.sentiment(t.posts, ["source"])


@query("post_bot_patterns", """WITH tx AS (SELECT source, sum(c) AS posts, count(*) FILTER (WHERE c > 1) AS rep FROM (SELECT source, text, count(*) AS c FROM v_posts GROUP BY 1, 2) GROUP BY source),
 au AS (SELECT source, max(c) AS busiest FROM (SELECT source, author_id, count(*) AS c FROM v_posts GROUP BY 1, 2) GROUP BY source)
 SELECT tx.source, round(rep / posts, 6) AS duplicate_ratio, busiest AS max_posts_per_author, round(least(1, CASE WHEN rep / posts > 0.5 THEN 0.4 ELSE 0 END + CASE WHEN busiest > 10 THEN 0.3 ELSE 0 END + CASE WHEN posts > 5 THEN 0.3 ELSE 0 END), 6) AS bot_score
 FROM tx JOIN au ON tx.source = au.source""")
def _(t):
    return ft.post_bot_patterns(t.posts, ["source"])


SOCIAL_BOT = """sb AS (SELECT author_id, CASE WHEN r + x > 0 THEN f / (r + x) ELSE 0 END AS social_bot_score FROM (SELECT author_id, (max(ts) > min(ts))::INT AS r, (count(*) > 5)::INT AS x,
  CASE WHEN max(ts) > min(ts) THEN (count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0) > 20)::INT ELSE 0 END + CASE WHEN count(*) > 5 THEN (count(DISTINCT text) / count(*) < 0.3)::INT ELSE 0 END AS f FROM v_posts GROUP BY author_id))"""


@query("social_bot_score", f"WITH {SOCIAL_BOT} SELECT author_id, round(social_bot_score, 6) AS social_bot_score FROM sb")
def _(t):
    return ft.social_bot_score(t.posts, "author_id")


@query("bot_score", f"""WITH {TIMING}, {SANDWICH}, {WASH}, {SOCIAL_BOT} SELECT tm.wallet, round(least(1, 0.3 * timing_score + 0.3 * sandwich_score + 0.2 * wash_score + 0.2 * coalesce(social_bot_score, 0)), 6) AS bot_score
 FROM tm JOIN sw ON sw.wallet = tm.wallet JOIN ws ON ws.wallet = tm.wallet LEFT JOIN sb ON sb.author_id = tm.wallet""")
def _(t):
    social = ft.social_bot_score(t.posts, "author_id").withColumnRenamed("author_id", "wallet")
    return rk.bot_score(t.trades, social)


@query("social_features_all", f"""WITH {SENT}, ve AS ({VEL}), wd AS (SELECT source, count(*) AS n, sum(like_count + retweet_count + reply_count) / count(*) AS eng, count(*) FILTER (WHERE retweet_count >= 100) AS kol, avg(s) AS sc FROM sp WHERE {IN24} GROUP BY source),
 du AS (SELECT source, count(*) FILTER (WHERE c > 1) / sum(c) AS dup FROM (SELECT source, text, count(*) AS c FROM v_posts WHERE {IN24} GROUP BY 1, 2) GROUP BY source)
 SELECT ve.source, n24 AS total_mentions_24h, round(v24, 6) AS mention_velocity_24h, round(coalesce(eng, 0), 6) AS avg_engagement_per_tweet, coalesce(kol, 0) AS kol_mentions, round(coalesce(sc, 0), 6) AS sentiment_score,
 round(coalesce(dup, 0), 6) AS duplicate_ratio FROM ve LEFT JOIN wd ON wd.source = ve.source LEFT JOIN du ON du.source = ve.source""")
def _(t):
    return ft.social_features(t.posts, post_now()).select("source", "total_mentions_24h", "mention_velocity_24h", "avg_engagement_per_tweet", "kol_mentions", "sentiment_score", "duplicate_ratio")


# ---------------------------------------------------------------- stored features
def snapshots(t):
    return t.trades.select(F.col("wallet").cast("string").alias("entity_id"), "ts", "trade_id",
                           F.create_map(F.lit("usd"), F.col("amount_usd"), F.lit("price"), F.col("price")).alias("features"))


@query("time_window_agg", f"""WITH x AS (SELECT CAST(wallet AS VARCHAR) AS entity_id, ts, unnest([{{'k': 'usd', 'v': amount_usd}}, {{'k': 'price', 'v': price}}]) AS f FROM v_trades),
 wn(time_window, s) AS (VALUES ('1h', 3600), ('6h', 21600), ('24h', 86400), ('7d', 604800), ('30d', 2592000))
 SELECT entity_id, time_window, f.k AS key, round(avg(f.v), 10) AS mean, round(max(f.v), 10) AS max, round(min(f.v), 10) AS min FROM x JOIN wn ON epoch_us({NOW}) - epoch_us(ts) <= CAST(s AS BIGINT) * 1000000 GROUP BY 1, 2, 3""", digits=10)
def _(t):
    return ft.time_window_agg(snapshots(t), as_of())


@query("features_as_of", """SELECT e.event_id AS probe_id, CAST(e.user_id AS VARCHAR) AS entity_id, round(s.amount_usd, 6) AS usd FROM (SELECT * FROM events WHERE event_type = 'error') e
 ASOF LEFT JOIN v_trades s ON s.wallet = e.user_id AND e.ts >= s.ts""")
def _(t):
    probes = t.events.where(F.col("event_type") == "error").select(F.col("event_id").alias("probe_id"), F.col("user_id").cast("string").alias("entity_id"), "ts")
    return ft.features_as_of(probes, snapshots(t)).select("probe_id", "entity_id", F.try_element_at("features", F.lit("usd")).alias("usd"))


@query("feature_history", "SELECT CAST(wallet AS VARCHAR) AS entity_id, count(*) AS snapshots FROM v_trades WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1")
def _(t):
    h = ft.feature_history(snapshots(t), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return h.groupBy("entity_id").agg(F.count(F.lit(1)).alias("snapshots"))


@query("features_written_read", """SELECT CAST(wallet AS VARCHAR) AS entity_id, count(*) AS snapshots, round(sum(amount_usd), 4) AS usd FROM v_trades
 WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00' GROUP BY 1""", digits=4)
def _(t):
    """Snapshots appended by day and the days of a range read back."""
    path = f"{checkpoint_dir(t.spark)}/features-{uuid.uuid4().hex}"
    writers.write_features(snapshots(t), path)
    back = writers.read_features(t.spark, path, "2024-01-05", "2024-01-12")
    return back.groupBy("entity_id").agg(F.count(F.lit(1)).alias("snapshots"), F.sum(money(F.try_element_at("features", F.lit("usd")))).cast("double").alias("usd"))


@query("range_violations", "SELECT count(*) FILTER (WHERE p < 0 OR p > 1) AS probability, count(*) FILTER (WHERE r < 0 OR r > 100) AS risk_score FROM (SELECT l_quantity / 40.0 AS p, l_quantity * 3 - 10 AS r FROM lineitem)")
def _(t):
    rows = t.raw("lineitem").select((F.col("l_quantity") / 40.0).alias("probability"), (F.col("l_quantity") * 3 - 10).alias("risk_score"))
    return schemas.range_violations(rows)


@query("feature_store_stats", "SELECT count(DISTINCT wallet) AS total_entities, count(*) AS total_entries, round(count(*) / count(DISTINCT wallet), 6) AS avg_entries_per_entity FROM v_trades")
def _(t):
    return ft.feature_store_stats(snapshots(t))


@query("list_entities", "SELECT DISTINCT CAST(wallet AS VARCHAR) AS entity_id FROM v_trades")
def _(t):
    return snapshots(t).select("entity_id").distinct()


def request_log(t):
    return t.events.select(F.col("event_type").alias("endpoint"), "ts", "event_id", F.col("user_id").alias("client"), F.when(F.col("event_id") % 9 == 0, 500).otherwise(200).alias("status_code"), F.col("value").alias("duration_ms"))


@query("request_log_stats", """SELECT event_type AS endpoint, count(*) AS count, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, round(avg((event_id % 9 = 0)::INT), 6) AS error_rate,
 round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_duration_ms FROM events GROUP BY event_type""")
def _(t):
    return ft.request_log_stats(request_log(t)).drop("p95_duration_ms")


@query("request_log_p95", """SELECT event_type AS endpoint, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2024-01-01') AS ts, round(quantile_disc(value, 0.95), 6) AS p95_duration_ms FROM events GROUP BY 1, 2""")
def _(t):
    return ft.request_log_p95(request_log(t))


@query("request_log_p95_endpoint", """WITH r AS (SELECT event_type AS endpoint, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT endpoint, round(value, 6) AS p95_duration_ms FROM r WHERE i = ceil(0.95::DOUBLE * n)""")
def _(t):
    return ft.request_log_stats(request_log(t)).select("endpoint", "p95_duration_ms")


@query("rate_excess", """SELECT user_id AS client, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window,
 count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) > 2 AS exceeded FROM events""")
def _(t):
    return ft.rate_excess(request_log(t), "client", limit=2, window_s=21600)


# ---------------------------------------------------------------- risk
RISK_SQL = """cr AS (SELECT token, (is_honeypot = '1')::INT * 40 + (is_open_source <> '1')::INT * 10 + (is_proxy = '1')::INT * 15 + (is_mintable = '1')::INT * 20 + (can_take_back_ownership = '1')::INT * 25
  + (owner_change_balance = '1')::INT * 30 + (hidden_owner = '1')::INT * 20 + (selfdestruct = '1')::INT * 35 AS raw,
  concat_ws(',', CASE WHEN is_honeypot = '1' THEN 'honeypot' END, CASE WHEN is_open_source <> '1' THEN 'not_open_source' END, CASE WHEN is_proxy = '1' THEN 'proxy_contract' END, CASE WHEN is_mintable = '1' THEN 'mintable' END,
   CASE WHEN can_take_back_ownership = '1' THEN 'can_take_back_ownership' END, CASE WHEN owner_change_balance = '1' THEN 'owner_can_change_balance' END, CASE WHEN hidden_owner = '1' THEN 'hidden_owner' END, CASE WHEN selfdestruct = '1' THEN 'selfdestruct' END) AS flags FROM v_security_flags)"""
LEVEL = "CASE WHEN {0} >= 70 THEN 'high' WHEN {0} >= 40 THEN 'medium' WHEN {0} >= 20 THEN 'low' ELSE 'minimal' END"


@query("contract_risk", f"WITH {RISK_SQL} SELECT token, least(100, raw) AS risk_score, {LEVEL.format('raw')} AS risk_level, flags FROM cr")
def _(t):
    return rk.contract_risk(t.security_flags).withColumn("flags", F.array_join("flags", ","))


def _chains(t):
    k = F.col("s_suppkey")
    return t.raw("supplier").select(k.alias("token"), F.when(k % 3 == 0, "ethereum").when(k % 3 == 1, "solana").when(k % 2 == 0, "bsc").otherwise("base").alias("chain"))


def _reports(t):
    k = F.col("s_suppkey")
    return t.raw("supplier").where(k % 4 != 1).select(
        k.alias("token"), (k % 90).cast("int").alias("score"), F.lit("warn").alias("report_level"), F.array(F.lit("b"), F.concat(F.lit("a"), (k % 3).cast("string"))).alias("report_flags"))


TOK = "tk AS (SELECT s_suppkey AS token, CASE WHEN s_suppkey % 3 = 0 THEN 'ethereum' WHEN s_suppkey % 3 = 1 THEN 'solana' WHEN s_suppkey % 2 = 0 THEN 'bsc' ELSE 'base' END AS chain FROM supplier)"


@query("report_risk", f"""WITH {TOK} SELECT token, chain, CASE WHEN token % 4 <> 1 THEN token % 90 ELSE 50 END AS risk_score, CASE WHEN token % 4 <> 1 THEN 'warn' ELSE 'unknown' END AS risk_level,
 CASE WHEN token % 4 <> 1 THEN 'b,a' || (token % 3) ELSE 'no_data' END AS flags FROM tk""")
def _(t):
    return rk.report_risk(_chains(t), _reports(t)).withColumn("flags", F.array_join("flags", ","))


@query("aggregate_risk", f"""WITH {TOK}, {RISK_SQL}, s AS (SELECT tk.token, chain, CASE WHEN chain IN ('ethereum', 'bsc') THEN least(100, raw) WHEN chain = 'solana' THEN CASE WHEN tk.token % 4 <> 1 THEN tk.token % 90 ELSE 50 END END AS sc,
  CASE WHEN chain IN ('ethereum', 'bsc') THEN string_split(flags, ',') WHEN chain = 'solana' THEN CASE WHEN tk.token % 4 <> 1 THEN ['b', 'a' || (tk.token % 3)] ELSE ['no_data'] END END AS fl FROM tk JOIN cr ON cr.token = tk.token)
 SELECT token, chain, CAST(CASE WHEN coalesce(sc, 0) = 0 THEN 50 ELSE sc END AS DOUBLE) AS aggregate_risk_score, {LEVEL.format("(CASE WHEN coalesce(sc, 0) = 0 THEN 50 ELSE sc END)")} AS risk_level,
 CASE WHEN coalesce(sc, 0) = 0 THEN '' ELSE array_to_string(list_sort(fl), ',') END AS flags, CASE WHEN coalesce(sc, 0) = 0 THEN 0 ELSE 1 END AS sources_checked FROM s""")
def _(t):
    return rk.aggregate_risk(_chains(t), rk.contract_risk(t.security_flags), _reports(t)).withColumn("flags", F.array_join("flags", ","))


def _components(t):
    k = F.col("c_custkey")
    return t.raw("customer").select(
        k.alias("token"), (F.col("c_acctbal") / 50.0).alias("rug_risk"), F.when(k % 7 != 0, (k % 130).cast("double")).alias("dev_risk"), (k % 97).cast("double").alias("distribution_risk"),
        (k % 89).cast("double").alias("social_risk"), (k % 83).cast("double").alias("liquidity_risk"), (k % 2 == 0).alias("liquidity_locked"), F.when(k % 5 != 0, k % 3 == 0).alias("ownership_renounced"),
        (k % 10 / 20.0).alias("dev_holding_pct"), (k % 4 == 0).alias("dev_recent_sell"), (k % 11 / 11.0).alias("holder_gini"), (k % 13 / 13.0).alias("top10_concentration"), (k % 6 / 6.0).alias("bot_score"),
        (k % 9 / 9.0).alias("duplicate_ratio"), (k % 25 * 1000.0).alias("liquidity_usd"), (k % 15 * 1000.0).alias("liquidity_depth_5pct"))


COMP = """cp AS (SELECT c_custkey AS k, least(100, greatest(0, c_acctbal / 50)) AS rug, coalesce(least(100, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 130 END), 50) AS dev, c_custkey % 97 AS dist, c_custkey % 89 AS soc, c_custkey % 83 AS liq FROM customer),
cs AS (SELECT *, CASE WHEN k % 7 = 0 THEN 50 ELSE dev END AS dev_ok FROM cp)"""


@query("composite_risk", f"WITH {COMP} SELECT k AS token, round(0.3 * rug + 0.25 * dev_ok + 0.2 * dist + 0.15 * soc + 0.1 * liq, 4) AS composite_score FROM cs", digits=4)
def _(t):
    return rk.composite_risk(_components(t)).select("token", "composite_score")


@query("composite_risk_untrained", "SELECT c_custkey AS token, round(0.3 * 30 + 0.25 * 50 + 0.2 * 45 + 0.15 * 35 + 0.1 * 40, 4) AS composite_score FROM customer", digits=4)
def _(t):
    return rk.composite_risk(_components(t), trained=False).select("token", "composite_score")


@query("risk_flags", f"""WITH {COMP} SELECT k AS token, concat_ws('|', CASE WHEN rug > 70 THEN 'High Contract Risk' END, CASE WHEN rug > 70 AND k % 2 <> 0 THEN 'LP Not Locked' END, CASE WHEN rug > 70 AND (k % 5 = 0 OR k % 3 <> 0) THEN 'Ownership Not Renounced' END,
 CASE WHEN dev_ok > 60 AND k % 10 / 20 > 0.2 THEN 'High Dev Holding' END, CASE WHEN dev_ok > 60 AND k % 4 = 0 THEN 'Recent Dev Sell' END, CASE WHEN dist > 70 AND k % 11 / 11 > 0.8 THEN 'Highly Concentrated Holdings' END,
 CASE WHEN dist > 70 AND k % 13 / 13 > 0.7 THEN 'Top 10 Hold >70%' END, CASE WHEN soc > 65 AND k % 6 / 6 > 0.5 THEN 'High Bot Activity' END, CASE WHEN soc > 65 AND k % 9 / 9 > 0.4 THEN 'Suspicious Social Patterns' END,
 CASE WHEN liq > 60 AND k % 25 * 1000 < 10000 THEN 'Low Liquidity (<$10k)' END, CASE WHEN liq > 60 AND k % 15 * 1000 < 5000 THEN 'Poor Liquidity Depth' END) AS flags FROM cs""")
def _(t):
    return rk.composite_risk(_components(t)).select("token", F.array_join(rk.risk_flags(), "|").alias("flags"))


@query("base_rate_heatmap", """SELECT token, horizon, multiplier, round(b / f, 6) AS probability FROM (SELECT DISTINCT token FROM v_trades) CROSS JOIN (VALUES ('2x', 0.35), ('5x', 0.15), ('10x', 0.05), ('20x', 0.02), ('50x', 0.005)) m(multiplier, b)
 CROSS JOIN (VALUES ('24h', 1.0), ('7d', 1.5), ('30d', 2.0)) h(horizon, f)""")
def _(t):
    return rk.base_rate_heatmap(t.trades.select("token").distinct())


@query("heatmap_filter", "SELECT horizon, multiplier, count(*) AS n FROM v_predictions WHERE horizon IN ('24h', '7d') GROUP BY 1, 2")
def _(t):
    return rk.heatmap_filter(t.predictions, ["24h", "7d"]).groupBy("horizon", "multiplier").agg(F.count(F.lit(1)).alias("n"))


def _feature_rows(t):
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("volume_24h"), (F.col("p_size") * 40).alias("liquidity_usd"), (F.col("p_size") / 50.0).alias("holder_gini"), (F.col("p_partkey") % 5 - 2).alias("sentiment_score"),
        (F.col("p_size") / 100.0 - 0.25).alias("price_change_24h"), F.col("p_size").alias("mentions_24h"), (F.col("p_partkey") % 7 - 3).alias("momentum"))


TOPF = """fr AS (SELECT p_partkey AS id, unnest([{'i': 0, 'n': 'volume_24h', 'v': p_retailprice}, {'i': 1, 'n': 'liquidity_usd', 'v': CAST(p_size * 40 AS DOUBLE)}, {'i': 2, 'n': 'holder_gini', 'v': p_size / 50}, {'i': 3, 'n': 'sentiment_score', 'v': CAST(p_partkey % 5 - 2 AS DOUBLE)},
  {'i': 4, 'n': 'price_change_24h', 'v': p_size / 100 - 0.25}, {'i': 5, 'n': 'mentions_24h', 'v': CAST(p_size AS DOUBLE)}, {'i': 6, 'n': 'momentum', 'v': CAST(p_partkey % 7 - 3 AS DOUBLE)}]) AS f FROM part),
tf AS (SELECT id, f, row_number() OVER (PARTITION BY id ORDER BY abs(f.v) DESC, f.i) AS place, sum(abs(f.v)) OVER (PARTITION BY id) AS tot FROM fr)"""
FEATURE_COLS = ["volume_24h", "liquidity_usd", "holder_gini", "sentiment_score", "price_change_24h", "mentions_24h", "momentum"]


@query("top_features", f"WITH {TOPF} SELECT id, place, f.n AS feature_name, round(f.v, 6) AS value, round(abs(f.v) / (tot + 1e-10), 6) AS contribution, CASE WHEN f.v > 0 THEN 'positive' ELSE 'negative' END AS direction FROM tf WHERE place <= 5")
def _(t):
    return rk.top_features(_feature_rows(t), ["id"], FEATURE_COLS).drop("description")


@query("feature_text", f"""WITH {TOPF} SELECT id, place, CASE f.n WHEN 'volume_24h' THEN format('Trading volume of ${{:,}}', CAST(round_even(f.v, 0) AS BIGINT)) WHEN 'liquidity_usd' THEN format('Liquidity of ${{:,}}', CAST(round(f.v) AS BIGINT))
 WHEN 'mentions_24h' THEN format('{{}} social mentions', CAST(f.v AS BIGINT)) WHEN 'momentum' THEN format('momentum={{:.3f}}', f.v) WHEN 'sentiment_score' THEN format('Social sentiment score ({{:.2f}})', f.v)
 WHEN 'holder_gini' THEN format('Holder concentration (Gini={{:.2f}})', f.v) END || CASE WHEN abs(f.v) > 0 THEN ' increases' ELSE ' decreases' END || ' probability' AS description FROM tf WHERE place <= 4 AND f.n <> 'price_change_24h'""")
def _(t):
    return rk.top_features(_feature_rows(t), ["id"], FEATURE_COLS, 4).where(F.col("feature_name") != "price_change_24h").select("id", "place", "description")


# ---------------------------------------------------------------- composed feature rows
@query("wallet_features_all", """SELECT wallet, count(*) AS total_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(sum(pnl), 4) AS total_pnl, round(stddev_pop(pnl), 4) AS pnl_std FROM v_closed GROUP BY wallet""", digits=4)
def _(t):
    closed = fifo_match(t.trades)
    return w.trading_features(closed).join(w.pnl_features(closed), "wallet").select("wallet", "total_trades", "win_rate", "total_pnl", "pnl_std")


@query("token_features_all", f"""WITH {MARKET}, {TRANSFERS}, {DERIVED}, g AS (SELECT token, count(*) AS n, 2 * sum(ar * balance) / (count(*) * sum(balance)) - (count(*) + 1) / count(*) AS gini FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance, address) AS ar FROM hd) GROUP BY token)
 SELECT mk.token, b + s AS txns_24h_total, round(liquidity_usd * 0.01, 6) AS liquidity_depth_1pct, n AS holder_count, round(gini, 6) AS gini_coefficient FROM mk JOIN g ON g.token = mk.token""")
def _(t):
    m = ft.liquidity_features(ft.market_features(market(t), as_of()))
    h = ft.holder_stats(ft.holders_from_transfers(token_transfers(t)))
    return m.join(h, "token").select("token", "txns_24h_total", "liquidity_depth_1pct", "holder_count", "gini_coefficient")
