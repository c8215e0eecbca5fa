"""Registered queries: scans, parsers and normalizers."""

from pyspark.sql import functions as F

from chainsieve.functions import normalize as nz
from chainsieve.plans.registry import query
from chainsieve.sources import readers as rd
from chainsieve.tables import as_of


@query("scan_trades", """SELECT trade_id, token, wallet, side, ts, amount_usd FROM v_trades WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00' AND chain = 'ethereum'""")
def _(t):
    return rd.scan_trades(t.trades, as_of(), 7, chain="ethereum").select("trade_id", "token", "wallet", "side", "ts", "amount_usd")


@query("scan_wallet_trades", """SELECT token, wallet, count(*) AS trades, min(ts) AS first_ts, max(ts) AS last_ts FROM v_trades
 WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY token, wallet""")
def _(t):
    return rd.scan_trades(t.trades, as_of(), 14).groupBy("token", "wallet").agg(F.count(F.lit(1)).alias("trades"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _transfers(t):
    k = F.col("trade_id")
    return t.trades.select(
        F.when(k % 5 != 0, F.concat(F.lit("tx"), F.floor(k / 3).cast("string"))).alias("transactionHash"), F.concat(F.lit("sig"), F.floor(k / 2).cast("string")).alias("signature"),
        F.when(k % 11 != 0, F.col("counterparty")).alias("source"), F.col("wallet").alias("destination"), (F.col("amount_tokens") * 1e9).cast("bigint").alias("amount"),
        F.when(k % 2 == 0, 9).alias("decimals"), F.unix_seconds("ts").alias("blockTime"), F.when(F.col("side") == "buy", 1).otherwise(-1).alias("changeAmount"),
        F.when(k % 4 == 0, "JUP4Fb2cqiRUcaTHdrPC8h2gNsA2ETXiPDD33WcGuJB").alias("programId"), F.when(k % 4 == 1, "09ab").alias("instructionData"),
        F.when(k % 4 == 2, F.array(F.lit("begin"), F.lit("Program Serum invoke"), F.lit("orca"))).alias("logs"))


SWAPS = """tf AS (SELECT trade_id AS k, coalesce(CASE WHEN trade_id % 5 <> 0 THEN 'tx' || (trade_id // 3) END, 'sig' || (trade_id // 2)) AS tx, CASE WHEN trade_id % 11 <> 0 THEN counterparty END AS source,
  wallet AS destination, amount_tokens, side, CAST(epoch(ts) AS BIGINT) AS bt FROM v_trades)"""


@query("swaps_from_transfers", f"""WITH {SWAPS} SELECT tx AS transaction_hash, side, CASE WHEN side = 'buy' THEN destination ELSE source END AS buyer, CASE WHEN side = 'buy' THEN source ELSE destination END AS seller,
 make_timestamp(CAST(floor(bt) AS BIGINT) * 1000000) AS ts, amount_tokens, CASE k % 4 WHEN 0 THEN 'jupiter' WHEN 1 THEN 'raydium' WHEN 2 THEN 'serum' ELSE 'unknown_dex' END AS dex
 FROM tf WHERE source IS NOT NULL AND tx IN (SELECT tx FROM tf GROUP BY tx HAVING count(*) >= 2)""".replace("epoch(ts)", "floor(epoch(ts))"))
def _(t):
    return rd.swaps_from_transfers(_transfers(t)).drop("amount_usd", "gas_price")


@query("wallet_swaps", """SELECT 'sig' || (trade_id // 2) AS transaction_hash, side, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS ts, amount_tokens FROM v_trades
 WHERE make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    txs = _transfers(t).withColumn("changeAmount", F.col("changeAmount") * F.col("amount"))
    return rd.wallet_swaps(txs, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("transaction_hash", "side", "ts", "amount_tokens")


def _tx(t):
    k = F.col("trade_id")
    log = lambda a, f, to, v: F.struct(a.alias("address"), f.cast("string").alias("from"), to.cast("string").alias("to"), v.alias("value"))
    first = log(F.concat(F.lit("0xT"), (k % 3).cast("string")), F.when(F.col("side") == "sell", F.col("wallet")).otherwise(F.col("counterparty")),
                F.when(F.col("side") == "sell", F.col("counterparty")).when(k % 7 == 0, F.lit(-1)).otherwise(F.col("wallet")), F.col("amount_tokens"))
    second = log(F.concat(F.lit("0xt"), (k % 2).cast("string")), F.col("counterparty"), F.col("wallet"), F.col("amount_usd"))
    return t.trades.select(k.alias("hash"), "ts", F.col("wallet").cast("string").alias("from"), F.col("counterparty").cast("string").alias("to"), F.col("amount_usd").alias("value"), F.array(first, second).alias("logs"))


TXM = """lg AS (SELECT trade_id, side, wallet, counterparty, amount_usd, trade_id % 3 = 1 AS m1, trade_id % 2 = 1 AS m2, amount_tokens,
  CASE WHEN side = 'sell' THEN wallet ELSE counterparty END AS f1, CASE WHEN side = 'sell' THEN counterparty WHEN trade_id % 7 = 0 THEN -1 ELSE wallet END AS t1 FROM v_trades)"""


@query("token_trades_from_tx", f"""WITH {TXM} SELECT trade_id AS hash, CASE WHEN m1 THEN CASE WHEN f1 = wallet THEN 'sell' WHEN t1 = wallet THEN 'buy' ELSE 'transfer' END ELSE 'buy' END AS type,
 round(m1::INT * amount_tokens + m2::INT * amount_usd, 6) AS amount, amount_usd AS value_usd, m1 AND m2 AND (f1 = wallet OR t1 = counterparty) AS is_wash_trade, m1::INT + m2::INT AS hop_count
 FROM lg WHERE m1 OR m2""")
def _(t):
    return rd.token_trades_from_tx(_tx(t), F.lit("0xt1")).where("matched").select("hash", "type", "amount", "value_usd", "is_wash_trade", "hop_count")


@query("circular_transfers", f"WITH {TXM} SELECT count(*) FILTER (WHERE m1 AND m2 AND (f1 = wallet OR t1 = counterparty)) AS circular, count(*) AS matched FROM lg WHERE m1 OR m2")
def _(t):
    m = rd.token_trades_from_tx(_tx(t), F.lit("0xt1")).where("matched")
    return m.agg(F.count_if("is_wash_trade").alias("circular"), F.count(F.lit(1)).alias("matched"))


@query("unmatched_rate", "SELECT round(avg(CASE WHEN trade_id % 3 = 1 OR trade_id % 2 = 1 THEN 0.0 ELSE 1.0 END), 6) AS error_rate, count(*) AS transactions FROM v_trades")
def _(t):
    return rd.unmatched_rate(rd.token_trades_from_tx(_tx(t), F.lit("0xt1")))


def _raw_transfers(t):
    k = F.col("trade_id")
    s = lambda c: c.cast("string")
    return t.trades.select(
        F.when(F.col("chain") == "ethereum", "ETH").when(F.col("chain") == "bsc", "bnb").otherwise("SOL").alias("chain"),
        F.concat(F.lit("h"), s(k)).alias("hash"), F.concat(F.lit("s"), s(k)).alias("signature"), F.concat(F.lit(" AB"), s(F.col("counterparty"))).alias("from"), F.concat(F.lit("0xCD"), s(F.col("wallet"))).alias("to"),
        F.concat(F.lit("AB"), s(F.col("counterparty"))).alias("src"), F.concat(F.lit("CD"), s(F.col("wallet"))).alias("dst"), s((F.col("amount_tokens") * 1e6).cast("bigint")).alias("value"), s((F.col("amount_tokens") * 1e3).cast("bigint")).alias("amount"),
        F.lit("SYM").alias("tokenSymbol"), F.lit("sym").alias("symbol"), F.lit("Name").alias("tokenName"), F.lit("name").alias("name"), F.when(k % 3 == 0, "6").alias("tokenDecimal"), F.when(k % 3 == 0, "5").alias("decimals"),
        s(F.unix_seconds("ts")).alias("timeStamp"), s(F.unix_millis("ts")).alias("blockTime"), s(k).alias("blockNumber"), s(k + 7).alias("slot"))


@query("normalize_transfers", """SELECT CASE WHEN chain = 'solana' THEN 's' ELSE 'h' END || trade_id AS hash, CASE WHEN chain = 'solana' THEN 'AB' ELSE '0xab' END || counterparty AS from_address,
 CASE WHEN chain = 'solana' THEN 'CD' ELSE '0xcd' END || wallet AS to_address, amount_tokens * CASE WHEN chain = 'solana' THEN 1000 ELSE 1000000 END AS value, CASE WHEN chain = 'solana' THEN 'sym' ELSE 'SYM' END AS token_symbol,
 CASE WHEN trade_id % 3 = 0 THEN CASE WHEN chain = 'solana' THEN 5 ELSE 6 END ELSE CASE WHEN chain = 'solana' THEN 9 ELSE 18 END END AS token_decimal,
 CASE WHEN chain = 'solana' THEN make_timestamp(epoch_us(ts) // 1000 * 1000) ELSE make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) END AS ts,
 CASE WHEN chain = 'solana' THEN trade_id + 7 ELSE trade_id END AS block_number, chain FROM v_trades""")
def _(t):
    return rd.normalize_transfers(_raw_transfers(t)).drop("token_name").withColumn("value", F.col("value").cast("double"))


def _pairs(t):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    body = F.struct(
        F.struct(F.concat(F.lit("t"), s(k % 40)).alias("address"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name")).alias("baseToken"), s(F.col("p_retailprice")).alias("priceUsd"),
        F.struct(s(F.col("p_size") * 1000).alias("h24")).alias("volume"), F.struct(F.when(k % 9 == 0, "").otherwise(s(F.col("p_size") * 37 + k)).alias("usd")).alias("liquidity"),
        F.struct(F.lit("1.5").alias("h24")).alias("priceChange"), F.struct(F.struct(s(k % 17).alias("buys"), s(k % 5).alias("sells")).alias("h24")).alias("txns"),
        F.when(k % 6 != 0, s(k * 1000)).alias("fdv"), F.concat(F.lit("pair"), F.lpad(s(k), 9, "0")).alias("pairAddress"), F.lit("dex").alias("dexId"),
        F.when(k % 4 != 0, s(F.lit(1704067200) + k * 60)).alias("pairCreatedAt"), F.lit("ethereum").alias("chainId"))
    return rd.parse_pairs(t.raw("part").select(F.to_json(body).alias("payload")))


PAIRS = """pr AS (SELECT 't' || (p_partkey % 40) AS token, 'ethereum' AS chain, p_brand AS symbol, p_name AS name, p_retailprice AS price_usd, CAST(p_size * 1000 AS DOUBLE) AS volume_24h,
  CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE CAST(p_size * 37 + p_partkey AS DOUBLE) END AS liquidity_usd, p_partkey % 17 AS txns_24h_buys, p_partkey % 5 AS txns_24h_sells,
  CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey * 1000 AS DOUBLE) ELSE 0.0 END AS market_cap, 'pair' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS pair_address,
  CASE WHEN p_partkey % 4 <> 0 THEN make_timestamp((1704067200 + p_partkey * 60) * 1000000) END AS pair_created_at FROM part),
sn AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY token ORDER BY liquidity_usd DESC, pair_address DESC) = 1)"""


@query("token_snapshot", f"WITH {PAIRS} SELECT token, chain, symbol, name, round(price_usd, 6) AS price_usd, volume_24h, liquidity_usd, txns_24h_buys, txns_24h_sells, market_cap, pair_address, pair_created_at FROM sn")
def _(t):
    return rd.token_snapshot(_pairs(t)).select("token", "chain", "symbol", "name", "price_usd", "volume_24h", "liquidity_usd", "txns_24h_buys", "txns_24h_sells", "market_cap", "pair_address", "pair_created_at")


@query("pair_search", f"WITH {PAIRS} SELECT token, pair_address, symbol FROM pr WHERE (contains(lower(symbol), '#1') OR contains(lower(name), '#1')) AND chain = 'ethereum'")
def _(t):
    return rd.pair_search(_pairs(t), "#1", "Ethereum").select("token", "pair_address", "symbol")


@query("scan_posts", "SELECT post_id, source, author_id, ts FROM v_posts WHERE contains(lower(text), 'ation') AND ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'")
def _(t):
    return rd.scan_posts(t.posts, "ation", F.lit("2024-01-01 06:00:00").cast("timestamp"), as_of()).select("post_id", "source", "author_id", "ts")


@query("security_feed", """SELECT CAST(token AS VARCHAR) AS token, is_honeypot, is_open_source, is_proxy, is_open_source = '1' AS is_verified FROM v_security_flags""")
def _(t):
    raw = t.security_flags.select(F.to_json(F.struct("*")).alias("payload"))
    return rd.security_feed(raw).select("token", "is_honeypot", "is_open_source", "is_proxy", "is_verified")


@query("token_holders_feed", "SELECT token, CAST(address AS VARCHAR) AS address, round(balance, 6) AS balance FROM v_holders")
def _(t):
    page = F.to_json(F.array(F.struct(F.col("address").cast("string").alias("TokenHolderAddress"), F.format_string("$%.2f", "balance").alias("TokenHolderQuantity"))))
    return rd.token_holders(t.holders.select("token", page.alias("payload")))


# ---------------------------------------------------------------- normalizers
CHAIN_SQL = "CASE lower(chain_raw) WHEN 'eth' THEN 'ethereum' WHEN 'bnb' THEN 'bsc' WHEN 'matic' THEN 'polygon' ELSE lower(chain_raw) END"
ADDR_SQL = f"""CASE WHEN {CHAIN_SQL} IN ('ethereum', 'bsc', 'polygon') THEN lower(CASE WHEN starts_with(trim(address_raw), '0x') THEN trim(address_raw) ELSE '0x' || trim(address_raw) END) ELSE lower(trim(address_raw)) END"""


@query("normalize_address", f"SELECT c_custkey, {ADDR_SQL} AS address FROM v_addresses")
def _(t):
    return t.addresses.select("c_custkey", nz.normalize_address(F.col("address_raw"), nz.normalize_chain(F.col("chain_raw"))).alias("address"))


@query("normalize_chain", f"SELECT c_custkey, {CHAIN_SQL} AS chain FROM v_addresses")
def _(t):
    return t.addresses.select("c_custkey", nz.normalize_chain(F.col("chain_raw")).alias("chain"))


@query("normalize_timestamp", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('day', ts)
  WHEN 4 THEN date_trunc('second', ts) END AS ts FROM events""")
def _(t):
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(
        k == 3, F.date_format("ts", "MM/dd/yyyy")).when(k == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise("yesterday")
    return t.events.select("event_id", nz.normalize_timestamp(text).alias("ts"))


@query("normalize_epoch", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) ELSE make_timestamp(epoch_us(ts) // 1000 * 1000) END AS ts FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_seconds("ts")).otherwise(F.unix_millis("ts"))
    return t.events.select("event_id", nz.normalize_epoch(raw).alias("ts"))


@query("clean_numeric", "SELECT c_custkey, coalesce(TRY_CAST(trim(regexp_replace(amount_raw, '[,$]', '', 'g')) AS DOUBLE), -1) AS amount FROM v_addresses")
def _(t):
    return t.addresses.select("c_custkey", nz.clean_numeric(F.col("amount_raw"), -1.0).alias("amount"))


@query("is_valid_token", f"""SELECT c_custkey, CASE WHEN {CHAIN_SQL} IN ('ethereum', 'bsc', 'polygon') THEN regexp_full_match({ADDR_SQL}, '0x[a-fA-F0-9]{{40}}') ELSE true END AS valid FROM v_addresses""")
def _(t):
    chain = nz.normalize_chain(F.col("chain_raw"))
    return t.addresses.select("c_custkey", nz.is_valid_token(nz.normalize_address(F.col("address_raw"), chain), chain).alias("valid"))


@query("is_valid_wallet", f"""SELECT c_custkey, CASE WHEN {CHAIN_SQL} IN ('ethereum', 'bsc', 'polygon') THEN regexp_full_match(trim(address_raw), '0x[a-fA-F0-9]{{40}}') ELSE false END AS valid,
 regexp_full_match(trim(address_raw), '[1-9A-HJ-NP-Za-km-z]{{32,44}}') AS valid_on_solana FROM v_addresses""")
def _(t):
    a = F.trim("address_raw")
    return t.addresses.select("c_custkey", nz.is_valid_wallet(a, F.col("chain_raw")).alias("valid"), nz.is_valid_wallet(a, F.lit("SOL")).alias("valid_on_solana"))


@query("request_quality", f"""SELECT chain, count(*) FILTER (WHERE address_ok) AS address_ok, count(*) FILTER (WHERE chain_ok) AS chain_ok, count(*) FILTER (WHERE horizon_ok) AS horizon_ok FROM (
 SELECT {CHAIN_SQL} AS chain, CASE WHEN {CHAIN_SQL} IN ('ethereum', 'bsc', 'polygon') THEN starts_with(trim(address_raw), '0x') AND length(trim(address_raw)) = 42 ELSE true END AS address_ok,
  {CHAIN_SQL} IN ('ethereum', 'bsc', 'polygon', 'solana', 'arbitrum', 'optimism', 'avalanche') AS chain_ok, c_custkey % 3 < 2 AS horizon_ok FROM v_addresses) GROUP BY chain""")
def _(t):
    chain = nz.normalize_chain(F.col("chain_raw"))
    horizon = F.when(F.col("c_custkey") % 3 == 0, "24h").when(F.col("c_custkey") % 3 == 1, "90d").otherwise("2h")
    rows = t.addresses.select(chain.alias("chain"), *[c.alias(n) for n, c in nz.request_quality(F.trim("address_raw"), chain, horizon).items()])
    return rows.groupBy("chain").agg(*[F.count_if(c).alias(c) for c in ("address_ok", "chain_ok", "horizon_ok")])


@query("identify_dex", "SELECT CASE trade_id % 4 WHEN 0 THEN 'jupiter' WHEN 1 THEN 'raydium' WHEN 2 THEN 'serum' ELSE 'unknown_dex' END AS dex, count(*) AS transfers FROM v_trades GROUP BY 1")
def _(t):
    dex = nz.identify_dex(F.col("programId"), F.col("instructionData"), F.col("logs"))
    return _transfers(t).groupBy(dex.alias("dex")).agg(F.count(F.lit(1)).alias("transfers"))


@query("assign_wallet", """SELECT wallet, count(*) AS trades FROM (SELECT CASE WHEN side = 'buy' THEN dst ELSE src END AS wallet FROM (SELECT e.src, e.dst, t.side FROM v_edges e JOIN v_trades t ON e.trade_id = t.trade_id)) GROUP BY wallet""")
def _(t):
    from chainsieve.operators.matching import assign_wallet

    buy = F.col("side") == "buy"
    raw = t.trades.withColumn("buyer", F.when(buy, F.col("wallet")).otherwise(F.col("counterparty"))).withColumn("seller", F.when(buy, F.col("counterparty")).otherwise(F.col("wallet"))).drop("wallet")
    return assign_wallet(raw).groupBy("wallet").agg(F.count(F.lit(1)).alias("trades"))


@query("period_bounds", """SELECT p.period, count(*) AS trades FROM v_trades t JOIN (VALUES ('1d', TIMESTAMP '2024-01-30 00:00:00'), ('7d', TIMESTAMP '2024-01-24 00:00:00'), ('30d', TIMESTAMP '2024-01-01 00:00:00'), ('all-time', TIMESTAMP '2020-01-01 00:00:00')) p(period, a)
 ON t.ts >= p.a AND t.ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY p.period""")
def _(t):
    names = ("1d", "7d", "30d", "all-time")
    bounds = {p: nz.period_bounds(p, as_of()) for p in names}
    hit = F.array_compact(F.array(*[F.when(F.col("ts").between(a, b), F.lit(p)) for p, (a, b) in bounds.items()]))
    return t.trades.select(F.explode(hit).alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("trades"))


@query("parse_duration", "SELECT horizon, CASE horizon WHEN '24h' THEN 86400 WHEN '7d' THEN 604800 ELSE 2592000 END AS seconds, count(*) AS predictions FROM v_predictions GROUP BY 1, 2")
def _(t):
    return t.predictions.groupBy("horizon", nz.duration_seconds(F.col("horizon")).alias("seconds")).agg(F.count(F.lit(1)).alias("predictions"))


@query("short_id", "SELECT trade_id, 'trade_' || substring(md5(concat_ws('_', CAST(token AS VARCHAR), CAST(wallet AS VARCHAR), CAST(trade_id AS VARCHAR))), 1, 8) AS id FROM v_trades")
def _(t):
    return t.trades.select("trade_id", nz.short_id("trade", F.col("token"), F.col("wallet"), F.col("trade_id")).alias("id"))
