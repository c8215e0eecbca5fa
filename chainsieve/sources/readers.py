"""Reading landed data and parsing raw feeds into the canonical tables.

Collectors land JSON or Parquet; every parser here is a projection over columns,
so filters on token, chain and time reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainsieve.functions import normalize as nz

PAIR_SCHEMA = (
    "baseToken struct<address:string,symbol:string,name:string>, priceUsd string, priceNative string, volume struct<h24:string>, "
    "liquidity struct<usd:string>, priceChange struct<h24:string,h6:string,h1:string>, txns struct<h24:struct<buys:string,sells:string>>, "
    "fdv string, pairAddress string, dexId string, pairCreatedAt string, chainId string")
SECURITY_SCHEMA = (
    "token string, is_honeypot string, is_open_source string, is_proxy string, is_mintable string, can_take_back_ownership string, "
    "owner_change_balance string, hidden_owner string, selfdestruct string, holder_count string, total_supply string, creator_address string")
HOLDER_SCHEMA = "TokenHolderAddress string, TokenHolderQuantity string"
CONTRACT_SCHEMA = "ContractName string, CompilerVersion string, SourceCode string, Proxy string"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def scan_trades(trades: DataFrame, as_of: Column, window_days: int, token=None, chain: str | None = None, wallet=None) -> DataFrame:
    """Trades of the trailing window, optionally of one token, chain or wallet."""
    out = trades.where((F.col("ts") >= as_of - F.expr(f"INTERVAL {window_days} DAYS")) & (F.col("ts") <= as_of))
    for name, value in (("token", token), ("chain", chain), ("wallet", wallet)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def swaps_from_transfers(transfers: DataFrame) -> DataFrame:
    """Swaps from token transfers: transactions with at least two transfers.

    The side is the sign of ``changeAmount``. On a sell the buyer is the source
    and the seller the destination, which keeps the naming of the raw feed.
    """
    tx = F.coalesce("transactionHash", "signature")
    rows = transfers.withColumn("tx", tx).where(F.col("tx").isNotNull())
    swaps = rows.groupBy("tx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("tx")
    src, dst = F.col("source"), F.col("destination")
    buy = F.coalesce("changeAmount", F.lit(0)) > 0
    amount = F.col("amount").cast("double") / F.pow(F.lit(10.0), F.coalesce("decimals", F.lit(9)).cast("double"))
    return rows.join(swaps, "tx", "left_semi").where(src.isNotNull() & dst.isNotNull() & (F.coalesce("blockTime", F.lit(0)) != 0)).select(
        F.col("tx").alias("transaction_hash"), F.when(buy, "buy").otherwise("sell").alias("side"),
        F.when(buy, dst).otherwise(src).alias("buyer"), F.when(buy, src).otherwise(dst).alias("seller"),
        F.timestamp_seconds("blockTime").alias("ts"), F.abs(amount).alias("amount_tokens"), F.lit(0.0).alias("amount_usd"),
        nz.identify_dex(F.col("programId"), F.col("instructionData"), F.col("logs")).alias("dex"), F.lit(0.0).alias("gas_price"))


def wallet_swaps(account_txs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Account transactions as trades: side and size from the signed change."""
    ts = F.timestamp_seconds("blockTime")
    change = F.coalesce("changeAmount", F.lit(0)).cast("double")
    size = F.abs(change) / F.pow(F.lit(10.0), F.coalesce("decimals", F.lit(9)).cast("double"))
    return account_txs.where(F.coalesce("blockTime", F.lit(0)) != 0).withColumn("ts", ts).where(F.col("ts").between(start, end)).select(
        F.col("signature").alias("transaction_hash"), F.when(change > 0, "buy").otherwise("sell").alias("side"), "ts", size.alias("amount_tokens"),
        F.lit(0.0).alias("amount_usd"), F.lit("unknown").alias("dex"))


def token_trades_from_tx(tx: DataFrame, token: Column) -> DataFrame:
    """Transactions with nested ``logs`` that touch the token.

    Direction comes from the first matching log; amount is the sum of all of
    them; equal senders and receivers mark a circular transfer.
    """
    rows = tx.withColumn("hits", F.filter("logs", lambda x: F.lower(x["address"]) == F.lower(token)))
    first, me = F.get("hits", F.lit(0)), F.lower(F.col("from"))
    froms, tos = F.transform("hits", lambda x: F.lower(x["from"])), F.transform("hits", lambda x: F.lower(x["to"]))
    side = F.when(F.lower(first["from"]) == me, "sell").when(F.lower(first["to"]) == me, "buy").otherwise("transfer")
    return rows.select(
        "hash", "ts", "from", "to", (F.size("hits") > 0).alias("matched"), side.alias("type"),
        F.aggregate("hits", F.lit(0.0), lambda s, x: s + x["value"].cast("double")).alias("amount"), F.col("value").alias("value_usd"),
        F.arrays_overlap(froms, tos).alias("is_wash_trade"), F.size("hits").alias("hop_count"))


def unmatched_rate(matched: DataFrame) -> DataFrame:
    return matched.agg(F.avg((~F.col("matched")).cast("double")).alias("error_rate"), F.count(F.lit(1)).alias("transactions"))


def normalize_transfers(raw: DataFrame) -> DataFrame:
    """One schema for the two raw layouts; ``chain`` decides which columns are read."""
    chain = nz.normalize_chain(F.col("chain"))
    evm, spl = chain.isin("ethereum", "bsc"), chain == "solana"
    pick = lambda a, b: F.when(evm, a).when(spl, b)
    c = F.col
    return raw.select(
        pick(c("hash"), c("signature")).alias("hash"),
        pick(nz.normalize_address(F.coalesce(c("from"), F.lit("")), chain), c("src")).alias("from_address"),
        pick(nz.normalize_address(F.coalesce(c("to"), F.lit("")), chain), c("dst")).alias("to_address"),
        pick(F.coalesce(c("value"), F.lit("0")), F.coalesce(c("amount"), F.lit("0"))).try_cast("decimal(38,0)").alias("value"),
        pick(c("tokenSymbol"), c("symbol")).alias("token_symbol"), pick(c("tokenName"), c("name")).alias("token_name"),
        pick(F.coalesce(c("tokenDecimal").try_cast("int"), F.lit(18)), F.coalesce(c("decimals").try_cast("int"), F.lit(9))).alias("token_decimal"),
        nz.normalize_epoch(pick(c("timeStamp").try_cast("bigint"), c("blockTime").try_cast("bigint"))).alias("ts"),
        pick(c("blockNumber").try_cast("bigint"), c("slot").try_cast("bigint")).alias("block_number"), chain.alias("chain"))


def parse_pairs(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Pair JSON to flat market rows; absent or blank numbers become 0."""
    p = F.from_json(column, PAIR_SCHEMA).alias("p")
    num = lambda path, t="double": F.coalesce(F.col(path).try_cast(t), F.lit(0).cast(t))
    return raw.select(p).select(
        F.col("p.baseToken.address").alias("token"), F.col("p.chainId").alias("chain"), F.col("p.baseToken.symbol").alias("symbol"), F.col("p.baseToken.name").alias("name"),
        num("p.priceUsd").alias("price_usd"), num("p.priceNative").alias("price_native"), num("p.volume.h24").alias("volume_24h"), num("p.liquidity.usd").alias("liquidity_usd"),
        num("p.priceChange.h24").alias("price_change_24h"), num("p.priceChange.h6").alias("price_change_6h"), num("p.priceChange.h1").alias("price_change_1h"),
        num("p.txns.h24.buys", "bigint").alias("txns_24h_buys"), num("p.txns.h24.sells", "bigint").alias("txns_24h_sells"), num("p.fdv").alias("market_cap"),
        F.col("p.pairAddress").alias("pair_address"), F.col("p.dexId").alias("dex_id"), nz.normalize_epoch(F.col("p.pairCreatedAt").try_cast("bigint")).alias("pair_created_at"))


def token_snapshot(pairs: DataFrame) -> DataFrame:
    """Market row of each token's most liquid pair."""
    rest = [c for c in pairs.columns if c not in ("token", "chain")]
    best = F.max_by(F.struct(*rest), F.struct("liquidity_usd", "pair_address"))
    return pairs.groupBy("token", "chain").agg(best.alias("b")).select("token", "chain", "b.*")


def pair_search(pairs: DataFrame, text: str, chain: str | None = None) -> DataFrame:
    like = F.lower("symbol").contains(text.lower()) | F.lower("name").contains(text.lower())
    out = pairs.where(like)
    return out.where(F.lower("chain") == chain.lower()) if chain else out


def scan_posts(posts: DataFrame, text: str, start: Column, end: Column) -> DataFrame:
    """Posts that mention the text anywhere in their body within the time range."""
    return posts.where((F.col("ts") >= start) & (F.col("ts") <= end) & F.lower("text").contains(text.lower()))


def security_feed(raw: DataFrame, column: str = "payload") -> DataFrame:
    return raw.select(F.from_json(column, SECURITY_SCHEMA).alias("s")).select("s.*").withColumn("is_verified", F.coalesce("is_open_source", F.lit("")) == "1")


def token_holders(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Holder rows from pages of JSON, one page per row."""
    page = F.from_json(column, f"array<struct<{HOLDER_SCHEMA.replace(' string', ':string')}>>")
    rows = raw.select("token", F.explode(page).alias("h"))
    return rows.select("token", F.col("h.TokenHolderAddress").alias("address"), nz.clean_numeric(F.col("h.TokenHolderQuantity")).alias("balance"))


def contract_feed(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Contract metadata; a contract counts as verified when its source is published."""
    c = F.from_json(column, CONTRACT_SCHEMA).alias("c")
    return raw.select("token", c).select(
        "token", F.col("c.ContractName").alias("contract_name"), F.coalesce("c.CompilerVersion", F.lit("")).alias("compiler_version"),
        (F.coalesce("c.SourceCode", F.lit("")) != "").alias("is_verified"), (F.coalesce("c.Proxy", F.lit("0")) == "1").alias("is_proxy"))
