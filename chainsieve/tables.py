"""Canonical tables derived from the driver's star schema.

``Tables`` is the Spark side; ``SQL_VIEWS`` is the same derivation as plain SQL
text, used only by the independent checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
PERIOD_START = "2024-01-01 00:00:00"


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


def money(column: str | F.Column) -> F.Column:
    """An amount as an exact decimal, so sums do not depend on order.

    Twelve decimals and 26 digits before them; an amount beyond that raises an error.
    """
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("decimal(38,12)")


def tokens(column: str | F.Column) -> F.Column:
    """The same for amounts of tokens: fifteen decimals, 23 digits before them."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("decimal(38,15)")


def trade_rows(events: DataFrame) -> DataFrame:
    """Trades made of the generic event rows; the same projection serves batch and stream."""
    lot = (1 + F.col("event_id") % 7).cast("double")
    return events.where(F.col("event_type") != "error").select(
        F.col("event_id").alias("trade_id"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10).alias("token"),
        F.when(F.col("user_id") % 3 == 0, "ethereum").when(F.col("user_id") % 3 == 1, "bsc").otherwise("solana").alias("chain"),
        F.col("user_id").alias("wallet"),
        (F.col("user_id") + 1 + F.col("event_id") % 11).alias("counterparty"),
        F.when(F.col("event_type").isin("purchase", "signup"), "sell").otherwise("buy").alias("side"),
        "ts",
        lot.alias("amount_tokens"),
        F.col("value").alias("amount_usd"),
        (F.col("value") / lot).alias("price"),
        F.element_at(F.array(*[F.lit(d) for d in ("uniswap", "sushiswap", "raydium", "orca")]), (F.col("event_id") % 4 + 1).cast("int")).alias("dex"),
        (20 + F.col("event_id") % 13).cast("double").alias("gas_price"),
        (F.col("event_id") % 72).cast("double").alias("token_age_hours"),
    )


class Tables:
    """Lazy canonical tables under one input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def trades(self) -> DataFrame:
        return trade_rows(self.events)

    @cached_property
    def prices(self) -> DataFrame:
        hour = F.date_trunc("hour", "ts")
        return (
            self.trades.groupBy("token", hour.alias("hour"))
            .agg(F.max_by("price", "ts").alias("price"), F.count(F.lit(1)).alias("n"))
            .select(
                "token", F.col("hour").alias("ts"), "price",
                (30000.0 + 15000.0 * F.col("n")).alias("liquidity_usd"),
                (6000.0 * F.col("n")).alias("volume_24h"),
            )
        )

    @cached_property
    def edges(self) -> DataFrame:
        buy = F.col("side") == "buy"
        return self.trades.select(
            "trade_id", "ts", "amount_usd",
            F.when(buy, F.col("counterparty")).otherwise(F.col("wallet")).alias("src"),
            F.when(buy, F.col("wallet")).otherwise(F.col("counterparty")).alias("dst"),
            F.when(F.col("trade_id") % 4 == 0, "fund_flow").otherwise("trade").alias("type"),
        )

    @cached_property
    def holders(self) -> DataFrame:
        return self.raw("customer").where(F.col("c_acctbal") > 0).select(
            F.col("c_mktsegment").alias("token"), F.col("c_custkey").alias("address"), F.col("c_acctbal").alias("balance"))

    @cached_property
    def positions(self) -> DataFrame:
        from chainsieve.operators.wallet import open_positions

        return open_positions(self.trades)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.element_at(F.array(F.lit("24h"), F.lit("7d"), F.lit("30d")), F.col("l_linenumber") % 3 + 1).alias("horizon"),
            F.element_at(F.array(*[F.lit(m) for m in ("2x", "5x", "10x", "20x", "50x")]), (F.col("l_partkey") % 5 + 1).cast("int")).alias("multiplier"),
            ((F.col("l_quantity") - 0.5) / 50.0).alias("probability"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("outcome"),
        )

    @cached_property
    def posts(self) -> DataFrame:
        docs = self.raw("documents").alias("d")
        who = self.events.select("event_id", "user_id", "ts").alias("e")
        return docs.join(who, F.col("d.doc_id") == F.col("e.event_id")).select(
            F.col("doc_id").alias("post_id"), F.col("lang").alias("source"), F.col("user_id").alias("author_id"), "ts", "text",
            (F.col("n_chars") % 50).alias("like_count"), (F.col("n_chars") % 173).alias("retweet_count"), (F.col("n_chars") % 7).alias("reply_count"),
        )

    @cached_property
    def security_flags(self) -> DataFrame:
        k = F.col("s_suppkey")
        on = lambda n: F.when(k % n == 0, "1").otherwise("0")
        return self.raw("supplier").select(
            k.alias("token"), on(7).alias("is_honeypot"), F.when(k % 3 == 0, "0").otherwise("1").alias("is_open_source"),
            on(5).alias("is_proxy"), on(4).alias("is_mintable"), on(11).alias("can_take_back_ownership"),
            on(6).alias("owner_change_balance"), on(9).alias("hidden_owner"), on(13).alias("selfdestruct"),
        )

    @cached_property
    def addresses(self) -> DataFrame:
        k = F.col("c_custkey")
        tail = F.substring(F.md5("c_mktsegment"), 1, 7)
        tail8 = F.substring(F.md5("c_mktsegment"), 1, 8)
        return self.raw("customer").select(
            k,
            F.when(k % 4 == 0, "ETH").when(k % 4 == 1, "bnb").when(k % 4 == 2, "matic").otherwise("other").alias("chain_raw"),
            F.concat(F.when(k % 2 == 0, " 0x").otherwise(""), F.upper(F.md5("c_name")), F.when(k % 10 == 9, tail).otherwise(tail8)).alias("address_raw"),
            F.when(k % 17 == 0, "n/a").otherwise(F.concat(F.lit("$"), k.cast("string"), F.lit(","), F.lit("123.50"))).alias("amount_raw"),
        )

    @cached_property
    def equity(self) -> DataFrame:
        signed = F.when(F.col("side") == "sell", F.col("amount_usd")).otherwise(-F.col("amount_usd"))
        return self.trades.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum(money(signed)).cast("double").alias("pnl"))

    @cached_property
    def known_smart(self) -> DataFrame:
        """Wallets that sold for at least 20 % more than they bought."""
        from chainsieve.operators.matching import wallet_volumes

        return wallet_volumes(self.trades).where(F.col("sell_volume_usd") > 1.2 * F.col("buy_volume_usd")).select("wallet")

    @cached_property
    def busiest(self) -> DataFrame:
        """The one wallet with most trades: the subject of single-wallet reports."""
        n = self.trades.groupBy("wallet").agg(F.count(F.lit(1)).alias("n"))
        return n.orderBy(F.col("n").desc(), "wallet").limit(1).select("wallet")

    @cached_property
    def listings(self) -> DataFrame:
        return self.trades.groupBy("token").agg(F.min("ts").alias("listed_ts"))


SQL_VIEWS = {
    "v_trades": """SELECT event_id AS trade_id,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS token,
       CASE user_id % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bsc' ELSE 'solana' END AS chain,
       user_id AS wallet,
       user_id + 1 + event_id % 11 AS counterparty,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'sell' ELSE 'buy' END AS side,
       ts,
       CAST(1 + event_id % 7 AS DOUBLE) AS amount_tokens,
       value AS amount_usd,
       value / CAST(1 + event_id % 7 AS DOUBLE) AS price,
       CASE event_id % 4 WHEN 0 THEN 'uniswap' WHEN 1 THEN 'sushiswap' WHEN 2 THEN 'raydium' ELSE 'orca' END AS dex,
       CAST(20 + event_id % 13 AS DOUBLE) AS gas_price,
       CAST(event_id % 72 AS DOUBLE) AS token_age_hours
FROM events WHERE event_type <> 'error'""",
    "v_prices": """SELECT token, date_trunc('hour', ts) AS ts, max_by(price, ts) AS price,
       CAST(30000 + 15000 * count(*) AS DOUBLE) AS liquidity_usd,
       CAST(6000 * count(*) AS DOUBLE) AS volume_24h
FROM v_trades GROUP BY token, date_trunc('hour', ts)""",
    "v_edges": """SELECT trade_id, ts, amount_usd,
       CASE WHEN side = 'buy' THEN counterparty ELSE wallet END AS src,
       CASE WHEN side = 'buy' THEN wallet ELSE counterparty END AS dst,
       CASE WHEN trade_id % 4 = 0 THEN 'fund_flow' ELSE 'trade' END AS type
FROM v_trades""",
    "v_holders": "SELECT c_mktsegment AS token, c_custkey AS address, c_acctbal AS balance FROM customer WHERE c_acctbal > 0",
    "v_positions": """SELECT wallet, token,
       sum(CASE WHEN side = 'buy' THEN amount_tokens ELSE -amount_tokens END) AS amount,
       CAST(sum(CASE WHEN side = 'buy' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)
         / sum(CASE WHEN side = 'buy' THEN amount_tokens ELSE 0 END) AS avg_buy_price
FROM v_trades GROUP BY wallet, token
HAVING sum(CASE WHEN side = 'buy' THEN amount_tokens ELSE -amount_tokens END) > 0""",
    "v_predictions": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate AS ts,
       CASE l_linenumber % 3 WHEN 0 THEN '24h' WHEN 1 THEN '7d' ELSE '30d' END AS horizon,
       CASE l_partkey % 5 WHEN 0 THEN '2x' WHEN 1 THEN '5x' WHEN 2 THEN '10x' WHEN 3 THEN '20x' ELSE '50x' END AS multiplier,
       (l_quantity - 0.5) / 50.0 AS probability,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS outcome
FROM lineitem""",
    "v_posts": """SELECT d.doc_id AS post_id, d.lang AS source, e.user_id AS author_id, e.ts, d.text,
       d.n_chars % 50 AS like_count, d.n_chars % 173 AS retweet_count, d.n_chars % 7 AS reply_count
FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "v_security_flags": """SELECT s_suppkey AS token,
       CASE WHEN s_suppkey % 7 = 0 THEN '1' ELSE '0' END AS is_honeypot,
       CASE WHEN s_suppkey % 3 = 0 THEN '0' ELSE '1' END AS is_open_source,
       CASE WHEN s_suppkey % 5 = 0 THEN '1' ELSE '0' END AS is_proxy,
       CASE WHEN s_suppkey % 4 = 0 THEN '1' ELSE '0' END AS is_mintable,
       CASE WHEN s_suppkey % 11 = 0 THEN '1' ELSE '0' END AS can_take_back_ownership,
       CASE WHEN s_suppkey % 6 = 0 THEN '1' ELSE '0' END AS owner_change_balance,
       CASE WHEN s_suppkey % 9 = 0 THEN '1' ELSE '0' END AS hidden_owner,
       CASE WHEN s_suppkey % 13 = 0 THEN '1' ELSE '0' END AS selfdestruct
FROM supplier""",
    "v_addresses": """SELECT c_custkey,
       CASE c_custkey % 4 WHEN 0 THEN 'ETH' WHEN 1 THEN 'bnb' WHEN 2 THEN 'matic' ELSE 'other' END AS chain_raw,
       concat(CASE WHEN c_custkey % 2 = 0 THEN ' 0x' ELSE '' END, upper(md5(c_name)), substring(md5(c_mktsegment), 1, CASE WHEN c_custkey % 10 = 9 THEN 7 ELSE 8 END)) AS address_raw,
       CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE concat('$', CAST(c_custkey AS VARCHAR), ',', '123.50') END AS amount_raw
FROM customer""",
    "v_equity": """SELECT date_trunc('day', ts) AS day,
       CAST(sum(CAST(CASE WHEN side = 'sell' THEN amount_usd ELSE -amount_usd END AS DECIMAL(18,2))) AS DOUBLE) AS pnl
FROM v_trades GROUP BY date_trunc('day', ts)""",
    "v_smart": """SELECT wallet FROM v_trades GROUP BY wallet HAVING sum(CASE WHEN side = 'sell' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE 0 END)
       > 1.2 * CAST(sum(CASE WHEN side = 'buy' THEN CAST(amount_usd AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)""",
    "v_busiest": "SELECT wallet FROM v_trades GROUP BY wallet ORDER BY count(*) DESC, wallet LIMIT 1",
    "v_listings": "SELECT token, min(ts) AS listed_ts FROM v_trades GROUP BY token",
}

# First-in first-out lots as an interval overlap, and the closed trades built on them.
SQL_VIEWS["v_lots"] = """SELECT trade_id, token, wallet, chain, side, ts, amount_tokens AS qty, amount_usd AS usd,
       sum(amount_tokens) OVER w AS hi, sum(amount_tokens) OVER w - amount_tokens AS lo
FROM v_trades WINDOW w AS (PARTITION BY token, wallet, side ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)"""
SQL_VIEWS["v_overlaps"] = """SELECT s.trade_id, s.token, s.wallet, s.chain, s.ts AS exit_ts, s.usd AS sell_value_usd, b.ts AS entry_ts, b.lo AS blo,
       greatest(s.lo, b.lo) AS o0, least(s.hi, b.hi) AS o1,
       (least(s.hi, b.hi) - greatest(s.lo, b.lo)) / b.qty * b.usd AS cost,
       (epoch_us(s.ts) - epoch_us(b.ts)) / 1000000.0 AS held
FROM v_lots s JOIN v_lots b ON s.side = 'sell' AND b.side = 'buy' AND s.token = b.token AND s.wallet = b.wallet AND b.lo < s.hi AND s.lo < b.hi"""
SQL_VIEWS["v_closed"] = """SELECT trade_id, token, wallet, chain, exit_ts, min(entry_ts) AS entry_ts, sell_value_usd, sum(cost) AS cost_basis_usd,
       sell_value_usd - sum(cost) AS pnl,
       CASE WHEN sum(cost) > 0 THEN (sell_value_usd - sum(cost)) / sum(cost) ELSE 0 END AS roi,
       CASE WHEN sum(cost) > 0 THEN sum(held * cost) / sum(cost) / 3600.0 ELSE 0 END AS holding_hours,
       count(*) AS matched_buys
FROM v_overlaps GROUP BY trade_id, token, wallet, chain, exit_ts, sell_value_usd"""


def with_views(sql: str) -> str:
    """Prefix a check with the views it uses, in dependency order."""
    import re

    order = list(SQL_VIEWS)
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in order:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(SQL_VIEWS[name])

    add(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order if n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
