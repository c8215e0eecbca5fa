"""Live trades: landed messages, running wallet signals, windows and alerts.

Every operator takes and returns a DataFrame and works on a stream and on a
static table alike. Event time comes from the message; arrival order counts in
``live_wallet_states`` alone, which runs on streams only.
"""

from __future__ import annotations

import decimal
import logging
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from chainsieve.tables import money

log = logging.getLogger(__name__)

MESSAGE_SCHEMA = "params struct<result:struct<signature:string,logs:array<string>,transactionHash:string,`from`:string,`to`:string>>"
CHAINS = ("solana", "ethereum")
ALERT_BUCKETS = 20


# ---------------------------------------------------------------- sources
def read_messages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Raw message lines landed as text files."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw messages from a topic, where the Kafka connector is on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


def read_rows(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000, names: str = "*") -> DataFrame:
    """Typed rows landed as files in a folder; ``names`` is a pattern of file names."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", names).format(fmt).load(path)


def live_trades(messages: DataFrame, chain: str) -> DataFrame:
    """Log messages of one chain as trade rows; messages without a result are dropped."""
    if chain not in CHAINS:
        raise ValueError(f"unsupported chain: {chain}")
    body = F.from_json("value", MESSAGE_SCHEMA)["params"]["result"]
    rows = messages.withColumn("r", body).where(F.col("r").isNotNull()).withColumn("chain", F.lit(chain)).withColumn("type", F.lit("live_trade"))
    keep = [c for c in messages.columns if c != "value"]
    if chain == "solana":
        return rows.select(*keep, "chain", "type", F.col("r.signature").alias("signature"), F.coalesce("r.logs", F.array().cast("array<string>")).alias("logs"))
    return rows.select(*keep, "chain", "type", F.col("r.transactionHash").alias("transaction_hash"), F.col("r.from").alias("from"), F.col("r.to").alias("to"))


def token_filter(trades: DataFrame, token=None, chain: str | None = None) -> DataFrame:
    out = trades
    if chain is not None:
        if chain not in ("solana", "ethereum", "bsc"):
            raise ValueError(f"unsupported chain: {chain}")
        out = out.where(F.col("chain") == chain)
    return out.where(F.col("token") == token) if token is not None else out


def dedup_late(trades: DataFrame, key: str = "trade_id", lateness: str = "1 hour") -> DataFrame:
    """One row per key among copies that arrive within ``lateness`` of each other; state expires with the watermark."""
    if not trades.isStreaming:
        return trades.dropDuplicates([key])
    return trades.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def trade_wallet(trades: DataFrame) -> Column:
    """The buyer, else the sender, else the wallet column."""
    named = [F.col(c) for c in ("buyer", "from", "wallet") if c in trades.columns]
    return F.coalesce(*named) if len(named) > 1 else named[0]


# ---------------------------------------------------------------- running state
def live_wallet_signals(trades: DataFrame) -> DataFrame:
    """Running totals per wallet, for update mode.

    The sums are folded per input partition before they reach the state of a
    wallet, so a very active wallet costs one row per partition and batch.
    """
    rows = trades.withColumn("wallet", trade_wallet(trades)).where(F.col("wallet").isNotNull())
    buy = F.col("side") == "buy"
    usd = money(F.coalesce("amount_usd", F.lit(0.0)))
    return rows.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(usd).cast("double").alias("total_volume"), F.count_if(F.coalesce(buy, F.lit(False))).alias("buy_count"),
        F.count_if(~F.coalesce(buy, F.lit(False))).alias("sell_count"), F.max("ts").alias("last_trade_time"))


WALLET_STATE = "trade_count long, total_volume decimal(38,12), buy_count long, sell_count long, last_arrived long, last_order long, last_trade_time timestamp"


class _WalletSignals(StatefulProcessor):
    """Running totals of a wallet, and the time of the trade that arrived last; forgotten when nothing arrives for the time to live."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("signals", WALLET_STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total, buys, sells, arrived, order, at = self.state.get() if self.state.exists() else (0, decimal.Decimal(0), 0, 0, -(1 << 62), 0, None)
        with decimal.localcontext(decimal.Context(prec=60)):
            for frame in rows:
                n, buys, sells = n + len(frame), buys + int(frame["buy"].sum()), sells + int((~frame["buy"].astype(bool)).sum())
                total = sum(frame["usd"], total)
                last = frame.sort_values(["arrived", "order"]).iloc[-1]
                if (last["arrived"], last["order"]) >= (arrived, order):
                    arrived, order, at = int(last["arrived"]), int(last["order"]), last["ts"].to_pydatetime()
        self.state.update((n, total, buys, sells, arrived, order, at))
        yield pd.DataFrame({"wallet": [key[0]], "trade_count": [n], "total_volume": [float(total)], "buy_count": [buys], "sell_count": [sells], "last_trade_time": [at]})

    def close(self) -> None:
        pass


def live_wallet_states(trades: DataFrame, *, arrived: str = "arrived", order: str = "trade_id", ttl: str | None = "30 days") -> DataFrame:
    """Running totals per wallet of a stream, in update mode, with the time of the trade that *arrived* last.

    ``arrived`` is the arrival time; trades that arrive together count in the order of
    ``order``, a number. A wallet from which nothing arrives for ``ttl`` of processing
    time is forgotten and starts anew, so the state is bounded by the wallets active in
    that time. A wallet's rows of a batch pass through in pieces. Start the query within
    ``keyed_state``.
    """
    rows = trades.withColumn("wallet", trade_wallet(trades)).where(F.col("wallet").isNotNull())
    rows = rows.select(
        "wallet", F.coalesce(F.col("side") == "buy", F.lit(False)).alias("buy"), money(F.coalesce("amount_usd", F.lit(0.0))).alias("usd"), "ts",
        F.unix_micros(arrived).alias("arrived"), F.col(order).cast("long").alias("order"))
    ttl_ms = None if ttl is None else parse_interval_ms(ttl)
    wallet = rows.schema["wallet"].dataType.simpleString()
    return rows.groupBy("wallet").transformWithStateInPandas(
        _WalletSignals(ttl_ms), f"wallet {wallet}, trade_count long, total_volume double, buy_count long, sell_count long, last_trade_time timestamp", "Update", "ProcessingTime")


def parse_interval_ms(text: str) -> int:
    """Milliseconds of a number and a unit, such as "30 days"."""
    number, unit = text.split()
    return int(float(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, as custom state needs it, and run no batch without data, of which a time to live would ask for ever more."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def signal_updates(trades: DataFrame, handlers: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Hand every batch of changed signals to each named handler.

    An error in one handler does not stop the others; it is logged, and the batch is
    kept under ``checkpoint``/failed/handler=NAME/batch=ID, from where it can be replayed.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, handler in handlers.items():
            try:
                handler(batch, batch_id)
            except Exception:
                log.exception("handler %s failed on batch %d", name, batch_id)
                batch.write.mode("overwrite").parquet(f"{checkpoint}/failed/handler={name}/batch={batch_id}")
        batch.unpersist()

    writer = live_wallet_signals(trades).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_windows(trades: DataFrame, keys: list[str], *, size: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Counts and volume per tumbling or sliding window."""
    rows = trades.withWatermark("ts", lateness) if trades.isStreaming else trades
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    usd = money("amount_usd")
    return rows.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("trades"), F.sum(usd).cast("double").alias("volume_usd")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "trades", "volume_usd")


def stream_sessions(trades: DataFrame, keys: list[str], *, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Groups of trades with no pause of ``gap`` or longer.

    On a stream (append mode) a late trade within ``lateness`` joins its session, or
    makes one of the two it lies between; a session is returned once the watermark has
    passed its end.
    """
    rows = trades.withWatermark("ts", lateness) if trades.isStreaming else trades
    return rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("trades")).select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "trades")


# ---------------------------------------------------------------- alerts
def _bucket(share: Column) -> Column:
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * ALERT_BUCKETS).cast("int")


def alert_matches(scores: DataFrame, subscriptions: DataFrame, *, pairs_per_task: int = 1 << 28) -> DataFrame:
    """One row per scored row, active subscription and trigger that fires.

    ``scores``: token, wallet, probability_2x, probability_10x, risk_score, dev_sells, and
    any other columns. A subscription without thresholds fires on any activity in
    its scope; without token or wallet lists its scope is everything. Rows meet
    subscriptions in a hash join on (scope, trigger, value bucket); the scope is a
    token, else a wallet, else everything, so no row meets a subscription that is
    limited to other tokens or wallets.

    There can be as many matches as pairs of rows and subscriptions. Of stored scores
    (``run_to_table``) they are made while they are read, so what is on disk grows with
    the scores alone; a key with more than ``pairs_per_task`` pairs is cut into shares of its rows.
    """
    def trigger(kind: str, column: str, scale: float) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(column).cast("double").alias("limit"), _bucket(F.col(column) / scale).alias("low")))

    made = F.array_compact(F.array(
        trigger("probability_2x", "min_probability_2x", 1.0), trigger("probability_10x", "min_probability_10x", 1.0),
        trigger("risk_score", "max_risk_score", 100.0), trigger("dev_sells", "dev_sell_threshold", 100.0)))
    kind_type = "array<struct<kind:string,limit:double,low:int>>"
    activity = F.array(F.struct(F.lit("activity").alias("kind"), F.lit(0.0).alias("limit"), F.lit(0).alias("low")))
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x.cast("string")))
    scope = F.coalesce(named("t:", "token_addresses"), named("w:", "wallet_addresses"), F.array(F.lit("*")))
    subs = (
        subscriptions.where("active").select(F.col("id").alias("subscription_id"), "webhook_url", "wallet_addresses", F.explode(F.array_distinct(scope)).alias("scope"),
                                             F.when(F.size(made) > 0, made.cast(kind_type)).otherwise(activity.cast(kind_type)).alias("t"))
        .withColumn("t", F.explode("t"))
        .select("subscription_id", "webhook_url", "wallet_addresses", "scope", F.col("t.kind").alias("kind"), F.col("t.limit").alias("limit"),
                F.explode(F.sequence(F.col("t.low"), F.lit(ALERT_BUCKETS))).alias("bucket")))

    def value(kind: str, scale: float) -> Column:
        c = F.lit(1.0) if kind == "activity" else F.col(kind).cast("double")
        return F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.alias("value"), _bucket(c / scale).alias("bucket")))

    if not scores.isStreaming:
        scores = scores.hint("rebalance")  # stored scores can be few files
    values = F.array_compact(F.array(value("probability_2x", 1.0), value("probability_10x", 1.0), value("risk_score", 100.0), value("dev_sells", 100.0), value("activity", 1.0)))
    rows = scores.withColumn("v", F.explode(values)).withColumn("scope", F.explode(F.array_compact(F.array(F.concat(F.lit("t:"), F.col("token").cast("string")), F.concat(F.lit("w:"), F.col("wallet").cast("string")), F.lit("*"))))).select(*scores.columns, "scope", "v.*")
    subs = subs.withColumn("at_limit", F.col("kind") != "risk_score")  # told once per subscription, not per pair
    fires = (F.col("value") > F.col("limit")) | (F.col("at_limit") & (F.col("value") == F.col("limit")))
    mine = F.col("wallet_addresses").isNull() | F.array_contains("wallet_addresses", F.col("wallet").cast("string"))
    keys = ["scope", "kind", "bucket"]
    if not scores.isStreaming:  # the rows of a stream can't be counted before they meet
        number = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
        shares = F.ceil(F.col("n_rows") * F.col("n_subs").cast("double") / pairs_per_task).cast("int")
        hot = F.broadcast(number(rows, "n_rows").join(number(subs, "n_subs"), keys).select(*keys, shares.alias("shares")).where("shares > 1"))  # each stands for very many matches
        cut = F.coalesce("shares", F.lit(1))
        rows = rows.join(hot, keys, "left").withColumn("share", F.pmod(F.xxhash64(*scores.columns), cut).cast("int")).drop("shares")
        subs = subs.join(hot, keys, "left").withColumn("share", F.explode(F.sequence(F.lit(0), cut - 1))).drop("shares")
        keys = [*keys, "share"]
    return rows.join(subs, keys).where(fires & mine).select(
        "subscription_id", "webhook_url", *scores.columns, F.col("kind").alias("trigger"), "value", F.col("limit").alias("threshold"))


# ---------------------------------------------------------------- sinks
def run_to_table(stream: DataFrame, path: str, *, mode: str = "append") -> DataFrame:
    """Process everything available into a table, one folder per batch, and read it back with its batch id.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession  # custom state is planned for the thread's active session, which a callback's thread lacks
        session.sparkContext._jvm.org.apache.spark.sql.SparkSession.setActiveSession(session._jsparkSession)
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last written state of each key of an update-mode table."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")
