"""Token, holder, pool, social and time-window features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.functions.normalize import parse_duration
from chainsieve.operators.ordered import join_same, ordered_scan, value_at_share, value_slice
from chainsieve.operators.wallet import ratio, seconds_between
from chainsieve.tables import money, tokens


# ---------------------------------------------------------------- market and liquidity
def market_features(tokens: DataFrame, as_of: Column) -> DataFrame:
    mcap, buys, sells = F.col("market_cap"), F.col("txns_24h_buys"), F.col("txns_24h_sells")
    return (
        tokens.withColumn("volume_to_mcap_ratio", F.when(mcap > 0, F.col("volume_24h") / mcap).otherwise(0.0))
        .withColumn("txns_24h_total", buys + sells)
        .withColumn("buy_sell_ratio", F.when(buys + sells > 0, buys / (buys + sells)).otherwise(0.5))
        .withColumn("token_age_hours", F.coalesce(seconds_between(F.col("pair_created_at"), as_of) / 3600.0, F.lit(0.0)))
    )


def liquidity_features(tokens: DataFrame) -> DataFrame:
    liq = F.col("liquidity_usd")
    out = tokens.withColumn("liquidity_to_mcap", F.when(F.col("market_cap") > 0, liq / F.col("market_cap")).otherwise(0.0))
    for pct in (1, 5, 10):
        out = out.withColumn(f"liquidity_depth_{pct}pct", liq * (pct / 100.0))
    return out


def pool_depth(pools: DataFrame) -> DataFrame:
    reserve = F.coalesce("reserves_token", F.lit(1.0))
    return pools.withColumn("depth_1pct", reserve * 0.01 / 2.0).withColumn("depth_5pct", reserve * 0.05 / 2.0)


def pool_activity(events: DataFrame, as_of: Column, window_hours: int = 24) -> DataFrame:
    """Added and removed liquidity per pool within the trailing window."""
    recent = seconds_between(F.col("ts"), as_of) / 3600.0 < window_hours
    add, remove = recent & (F.col("type") == "add_liquidity"), recent & (F.col("type") == "remove_liquidity")
    usd = money("value_usd")
    return events.groupBy("pool").agg(
        F.count_if(add).alias("liq_add_count"), F.count_if(remove).alias("liq_remove_count"),
        F.sum(F.when(add, usd).when(remove, -usd).otherwise(0)).cast("double").alias("net_liq_change_usd"))


def liquidity_concentration(positions: DataFrame) -> DataFrame:
    """Herfindahl index of provider shares per pool, from the sums of x and x squared."""
    x = F.col("liquidity")
    return positions.groupBy("pool").agg(F.when(F.sum(x) > 0, F.sum(x * x) / F.sum(x) ** 2).otherwise(0.0).alias("liquidity_concentration"))


# ---------------------------------------------------------------- holders
def _head_sums(holders: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Balance of the largest k holders per token; the k rows are picked before the shuffle."""
    w = Window.partitionBy("token").orderBy(F.col("balance").desc(), "address")
    top = holders.select("token", "address", "balance").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(sizes))
    return top.groupBy("token").agg(*[F.sum(F.when(F.col("rn") <= k, F.col("balance"))).alias(f"top{k}") for k in sizes])


def gini(holders: DataFrame) -> DataFrame:
    """Closed form over ascending ranks: equal balances are counted together and ranks
    come from running counts over value bands, so a token with most of the holders is
    not sorted in one task."""
    counts = holders.groupBy("token", "balance").agg(F.count(F.lit(1)).alias("c"))
    ranked = ordered_scan(counts, ["token"], ["balance"], value_slice("balance"), running={"upto": ("sum", F.col("c"))})
    # Ranks of equal balances are upto-c+1 .. upto; only their sum matters.
    rank_sum = F.col("c") * (2 * F.col("upto") - F.col("c") + 1) / 2.0
    return ranked.groupBy("token").agg(
        F.sum("c").alias("n"), F.sum(F.col("balance") * F.col("c")).alias("supply"), F.sum(rank_sum * F.col("balance")).alias("weighted"),
    ).select("token", "n", "supply", F.when(F.col("supply") > 0, 2.0 * F.col("weighted") / (F.col("n") * F.col("supply")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini_coefficient"))


def holder_stats(holders: DataFrame) -> DataFrame:
    pct = lambda k: F.when(F.col("supply") > 0, F.col(k) / F.col("supply") * 100.0).otherwise(0.0)
    return gini(holders).join(_head_sums(holders, (10, 50)), "token").select(
        "token", F.col("n").alias("holder_count"), pct("top10").alias("top_10_pct"), pct("top50").alias("top_50_pct"), "gini_coefficient", "supply")


def holder_features(holders: DataFrame, known: DataFrame) -> DataFrame:
    """Holder statistics plus the share of supply held by known smart wallets."""
    smart = holders.join(known.select(F.col("wallet").alias("address")), "address", "left_semi").groupBy("token").agg(F.sum("balance").alias("smart"))
    share = F.when(F.col("supply") > 0, F.coalesce("smart", F.lit(0.0)) / F.col("supply") * 100.0).otherwise(0.0)
    return holder_stats(holders).join(smart, "token", "left").withColumn("smart_money_pct", share).drop("smart", "supply")


def top_holders(holders: DataFrame, n: int = 10, contracts: DataFrame | None = None) -> DataFrame:
    w = Window.partitionBy("token").orderBy(F.col("balance").desc(), "address")
    supply = holders.groupBy("token").agg(F.sum("balance").alias("supply"))
    out = holders.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(supply, "token")
    out = out.select("token", "rank", "address", "balance", (F.col("balance") / F.col("supply") * 100.0).alias("percentage"))
    if contracts is None:
        return out.withColumn("is_contract", F.lit(False))
    return out.join(contracts.select("address", F.lit(True).alias("is_contract")).distinct(), "address", "left").withColumn("is_contract", F.coalesce("is_contract", F.lit(False)))


def holders_from_transfers(transfers: DataFrame) -> DataFrame:
    """Positive balances as received minus sent amounts."""
    amount = tokens("amount")
    legs = transfers.select("token", F.explode(F.array(
        F.struct(F.col("dst").alias("address"), amount.alias("delta")), F.struct(F.col("src").alias("address"), (-amount).alias("delta")))).alias("l"))
    return legs.groupBy("token", F.col("l.address").alias("address")).agg(F.sum("l.delta").cast("double").alias("balance")).where(F.col("balance") > 0)


def smart_money_flow(transfers: DataFrame, known: DataFrame) -> DataFrame:
    """Smart buys, sells and volume per token: one count per side a smart wallet takes."""
    legs = transfers.select("token", F.explode(F.array(
        F.struct(F.col("src").alias("wallet"), F.lit(0).alias("buy"), "amount"), F.struct(F.col("dst").alias("wallet"), F.lit(1).alias("buy"), "amount"))).alias("l")).select("token", "l.*")
    smart = legs.join(known, "wallet", "left_semi")
    n = F.count(F.lit(1))
    return smart.groupBy("token").agg(
        n.alias("smart_money_activity"), F.sum("buy").alias("smart_buys"), (n - F.sum("buy")).alias("smart_sells"),
        F.sum(tokens("amount")).cast("double").alias("smart_money_volume"), (F.sum("buy") / n).alias("smart_money_buy_ratio"))


def lp_locked(pool_events: DataFrame, as_of: Column) -> DataFrame:
    """Value locked in a token's pools at ``as_of``, locks less unlocks and never below zero, and whether there is any."""
    amount = F.when(F.col("type") == "lock", money("value_usd")).when(F.col("type") == "unlock", -money("value_usd")).otherwise(0)
    held = pool_events.where(F.col("ts") <= as_of).groupBy("token").agg(F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("held"))
    return held.select("token", (F.col("held") > 0).alias("lp_locked"), F.greatest("held", F.lit(0.0)).alias("lp_locked_usd"))


def dev_and_growth(holdings: DataFrame, transfers: DataFrame, developers: DataFrame, as_of: Column, pool_events: DataFrame | None = None) -> DataFrame:
    """Developer share of supply, developer sells and holder growth over the last 24 hours; with ``pool_events`` also ``lp_locked`` (false without a lock)."""
    day = F.expr("INTERVAL 24 HOURS")
    supply = holdings.groupBy("token").agg(F.sum("balance").alias("supply"), F.count(F.lit(1)).alias("holders_now"))
    dev = holdings.join(developers, ["token", "address"], "left_semi").groupBy("token").agg(F.sum("balance").alias("dev_balance"))
    sells = transfers.where((F.col("ts") > as_of - day) & (F.col("ts") <= as_of)).join(
        developers.select("token", F.col("address").alias("src")), ["token", "src"], "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("dev_sells_24h"))
    before = holders_from_transfers(transfers.where(F.col("ts") <= as_of - day)).groupBy("token").agg(F.count(F.lit(1)).alias("holders_before"))
    out = supply.join(dev, "token", "left").join(sells, "token", "left").join(before, "token", "left").fillna({"dev_balance": 0.0, "dev_sells_24h": 0, "holders_before": 0})
    locked = []
    if pool_events is not None:
        out, locked = out.join(lp_locked(pool_events, as_of), "token", "left").fillna({"lp_locked": False}), ["lp_locked"]
    return out.select(
        "token", ratio(F.col("dev_balance") * 100.0, F.col("supply")).alias("dev_holding_percentage"), "dev_sells_24h",
        ratio(F.col("holders_now") - F.col("holders_before"), F.col("holders_before")).alias("holder_growth_24h"), *locked)


# ---------------------------------------------------------------- social
# Sentiment words.
POSITIVE = ("bullish", "moon", "pump", "rocket", "gain", "profit", "up", "buy", "long", "hold", "diamond", "hands")
NEGATIVE = ("bearish", "dump", "rug", "scam", "loss", "sell", "down", "short", "dead", "crash", "paper", "hands")


def _inside(as_of: Column, hours: float) -> Column:
    return (F.col("ts") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col("ts") <= as_of)


def mention_volume(posts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Mentions per source; the row without a source is the total."""
    return posts.where(_inside(as_of, hours)).rollup("source").agg(F.count(F.lit(1)).alias("mentions")).select(
        F.coalesce("source", F.lit("total")).alias("source"), "mentions")


def mention_velocity(posts: DataFrame, as_of: Column, keys=()) -> DataFrame:
    out = posts.groupBy(*keys).agg(*[(F.count_if(_inside(as_of, h)) / h).alias(f"mention_velocity_{h}h") for h in (1, 6, 24)])
    return out.withColumn("mention_acceleration", ratio(F.col("mention_velocity_1h"), F.col("mention_velocity_6h")))


def _sum(c: str) -> Column:
    return F.sum(F.coalesce(c, F.lit(0)))


def engagement(posts: DataFrame, keys=()) -> DataFrame:
    total = _sum("like_count") + _sum("retweet_count") + _sum("reply_count")
    return posts.groupBy(*keys).agg(
        _sum("like_count").alias("total_likes"), _sum("retweet_count").alias("total_retweets"), _sum("reply_count").alias("total_replies"),
        total.alias("total_engagement"), (total / F.count(F.lit(1))).alias("avg_engagement_per_tweet"))


def mention_stats(posts: DataFrame, keys=(), approximate: bool = False) -> DataFrame:
    authors = F.approx_count_distinct("author_id") if approximate else F.count_distinct("author_id")
    return posts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mention_volume"), authors.alias("unique_authors"), _sum("like_count").alias("total_likes"), _sum("retweet_count").alias("total_retweets"),
        ((_sum("like_count") + _sum("retweet_count")) / F.count(F.lit(1))).alias("avg_engagement"))


def kol_mentions(posts: DataFrame, threshold: int = 10000, keys=()) -> DataFrame:
    """Followers are estimated as 100 per retweet."""
    reach = F.coalesce("retweet_count", F.lit(0)) * 100
    big = reach >= threshold
    return posts.groupBy(*keys).agg(F.count_if(big).alias("kol_mentions"), F.sum(F.when(big, reach).otherwise(0)).alias("kol_total_reach")).withColumn(
        "kol_avg_followers", ratio(F.col("kol_total_reach"), F.col("kol_mentions")))


def sentiment_label(text: Column) -> Column:
    """+1, -1 or 0 by which list has more words contained in the text."""
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.signum(hits(POSITIVE) - hits(NEGATIVE)).cast("int")


def sentiment(posts: DataFrame, keys=()) -> DataFrame:
    rows = posts.withColumn("s", sentiment_label(F.coalesce("text", F.lit(""))))
    share = lambda v: F.avg((F.col("s") == v).cast("double"))
    return rows.groupBy(*keys).agg(
        share(1).alias("sentiment_positive_ratio"), share(-1).alias("sentiment_negative_ratio"), share(0).alias("sentiment_neutral_ratio"), F.avg("s").alias("sentiment_score"))


def post_bot_patterns(posts: DataFrame, keys=()) -> DataFrame:
    """Repeated texts and busy authors. Texts are compared by a 256-bit digest so
    that whole texts are covered without shuffling them."""
    ks = list(keys)
    texts = posts.groupBy(*ks, F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("c")).groupBy(*ks).agg(
        F.sum("c").alias("posts"), F.count_if(F.col("c") > 1).alias("repeated"))
    authors = posts.groupBy(*ks, "author_id").agg(F.count(F.lit(1)).alias("c")).groupBy(*ks).agg(F.max("c").alias("busiest"))
    both = texts.join(authors, ks) if ks else texts.crossJoin(F.broadcast(authors))
    dup = F.col("repeated") / F.col("posts")
    score = F.when(dup > 0.5, 0.4).otherwise(0.0) + F.when(F.col("busiest") > 10, 0.3).otherwise(0.0) + F.when(F.col("posts") > 5, 0.3).otherwise(0.0)
    return both.select(*ks, dup.alias("duplicate_ratio"), F.col("busiest").alias("max_posts_per_author"), F.least(F.lit(1.0), score).alias("bot_score"))


def social_bot_score(posts: DataFrame, key: str) -> DataFrame:
    """Share of the applicable checks that fire: posting rate and uniqueness of content."""
    digests = posts.groupBy(key, F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = digests.groupBy(key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("unique"), F.min("a").alias("a"), F.max("b").alias("b"))
    span = seconds_between(F.col("a"), F.col("b"))
    rate_on, text_on = (span > 0).cast("int"), (F.col("n") > 5).cast("int")
    fired = F.when(span > 0, (F.col("n") / (span / 3600.0) > 20).cast("int")).otherwise(0) + F.when(F.col("n") > 5, (F.col("unique") / F.col("n") < 0.3).cast("int")).otherwise(0)
    return rows.select(key, F.when(rate_on + text_on > 0, fired / (rate_on + text_on)).otherwise(0.0).alias("social_bot_score"))


def social_features(posts: DataFrame, as_of: Column, keys=("source",), hours: int = 24) -> DataFrame:
    """All social features in one row per key."""
    ks = list(keys)
    window = posts.where(_inside(as_of, hours))
    out = mention_velocity(posts, as_of, ks)
    volume = posts.groupBy(*ks).agg(F.count_if(_inside(as_of, hours)).alias(f"total_mentions_{hours}h"))
    for part in (volume, engagement(window, ks), kol_mentions(window, keys=ks), sentiment(window, ks), post_bot_patterns(window, ks)):
        out = out.join(part, ks, "left")
    numeric = [c for c, t in out.dtypes if c not in ks and t in ("double", "bigint", "int")]
    return out.fillna(0, subset=numeric)


# ---------------------------------------------------------------- feature store
def time_window_agg(features: DataFrame, as_of: Column, windows=("1h", "6h", "24h", "7d", "30d")) -> DataFrame:
    """Mean, max and min per entity, feature key and trailing window.

    Each row is assigned to the smallest window that holds it, values are folded
    per window ring, and wider windows add up rings, so rows are not multiplied
    by the number of windows before the shuffle.
    """
    spans = sorted((parse_duration(w), w) for w in windows)
    age = seconds_between(F.col("ts"), as_of)
    ring = None
    for i, (s, _) in enumerate(spans):
        ring = F.when(age <= s, i) if ring is None else ring.when(age <= s, i)
    rows = features.withColumn("ring", ring).where(F.col("ring").isNotNull()).select("entity_id", "ring", F.explode("features").alias("key", "value"))
    folded = rows.groupBy("entity_id", "key", "ring").agg(F.sum("value").alias("s"), F.count("value").alias("c"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    names = F.array(*[F.lit(w) for _, w in spans])
    wide = folded.select("entity_id", "key", "s", "c", "hi", "lo", F.explode(F.slice(names, F.col("ring") + 1, len(spans))).alias("time_window"))
    return wide.groupBy("entity_id", "time_window", "key").agg(
        (F.sum("s") / F.sum("c")).alias("mean"), F.max("hi").alias("max"), F.min("lo").alias("min"))


def features_as_of(entities: DataFrame, features: DataFrame) -> DataFrame:
    """Latest snapshot at or before each probe; an entity without one gets an empty map."""
    from chainsieve.operators.timing import read_as_of

    hit = read_as_of(entities, features, ["entity_id"], ["probe_id"], F.col("ts"), F.col("ts"), {"features": F.col("features")}, ahead=False, ties=True)
    return hit.withColumn("features", F.coalesce("features", F.create_map().cast("map<string,double>")))


def feature_history(features: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    out = features
    if start is not None:
        out = out.where(F.col("ts") >= start)
    return out.where(F.col("ts") <= end) if end is not None else out


def feature_store_stats(features: DataFrame) -> DataFrame:
    per = features.groupBy("entity_id").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("total_entities"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_entries"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("avg_entries_per_entity"))


def request_log_stats(log: DataFrame) -> DataFrame:
    """Per endpoint: count, errors, mean duration and the exact 95th percentile."""
    bad = F.col("status_code") >= 400
    counts = log.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(bad).alias("errors"), F.avg(bad.cast("double")).alias("error_rate"), F.avg("duration_ms").alias("avg_duration_ms"))
    return join_same(counts, value_at_share(log, ["endpoint"], "duration_ms", 0.95, "p95_duration_ms"), ["endpoint"], "left")


def request_log_p95(log: DataFrame, window: str = "5 minutes") -> DataFrame:
    """The exact 95th percentile of each endpoint's durations in every window, as the alert rule asks for it."""
    slots = log.withColumn("at", F.window("ts", window)["start"])
    return value_at_share(slots, ["endpoint", "at"], "duration_ms", 0.95, "p95_duration_ms").withColumnRenamed("at", "ts")


def rate_excess(log: DataFrame, key: str, limit: int = 60, window_s: int = 60, slice_seconds: int = 3600) -> DataFrame:
    """Events beyond ``limit`` in the trailing window ending at each event.

    The trailing count is a running count minus the running count at the start
    of the window, both carried along the sliced order.
    """
    from chainsieve.operators.ordered import time_slice
    from chainsieve.operators.timing import read_as_of

    run = ordered_scan(log, [key], ["ts", "event_id"], time_slice("ts", slice_seconds), running={"c": ("count", F.lit(1))})
    marks = run.groupBy(key, "ts").agg(F.max("c").alias("c"))
    back = F.col("ts") - F.expr(f"INTERVAL {window_s} SECONDS")
    old = read_as_of(run, marks, [key], ["event_id"], back, F.col("ts"), {"c0": F.col("c")}, ahead=False, ties=False, slice_seconds=slice_seconds)
    upto = run.join(marks.select(key, "ts", F.col("c").alias("c_at")), [key, "ts"])
    n = F.col("c_at") - F.coalesce("c0", F.lit(0))
    return upto.join(old, [key, "event_id"]).select(key, "event_id", "ts", n.alias("in_window"), (n > limit).alias("exceeded"))


