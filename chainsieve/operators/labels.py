"""Price-outcome labels: which multiples a token reached within which horizon.

Looking ahead from every point over 30 days as a range self-join would form a
quadratic number of pairs. Here a token's points are cut into slices of some hours, by
how many points the busiest hour has; the cut changes how work is spread, not the result.
A slice's own points answer what they can: doubling tables of extremes give the first
point behind each start that reaches its price, for all starts of the slice at once.
What stays open is asked of the extremes of the slices ahead (one row per slice, as
many as the longest horizon has), which name the one slice that holds the crossing; only
that one is opened, once for each slice that asks. So a task holds the points of one
slice and the starts of one slice, and no row carries more than a point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.functions.normalize import parse_duration
from chainsieve.operators.timing import read_as_of
from chainsieve.session import cut_lineage

HOUR = 3_600_000_000
#: Points that a slice has at most, about, and hours that it spans at most.
SLICE_POINTS, LONGEST_SLICE = 50_000, 720
MULTIPLIERS = ("2x", "5x", "10x", "20x", "50x")
HORIZONS = ("24h", "7d", "30d")
CROSSED = "us long, price double, name string, u double, d double, hit_us long, hit_price double, broken_us long, hit_slice long"


class Doubling:
    """Greatest value of every run of 1, 2, 4, ... neighbours."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def first(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place at or behind ``start`` whose value is ``least`` or more; n if there is none."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(at + (1 << k) <= self.n)
            below = fits[~(self.levels[k][at[fits]] >= least[fits])]
            at[below] += 1 << k
        return at

    def greatest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The greatest value of each range; minus infinity of an empty one."""
        out = np.full(len(start), -np.inf)
        some = np.flatnonzero(end > start)
        k = np.log2(np.maximum(end[some] - start[some], 1)).astype(int)
        for level in np.unique(k):
            i = some[k == level]
            out[i] = np.maximum(self.levels[level][start[i]], self.levels[level][end[i] - (1 << level)])
        return out


def _column(table: pa.Table, name: str) -> np.ndarray:
    """Numbers; a null is not a number."""
    column = table.column(name)
    return column.to_numpy(zero_copy_only=False).astype(float) if column.null_count or pa.types.is_floating(column.type) else column.to_numpy()


class _Slice:
    """Points of a slice in order, and of the time after it that a check of what follows a crossing needs."""

    def __init__(self, table: pa.Table, min_liquidity: float):
        own = table.sort_by([(c, "ascending") for c in ("us", "price", "liq", "vol")])
        self.us = own.column("us").to_numpy()
        self.price, liq = _column(own, "price"), _column(own, "liq")
        self.own = int((~own.column("tail").to_numpy(zero_copy_only=False).astype(bool)).sum())  # a tail lies behind its slice
        self.asks = own.column("asks").to_numpy(zero_copy_only=False).astype(bool)[: self.own]
        liquid = (liq >= min_liquidity) & ~np.isnan(self.price)
        seen = self.price[: self.own]
        self.up = Doubling(np.where(liquid[: self.own], seen, -np.inf))
        self.down = Doubling(np.where(liquid[: self.own], -seen, -np.inf))
        self.fall = Doubling(np.where(liquid, -self.price, np.inf))  # an illiquid point is below every goal

    def crossings(self, start: np.ndarray, price: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first crossing (the number of own points if there is none), its price, and when price or liquidity first break after it."""
        with np.errstate(invalid="ignore"):
            goal, floor = up * price, down * price
        at = np.minimum(self.up.first(start, np.where(np.isnan(goal), np.inf, goal)), self.down.first(start, np.where(np.isnan(floor), np.inf, -floor)))
        hit = np.flatnonzero(at < self.own)
        since = np.searchsorted(self.us, self.us[at[hit]], "left")
        below = np.where(np.isnan(goal[hit]), np.inf, -goal[hit])
        broken = self.fall.first(since, np.nextafter(below, np.inf))
        broken_us = np.full(len(at), np.iinfo(np.int64).max)
        broken_us[hit] = np.append(self.us, np.iinfo(np.int64).max)[broken]
        return at, np.append(self.price[: self.own], np.nan)[at], broken_us


def slice_hours(prices: DataFrame) -> int:
    """Hours of a slice: as many as keep the busiest within SLICE_POINTS points. One aggregation over the prices."""
    hourly = prices.where(F.col("ts").isNotNull()).groupBy("token", F.floor(F.unix_micros("ts") / HOUR)).agg(F.count(F.lit(1)).alias("n"))
    return max(1, min(LONGEST_SLICE, SLICE_POINTS // max(1, hourly.agg(F.max("n")).first()[0] or 1)))


def _slices(prices: DataFrame, start: Column, sustain: int, hours: int) -> tuple[DataFrame, DataFrame]:
    """Points (own ones, and as ``tail`` those that follow within ``sustain``) by slice; ``asks`` marks starts, a condition over p.us, p.price, p.liq and p.vol."""
    p = F.struct(F.unix_micros("ts").alias("us"), F.col("price").cast("double").alias("price"), F.col("liquidity_usd").cast("double").alias("liq"), F.col("volume_24h").cast("double").alias("vol"))
    width = hours * HOUR
    points = prices.select("token", p.alias("p")).where("p.us IS NOT NULL").select("token", "p.*", F.coalesce(start, F.lit(False)).alias("asks"), F.floor(F.col("p.us") / width).alias("slice"))
    back = F.floor((F.col("us") - sustain) / width)  # the first slice whose tail the point belongs to
    both = points.select("token", "us", "price", "liq", "vol", "asks", F.col("slice").alias("of"), F.explode(F.sequence(back, F.col("slice"))).alias("slice"))
    return points, both.select("token", "slice", "us", "price", "liq", "vol", "asks", (F.col("of") > F.col("slice")).alias("tail"))


def _ahead(points: DataFrame, min_liquidity: float, slices: int) -> DataFrame:
    """For every slice the extremes of the ``slices`` after it, a row each."""
    fine = (F.col("liq") >= min_liquidity) & ~F.isnan("price")
    each = points.groupBy("token", "slice").agg(F.max(F.when(fine, F.col("price"))).alias("hi"), F.min(F.when(fine, F.col("price"))).alias("lo"), F.max("price").alias("top"))
    behind = F.sequence(F.col("slice") - slices, F.col("slice") - 1)
    return each.select("token", F.col("slice").alias("at"), "hi", "lo", "top", F.explode(behind).alias("slice"))


def _summary(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    own = table.sort_by("at")
    return own.column("at").to_numpy(), *(_column(own, c).astype(float) for c in ("hi", "lo", "top"))


def _low(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), -np.inf, x)


def first_crossings(
    prices: DataFrame, targets: dict[str, tuple[float | None, float | None]], *, start: Column, min_liquidity: float, max_days: int,
    strictly_after: bool = False, sustain_hours: float = 0.0, hours: int | None = None,
) -> DataFrame:
    """For every start point and target: the first liquid crossing, and when price or liquidity first break after it.

    A target is (up, down): price at or above ``up`` times the start price, or at
    or below ``down`` times it. ``start`` is a condition over a point's fields
    ``p.us``, ``p.price``, ``p.liq``, ``p.vol``. Crossings are looked for ``max_days`` ahead at
    least. ``broken_us`` is the time of the first point from the crossing on that lies
    under ``up`` times the start price or is illiquid, if it comes within ``sustain_hours``.
    ``hours`` is the length of a slice.
    """
    hours = hours or slice_hours(prices)
    points, both = _slices(prices, start, round(sustain_hours * HOUR), hours)
    ahead = _ahead(points, min_liquidity, max_days * 24 // hours + 1)
    nan = float("nan")
    names, ups, downs = list(targets), np.array([u if u is not None else nan for u, _ in targets.values()], float), np.array([d if d is not None else nan for _, d in targets.values()], float)
    side = "right" if strictly_after else "left"

    def rows(token: pa.Array, slices: pa.Array, us: np.ndarray, price: np.ndarray, which: np.ndarray, s: _Slice, found: tuple, where: np.ndarray) -> pa.Table:
        at, hit_price, broken = found
        none, never, nowhere = at == s.own, np.iinfo(np.int64).max, np.iinfo(np.int64).min
        return pa.table({
            "token": token, "slice": slices, "us": pa.array(us, pa.int64()), "price": pa.array(price, pa.float64()), "name": pa.array(np.array(names, object)[which], pa.string()),
            "u": pa.array(ups[which], pa.float64(), mask=np.isnan(ups[which])), "d": pa.array(downs[which], pa.float64(), mask=np.isnan(downs[which])),
            "hit_us": pa.array(np.append(s.us[: s.own], 0)[at], pa.int64(), mask=none), "hit_price": pa.array(hit_price, pa.float64(), mask=none),
            "broken_us": pa.array(broken, pa.int64(), mask=none | (broken == never)), "hit_slice": pa.array(where, pa.int64(), mask=where == nowhere)})

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        s = _Slice(left, min_liquidity)
        starts = np.flatnonzero(s.asks)
        point, which = np.repeat(starts, len(names)), np.tile(np.arange(len(names)), len(starts))
        us, price = s.us[point], s.price[point]
        found = s.crossings(np.searchsorted(s.us[: s.own], us, side), price, ups[which], downs[which])
        where = np.full(len(us), np.iinfo(np.int64).min)
        slices, hi, lo, _ = _summary(right)
        if len(slices):
            open_ = np.flatnonzero(found[0] == s.own)
            zero = np.zeros(len(open_), np.int64)
            goal, floor = ups[which[open_]] * price[open_], downs[which[open_]] * price[open_]
            first = np.minimum(Doubling(_low(hi)).first(zero, np.where(np.isnan(goal), np.inf, goal)), Doubling(_low(-lo)).first(zero, np.where(np.isnan(floor), np.inf, -floor)))
            some = first < len(slices)
            where[open_[some]] = slices[first[some]]
        token = pa.array([key[0].as_py()] * len(us), key[0].type)
        return rows(token, pa.array(np.full(len(us), key[1].as_py()), pa.int64()), us, price, which, s, found, where)

    def open_slice(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        s = _Slice(left, min_liquidity)
        us, price = right.column("us").to_numpy(), _column(right, "price").astype(float)
        which = np.array([names.index(n) for n in right.column("name").to_pylist()], np.int64)
        found = s.crossings(np.zeros(len(us), np.int64), price, ups[which], downs[which])
        return rows(right.column("t"), right.column("a"), us, price, which, s, found, np.full(len(us), np.iinfo(np.int64).min))

    schema = f"token {points.schema['token'].dataType.simpleString()}, slice long, {CROSSED}"
    # written once: it says which slices have to be opened, and has the rows that are done
    asked = cut_lineage(both.groupBy("token", "slice").cogroup(ahead.groupBy("token", "slice")).applyInArrow(search, schema))
    far = asked.where(F.col("hit_slice").isNotNull()).select("token", F.col("hit_slice").alias("of"), F.col("slice").alias("asking"), "us", "price", "name")
    opened = both.withColumnRenamed("slice", "of").join(far.select("token", "of", "asking").distinct(), ["token", "of"])
    starts = far.select(F.col("token").alias("t"), F.col("of").alias("o"), F.col("asking").alias("a"), "us", "price", "name")
    later = opened.groupBy("token", "of", "asking").cogroup(starts.groupBy("t", "o", "a")).applyInArrow(open_slice, schema)
    return asked.where(F.col("hit_slice").isNull()).unionByName(later).drop("slice", "hit_slice")


def horizon_extremes(prices: DataFrame, horizons=HORIZONS, *, start: Column, hours: int | None = None) -> DataFrame:
    """Highest price and last liquidity within each horizon of every start point. ``hours`` is the length of a slice."""
    hours = hours or slice_hours(prices)
    lengths = np.array([parse_duration(h) * 1_000_000 for h in horizons])
    width = hours * HOUR
    points, _ = _slices(prices, start, 0, hours)
    ahead = _ahead(points, 0.0, int(lengths.max()) // width + 1)

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        us, price, asks = left.column("us").to_numpy(), _column(left, "price"), left.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(us, kind="stable")
        us, price, asks = us[order], _low(price[order].astype(float)), asks[order]
        at = np.unique(us[asks])  # points of one time share their extremes
        begin, which = np.repeat(at, len(lengths)), np.tile(np.arange(len(lengths)), len(at))
        end = begin + lengths[which]
        top = Doubling(price).greatest(np.searchsorted(us, begin, "left"), np.searchsorted(us, end, "right"))
        slices, _, _, tops = _summary(right)
        if len(slices):  # whole slices between that of the start and that of the end
            upto = np.searchsorted(slices, end // width, "left")
            top = np.maximum(top, Doubling(_low(tops)).greatest(np.zeros(len(upto), np.int64), upto))
        return pa.table({
            "token": pa.array([key[0].as_py()] * len(begin), key[0].type), "us": pa.array(begin, pa.int64()),
            "horizon": pa.array(np.array(horizons, object)[which], pa.string()), "end_us": pa.array(end, pa.int64()), "inner": pa.array(top, pa.float64(), mask=np.isneginf(top))})

    token = points.schema["token"].dataType.simpleString()
    cells = ["token", "slice"]
    rows = points.groupBy(*cells).cogroup(ahead.groupBy(*cells)).applyInArrow(search, f"token {token}, us long, horizon string, end_us long, inner double")
    # what lies in the end's own slice before the end: its running maximum, read where the last liquidity is read
    whole = Window.partitionBy("token", "__slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marks = prices.withColumn("__slice", F.floor(F.unix_micros("ts") / width)).withColumn("__top", F.max("price").over(whole))
    read = read_as_of(rows, marks, ["token"], ["us", "horizon", "end_us", "inner"], F.timestamp_micros("end_us"), F.col("ts"),
                      {"final_liquidity": F.col("liquidity_usd"), "last_slice": F.col("__slice"), "last_top": F.col("__top")}, ahead=False, ties=True)
    same = (F.col("last_slice") == F.floor(F.col("end_us") / width)) & (F.floor(F.col("us") / width) < F.col("last_slice"))
    return read.select("token", "us", "horizon", "end_us", F.greatest("inner", F.when(same, F.col("last_top"))).alias("max_price"), "final_liquidity")


def outcome_labels(
    prices: DataFrame, *, multipliers=MULTIPLIERS, horizons=HORIZONS, min_liquidity: float = 50_000.0, min_volume: float = 10_000.0,
    require_sustained: bool = True, sustain_hours: float = 1.0, start_ts: Column | None = None, end_ts: Column | None = None,
) -> DataFrame:
    """One row per eligible point, horizon and multiplier.

    A target counts as reached when the first liquid crossing lies in the horizon
    and price and liquidity hold for ``sustain_hours`` after it (as far as the
    horizon goes). ``censored`` follows the original rule and is never true, as
    the point itself always lies in its horizon; ``censored_strict`` says that
    the series ended before an unreached horizon did.
    """
    ok = (F.col("p.liq") >= min_liquidity) & (F.col("p.vol") >= min_volume)
    if start_ts is not None:
        ok = ok & (F.col("p.us") >= F.unix_micros(start_ts))
    if end_ts is not None:
        ok = ok & (F.col("p.us") <= F.unix_micros(end_ts))
    longest = max(parse_duration(h) for h in horizons) // 86400 + 1
    sustain = int(sustain_hours * HOUR)
    targets, width = {m: (float(m[:-1]), None) for m in multipliers}, slice_hours(prices)
    hits = first_crossings(prices, targets, start=ok, hours=width, min_liquidity=min_liquidity, max_days=longest, sustain_hours=sustain_hours if require_sustained else 0.0)
    ends = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(parse_duration(h) * 1_000_000).cast("bigint").alias("len")) for h in horizons])
    hit = F.col("hit_us")

    def verdict(s: Column) -> Column:
        end = F.col("us") + s["len"]
        inside = F.coalesce(hit <= end, F.lit(False))
        if require_sustained:
            inside = inside & F.coalesce(F.col("broken_us") > F.least(hit + sustain, end), F.lit(True))
        return F.struct(s["horizon"].alias("horizon"), inside.alias("reached"))

    rows = hits.select("token", "us", "name", "hit_us", F.explode(F.transform(ends, verdict)).alias("v")).select(
        "token", "us", F.col("name").alias("multiplier"), "v.horizon", F.coalesce("v.reached", F.lit(False)).alias("reached"), "hit_us")
    seen = prices.groupBy("token").agg(F.max(F.unix_micros("ts")).alias("last_us"))
    out = rows.join(horizon_extremes(prices, horizons, start=ok, hours=width), ["token", "us", "horizon"]).join(seen, "token")
    hours = (F.col("hit_us") - F.col("us")) / float(HOUR)
    return out.select(
        "token", F.timestamp_micros("us").alias("ts"), "horizon", "multiplier", "reached", F.when(F.col("reached"), hours).alias("time_hours"),
        F.lit(False).alias("censored"), (~F.col("reached") & (F.col("last_us") < F.col("end_us"))).alias("censored_strict"), "max_price", "final_liquidity")


def label_quality(labels: DataFrame) -> DataFrame:
    return labels.groupBy("horizon", "multiplier").agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if("reached").alias("num_reached"), F.avg(F.col("reached").cast("double")).alias("hit_rate"),
        F.count_if("censored_strict").alias("num_censored"), F.avg(F.col("censored_strict").cast("double")).alias("censoring_rate"),
        F.avg("time_hours").alias("avg_time_hours"), F.min("time_hours").alias("min_time_hours"), F.max("time_hours").alias("max_time_hours"))


def training_join(labels: DataFrame, features: DataFrame, multipliers=MULTIPLIERS, horizons=HORIZONS) -> DataFrame:
    """One row per labelled point with its features and flags ``h_m``, ``h_m_censored``, ``h_m_time``."""
    cols = []
    for h in horizons:
        for m in multipliers:
            here = (F.col("horizon") == h) & (F.col("multiplier") == m)
            cols += [F.bool_or(here & F.col("reached")).alias(f"{h}_{m}"), F.bool_or(here & F.col("censored")).alias(f"{h}_{m}_censored"), F.max(F.when(here, F.col("time_hours"))).alias(f"{h}_{m}_time")]
    return labels.groupBy("token", "ts").agg(*cols).join(features, "token")


def exit_points(prices: DataFrame, *, up: float = 10.0, down: float = 0.5, hold: str = "7d", start: Column | None = None) -> DataFrame:
    """First later point that takes profit, stops the loss or ends the holding time."""
    start = F.lit(True) if start is None else start
    days = parse_duration(hold) // 86400
    cross = first_crossings(prices, {"exit": (up, down)}, start=start, min_liquidity=float("-inf"), max_days=days, strictly_after=True)
    late = F.timestamp_micros(F.col("us") + parse_duration(hold) * 1_000_000)
    marks = prices
    out = read_as_of(cross.select("token", "us", "price", "hit_us", "hit_price"), marks, ["token"], ["us", "price", "hit_us", "hit_price"], late, F.col("ts"),
                     {"late_ts": F.col("ts"), "late_price": F.col("price")}, ahead=True, ties=False)
    early = F.col("hit_us").isNotNull() & (F.col("hit_us") <= F.coalesce(F.unix_micros("late_ts"), F.col("hit_us")))
    reason = F.when(early & (F.col("hit_price") >= up * F.col("price")), "take_profit").when(early, "stop_loss").when(F.col("late_ts").isNotNull(), "max_hold")
    return out.select("token", F.timestamp_micros("us").alias("entry_ts"), F.col("price").alias("entry_price"),
                      F.when(early, F.timestamp_micros("hit_us")).otherwise(F.col("late_ts")).alias("exit_ts"),
                      F.when(early, F.col("hit_price")).otherwise(F.col("late_price")).alias("exit_price"), reason.alias("reason"))
