"""Ordered scans per key that do not put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task. Here each key is cut into *slices* that follow the order (an hour of time,
a band of values), the window runs inside (key, slice), and what has to cross a
slice border travels through a summary with one row per (key, slice). The hot
rows are therefore spread over as many tasks as there are slices, while the
summary that is scanned per key is bounded by the number of slices.

The slice expression only has to be non-decreasing in the order; it changes how
the work is spread and never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.session import cut_lineage

SLICE = "__slice"
#: Keys and slice in one struct: it equals itself also where a key or the slice is null, so no row is lost in a join.
CELL = "__cell"

_FOLD = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _name(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_slice(ts: Column | str, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(_name(ts)) / F.lit(float(seconds * 1_000_000)))


def value_slice(value: Column | str, per_octave: int = 64) -> Column:
    """Bands of equal width on a signed logarithmic scale: monotone, and fit for
    long-tailed amounts without a pass over the data.

    A derived value may differ in its last bits between two computations of the
    same plan. Going through nine decimals keeps such a value in one band.
    """
    v = F.rint(_name(value).cast("double") * 1.0e9) / 1.0e9
    return F.floor(F.signum(v) * F.log2(1.0 + F.abs(v) * 1.0e6) * per_octave)


#: Bits of an order value that each finer cut leaves out: about 4 seconds, 4 milliseconds and one
#: microsecond of time, then the tie column among rows of one microsecond.
TIME_CUTS, TIE_CUTS = (22, 12, 0), (42, 28, 14, 0)


def even_slices(df: DataFrame, keys: Sequence[str], order: tuple[str, str], *, seconds: int = 3600, most: int = 1_000_000, name: str = "even_slice") -> DataFrame:
    """``df`` with a slice column for ``ordered_scan`` that is cut by rows where time alone is too coarse.

    ``order`` is a timestamp and an integer that orders rows of one timestamp. Slices
    are ``seconds`` long. One that holds more than ``most`` rows is cut again by exact
    counts: rows are counted in finer and finer cells, cells in order are put together
    until they hold ``most`` rows, and only cells that are still too full are opened
    further. So no slice has more than twice ``most`` rows, unless rows have equal order
    values. A null timestamp or integer is a cell of its own, before all others.

    Counts of too full cells are written out while the plan is built, one small job per
    cut that is needed; with no such cell that is the first count alone.
    """
    at, tie = F.unix_micros(_name(order[0])), F.col(order[1]).cast("bigint")
    cuts = [F.shiftright(at, bits) for bits in TIME_CUTS] + [F.struct(at, F.shiftright(tie, bits)) for bits in TIE_CUTS]
    path, fine, rows = "__path", "__fine", df.withColumn("__path", F.struct(*keys, time_slice(order[0], seconds).alias("s")))
    full = cut_lineage(rows.groupBy(path).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(path))
    levels = ["s"]
    for depth, cut in enumerate(cuts):
        if full.isEmpty():
            break
        counts = rows.join(full, path).groupBy(path, cut.alias(fine)).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(path).orderBy(fine).rowsBetween(Window.unboundedPreceding, 0))
        cells = cut_lineage(counts.select(F.struct(path, fine).alias(CELL), F.floor((upto - F.col("n")) / most).alias("__at"), "n"))
        level = f"s{depth}"
        deeper = lambda p, place: F.struct(*[F.col(p)[c].alias(c) for c in [*keys, *levels]], place.alias(level))  # noqa: E731, B023
        rows = rows.withColumn(CELL, F.struct(F.col(path), cut.alias(fine))).join(cells.select(CELL, "__at"), CELL, "left")
        rows = rows.withColumn(path, deeper(path, F.coalesce("__at", F.lit(-1)))).drop(CELL, "__at")
        held = cells.withColumn(path, deeper(f"{CELL}.{path}", F.col("__at"))).groupBy(path).agg(F.sum("n").alias("n"))
        full = cut_lineage(held.where(F.col("n") > 2 * most).select(path))
        levels.append(level)
    return rows.withColumn(name, F.struct(*[F.col(path)[c].alias(c) for c in levels])).drop(path)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on keys that may be null: a null equals a null."""
    named = right.withColumn(CELL, F.struct(*keys)).drop(*keys)
    return left.withColumn(CELL, F.struct(*keys)).join(named, CELL, how).drop(CELL)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Column,
    *,
    running: Mapping[str, tuple[str, Column]] | None = None,
    total: Mapping[str, tuple[str, Column]] | None = None,
    last: Mapping[str, Column] | None = None,
    next_: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys`` in a single pass.

    running  inclusive running sum / count / min / max
    total    the same folds over the whole key
    last     latest non-null value at or before the row
    next_    earliest non-null value at or after the row
    before   value of the previous row (lag 1)
    after    value of the following row (lead 1)
    """
    running, total = dict(running or {}), dict(total or {})
    last, next_ = dict(last or {}), dict(next_ or {})
    before, after = dict(before or {}), dict(after or {})
    part = [CELL]
    work = df.withColumn(CELL, F.struct(*keys, slices.alias(SLICE)))
    key_of, slice_of = [F.col(f"{CELL}.{k}") for k in keys], F.col(f"{CELL}.{SLICE}")
    at = F.struct(*order)

    up = Window.partitionBy(*part).orderBy(*[F.col(c).asc() for c in order])
    down = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    upto = (Window.unboundedPreceding, Window.currentRow)

    folds: list[Column] = [F.lit(1).alias("__one")]
    inner: list[Column] = []
    for n, (kind, c) in running.items():
        inner.append(_FOLD[kind](c).over(up.rowsBetween(*upto)).alias(f"__r_{n}"))
        folds.append(_FOLD[kind](c).alias(f"__cr_{n}"))
    for n, (kind, c) in total.items():
        folds.append(_FOLD[kind](c).alias(f"__ct_{n}"))
    for n, c in last.items():
        inner.append(F.last(c, ignorenulls=True).over(up.rowsBetween(*upto)).alias(f"__l_{n}"))
        folds.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__cl_{n}"))
    for n, c in next_.items():
        inner.append(F.last(c, ignorenulls=True).over(down.rowsBetween(*upto)).alias(f"__n_{n}"))
        folds.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(f"__cn_{n}"))
    if before:
        inner.append(F.row_number().over(up).alias("__up"))
        for n, c in before.items():
            inner.append(F.lag(c).over(up).alias(f"__b_{n}"))
        folds.append(F.max_by(F.struct(*[c.alias(n) for n, c in before.items()]), at).alias("__tail"))
    if after:
        inner.append(F.row_number().over(down).alias("__down"))
        for n, c in after.items():
            inner.append(F.lag(c).over(down).alias(f"__a_{n}"))
        folds.append(F.min_by(F.struct(*[c.alias(n) for n, c in after.items()]), at).alias("__head"))

    whole = Window.partitionBy(*key_of)
    fwd = whole.orderBy(slice_of.asc()).rowsBetween(Window.unboundedPreceding, -1)
    bwd = whole.orderBy(slice_of.desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = []
    for n, (kind, _) in running.items():
        carried.append(_MERGE[kind](f"__cr_{n}").over(fwd).alias(f"__pr_{n}"))
    for n, (kind, _) in total.items():
        carried.append(_MERGE[kind](f"__ct_{n}").over(whole).alias(f"__pt_{n}"))
    for n in last:
        carried.append(F.last(f"__cl_{n}", ignorenulls=True).over(fwd).alias(f"__pl_{n}"))
    for n in next_:
        carried.append(F.last(f"__cn_{n}", ignorenulls=True).over(bwd).alias(f"__pn_{n}"))
    if before:
        carried.append(F.lag("__tail").over(whole.orderBy(slice_of.asc())).alias("__ptail"))
    if after:
        carried.append(F.lag("__head").over(whole.orderBy(slice_of.desc())).alias("__phead"))

    border = work.groupBy(*part).agg(*folds).select(*part, *carried)
    joined = work.select("*", *inner).join(border, part)

    out: list[Column] = [F.col(c) for c in df.columns]
    for n, (kind, _) in running.items():
        here, prior = F.col(f"__r_{n}"), F.col(f"__pr_{n}")
        if kind in ("sum", "count"):
            value = F.coalesce(here + prior, here, prior)
        elif kind == "min":
            value = F.least(here, prior)
        else:
            value = F.greatest(here, prior)
        out.append(value.alias(n))
    out += [F.col(f"__pt_{n}").alias(n) for n in total]
    out += [F.coalesce(f"__l_{n}", f"__pl_{n}").alias(n) for n in last]
    out += [F.coalesce(f"__n_{n}", f"__pn_{n}").alias(n) for n in next_]
    out += [F.when(F.col("__up") > 1, F.col(f"__b_{n}")).otherwise(F.col("__ptail")[n]).alias(n) for n in before]
    out += [F.when(F.col("__down") > 1, F.col(f"__a_{n}")).otherwise(F.col("__phead")[n]).alias(n) for n in after]
    return joined.select(*out)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Column,
    value: Column,
    reach: int,
    name: str,
    *,
    ahead: bool,
) -> DataFrame:
    """Array of the next (or previous) ``reach`` values, nearest first, current row excluded."""
    part = [CELL]
    work = df.withColumn(CELL, F.struct(*keys, slices.alias(SLICE))).withColumn("__v", F.struct(value.alias("v")))
    slice_of = F.col(f"{CELL}.{SLICE}")
    asc = [F.col(c).asc() for c in order]
    desc = [F.col(c).desc() for c in order]
    walk = Window.partitionBy(*part).orderBy(*(desc if ahead else asc))
    border_first = Window.partitionBy(*part).orderBy(*(asc if ahead else desc))
    edges = (
        work.select(*part, "__v", F.row_number().over(border_first).alias("__rn"))
        .where(F.col("__rn") <= reach)
        .groupBy(*part)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__v"))), lambda x: x["__v"]).alias("__edge"))
    )
    beyond = Window.partitionBy(*[F.col(f"{CELL}.{k}") for k in keys]).orderBy(slice_of.asc() if ahead else slice_of.desc()).rowsBetween(1, reach)
    border = edges.select(*part, F.flatten(F.collect_list("__edge").over(beyond)).alias("__beyond"))
    near = F.reverse(F.collect_list("__v").over(walk.rowsBetween(-reach, -1)))
    merged = F.slice(F.concat("__near", F.coalesce("__beyond", F.array())), 1, reach)
    return (
        work.withColumn("__near", near)
        .join(border, part)
        .select(*df.columns, F.transform(merged, lambda x: x["v"]).alias(name))
    )


def middle_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lower and upper middle value per key, exactly.

    ``median`` keeps all distinct values of a group in one buffer. Here equal
    values are counted first, value bands are counted per key, and only the one
    or two bands that hold the middle are looked at in detail.
    """
    part = [CELL]
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(CELL, F.struct(*keys, value_slice("__v").alias(SLICE)))
    )
    bands = counted.groupBy(*part).agg(F.sum("__n").alias("__c"))
    whole = Window.partitionBy(*[F.col(f"{CELL}.{k}") for k in keys])
    bands = bands.select(
        *part,
        F.sum("__c").over(whole.orderBy(F.col(f"{CELL}.{SLICE}")).rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
        F.sum("__c").over(whole).alias("__total"),
        "__c",
    ).select(
        *part,
        (F.col("__upto") - F.col("__c")).alias("__below"),
        "__upto",
        F.floor((F.col("__total") + 1) / 2).alias("__lo"),
        (F.floor(F.col("__total") / 2) + 1).alias("__hi"),
    )
    bands = bands.where((F.col("__below") < F.col("__hi")) & (F.col("__upto") >= F.col("__lo"))).drop("__upto")
    inside = Window.partitionBy(*part).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.join(bands, part).withColumn("__cum", F.col("__below") + F.sum("__n").over(inside))
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col("__cum") >= F.col("__lo"), F.col("__v"))).alias("lower_mid"),
        F.min(F.when(F.col("__cum") >= F.col("__hi"), F.col("__v"))).alias("upper_mid"),
    )


def value_at_share(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The smallest value per key that at least ``share`` of the key's values do not exceed, exactly.

    Equal values are counted first, value bands are counted per key, and only the band
    that holds the wanted rank is opened. Nulls don't count.
    """
    part = [CELL]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn(CELL, F.struct(*keys, value_slice("__v").alias(SLICE)))
    whole = Window.partitionBy(*[F.col(f"{CELL}.{k}") for k in keys])
    upto = F.sum("__c").over(whole.orderBy(F.col(f"{CELL}.{SLICE}")).rowsBetween(Window.unboundedPreceding, 0))
    bands = counted.groupBy(*part).agg(F.sum("__n").alias("__c")).select(*part, "__c", upto.alias("__upto"), F.greatest(F.lit(1), F.ceil(F.sum("__c").over(whole) * share)).alias("__rank"))
    bands = bands.where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__c") < F.col("__rank"))).select(*part, (F.col("__upto") - F.col("__c")).alias("__below"), "__rank")
    inside = Window.partitionBy(*part).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.join(bands, part).withColumn("__cum", F.col("__below") + F.sum("__n").over(inside))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("__cum") >= F.col("__rank"), F.col("__v"))).alias(name))


def with_median(grouped: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    mid = middle_values(rows, keys, value).select(
        *keys, ((F.col("lower_mid") + F.col("upper_mid")) / 2.0).alias(name)
    )
    if not keys:
        return grouped.crossJoin(F.broadcast(mid))
    return join_same(grouped, mid, keys, "left")


def rank_desc(
    df: DataFrame, keys: Sequence[str], metric: str, tie: str, name: str, total: str | None = None, tie_span: int = 4096
) -> DataFrame:
    """Sequential rank by ``metric`` descending, ties by ``tie`` ascending.

    Counts per distinct metric value give each value its starting rank, so a
    ranking over all wallets never sorts them in one task; rows that share a
    value are numbered in slices of the tie column.

    Values are joined with their own counts, so a floating-point metric is
    written out once first: a sum computed twice may differ in its last bits,
    and such a row would find no count.
    """
    m = "__metric"
    value = F.col(metric).cast("double")
    # a missing metric ranks last, after negative infinity shares its place
    base = df.withColumn(m, F.when(value.isNull() | F.isnan(value), float("inf")).otherwise(-value))
    if dict(df.dtypes)[metric] in ("double", "float"):
        base = cut_lineage(base)
    values = base.groupBy(*keys, m).agg(F.count(F.lit(1)).alias("__n"))
    starts = ordered_scan(
        values, keys, [m], value_slice(m),
        running={"__cum": ("sum", F.col("__n"))},
        total={"__total": ("sum", F.col("__n"))},
    ).select(*keys, m, (F.col("__cum") - F.col("__n")).alias("__start"), "__total")
    kind = dict(df.dtypes)[tie]
    tie_slices = F.substring(F.col(tie), 1, 5) if kind == "string" else F.floor(F.col(tie) / tie_span)
    placed = ordered_scan(base, [*keys, m], [tie], tie_slices, running={"__pos": ("count", F.lit(1))})
    out = join_same(placed, starts, [*keys, m])
    cols = [*df.columns, (F.col("__start") + F.col("__pos")).cast("bigint").alias(name)]
    if total:
        cols.append(F.col("__total").cast("bigint").alias(total))
    return out.select(*cols)
