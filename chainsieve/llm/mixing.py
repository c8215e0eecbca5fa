"""Mixing sources to target weights, with DataFrame functions only.

Hash-threshold histograms: words are summed by source and hash bucket, a source's
budget falls into one bucket of its histogram, only that bucket is opened into a
finer histogram, and so on; the nested buckets are one threshold on the hash. The
documents are then filtered by it, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.llm.common import WORD, cut_lineage

#: Hexadecimal digits of the hash, split over the levels of the histogram.
DIGITS, LEVELS = 9, 3
#: A table of sources with up to this many rows is broadcast (some 5 MB).
BROADCAST_SOURCES = 50_000


def _hash() -> Column:
    """36 bits of the md5 of doc_id; a null doc_id hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, DIGITS), 16, 10).cast("long")


def word_count() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``totals(source, source_size)`` with each source's target.

    Weights repeat over the sources in code point order, null last. A target stops
    at ``cap`` times the source's size; what is left is shared by weight among the
    others. With sources in the order of cap over weight, those that stop are a
    prefix, so one pass of running sums finds the level of the rest.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", weight.cast("double")).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
    t = t.withColumn("open", F.col("most") > F.col("weight") * F.col("level"))
    t = t.withColumn("level", F.max(F.when(F.col("open"), F.struct(-(F.col("most") / F.col("weight")), F.col("level")))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("most")).alias("target"))


def source_thresholds(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source of ``sized(source, size, hash)``: its size and target, the copies that each document gets, and the hash below which it gets one more."""
    bits = 4 * DIGITS // LEVELS
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    found = source_targets(totals, weights, share, cap).withColumn("copies", copies)
    found = cut_lineage(found.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("below", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        shift = bits * (LEVELS - level)
        bucket = F.shiftright("hash", shift)
        if level == 1:
            inside = sized.select("source", bucket.alias("bucket"), "size")
        else:  # only the bucket that the budget fell into
            edge = found.select(F.col("source").alias("of"), F.shiftright("below", shift + bits).alias("edge"))
            inside = sized.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift + bits) == F.col("edge"))).select("source", bucket.alias("bucket"), "size")
        histogram = inside.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
        up_to = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        histogram = histogram.withColumn("up_to", up_to).select(F.col("source").alias("of"), "bucket", F.col("size").alias("mass"), "up_to")
        reached = (
            found.select("source", "rest").join(histogram, F.col("source").eqNullSafe(F.col("of")) & (F.col("up_to") > F.col("rest")))
            .groupBy("of").agg(F.min(F.struct("bucket", "up_to", "mass")).alias("edge"))
        )
        joined = found.join(reached, F.col("source").eqNullSafe(F.col("of")), "left")
        rest = F.col("rest") - F.coalesce(F.col("edge.up_to") - F.col("edge.mass"), F.lit(0))
        below = F.shiftleft(F.coalesce(F.col("edge.bucket"), F.lit(0)), shift)
        if level == LEVELS:  # one hash value is left: take it if that comes nearer
            below = below + F.when(2 * rest >= F.col("edge.mass"), 1).otherwise(0)
        found = cut_lineage(joined.select("source", "source_size", "target", "copies", rest.alias("rest"), below.cast("long").alias("below")))
    return found.select("source", "source_size", "target", "copies", "below")


def _with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows (with a column ``source``) with their source's threshold in ``__t``; the table of sources is broadcast only when its counted size is small."""
    packed = thresholds.select(F.struct("source", "source_size", "target", "copies", "below").alias("__t"))
    if packed.count() <= BROADCAST_SOURCES:
        packed = F.broadcast(packed)
    return rows.join(packed, rows["source"].eqNullSafe(F.col("__t.source")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Size, target and taken words of every document.

    Null text: size 0, and nothing is taken. Null source: a source of its own, after
    the others. Null doc_id: hashed as the empty string. Rows with equal doc_id have
    one hash and share their fate. A source without words has target 0. No documents:
    no rows. Columns other than doc_id, text and source are not read.
    """
    sized = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"), _hash().alias("hash")))
    t = _with_thresholds(sized, source_thresholds(sized, weights, share, cap))
    taken = F.col("size") * (F.col("__t.copies") + F.when(F.col("hash") < F.col("__t.below"), 1).otherwise(0))
    return t.select("doc_id", "size", F.col("__t.source_size").alias("source_size"), F.col("__t.target").alias("target"), taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    sized = cut_lineage(docs.select(F.col("source").cast("string"), word_count().alias("size"), _hash().alias("hash")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), _hash().alias("hash"))
    t = _with_thresholds(rows, source_thresholds(sized, weights, share, cap))
    times = F.col("__t.copies") + F.when(F.col("hash") < F.col("__t.below"), 1).otherwise(0)
    return t.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("time")).select("row.*")


#: The same rows in DuckDB, at full hash resolution at once.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * (SELECT sum(source_size) FROM totals) AS budget
  FROM totals),
levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / w, source COLLATE "C" ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w, source COLLATE "C" ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN most > w * level THEN w * (SELECT arg_min(level, most / w) FROM levels WHERE most > w * level) ELSE most END AS target
  FROM levels),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies,
         target - (CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) * source_size AS rest
  FROM targets),
histogram AS (
  SELECT source, h, mass, sum(mass) OVER (PARTITION BY source ORDER BY h) AS up_to
  FROM (SELECT source, h, sum(size) AS mass FROM sized GROUP BY source, h)),
edges AS (
  SELECT r.source, min(g.h) AS h, arg_min(g.mass, g.h) AS mass, arg_min(g.up_to, g.h) AS up_to
  FROM rests r JOIN histogram g ON r.source IS NOT DISTINCT FROM g.source AND g.up_to > r.rest GROUP BY r.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (r.copies + CASE WHEN e.h IS NOT NULL AND (d.h < e.h OR (d.h = e.h AND 2 * (r.rest - (e.up_to - e.mass)) >= e.mass)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
"""
