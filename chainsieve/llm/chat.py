"""Chat formatting after cumulative-snapshot collapse, with DataFrame functions only.

A logger that writes a conversation anew after every turn leaves snapshots that are
prefixes of longer ones. Each turn is hashed with its place; the running combination
of these hashes is the hash of the turn prefix. A conversation goes if its whole
hash is a proper prefix hash of another one (an anti-join); of equal conversations
the smallest conv_id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns that one slice (and one rendered part) holds.
SLICE = 256
#: Place of a turn without number: after all others.
LAST = (1 << 62) - 1


def _turn_rows(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.col("role").cast("string"), F.col("text").cast("string"),
    )


def _hash(salt: str) -> Column:
    """xxhash64 skips nulls, so their flags are hashed as well."""
    return F.xxhash64(F.lit(salt), "turn", "role", F.isnull("role"), "text", F.isnull("text"))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, n, a, b, total``: the number of turns up to this one and their 128-bit hash.

    Running sums go over slices of a conversation first and inside each slice then,
    so a conversation of any length is spread over tasks.
    """
    rows = _turn_rows(conversations).select("conv_id", "turn", _hash("a").alias("a"), _hash("b").alias("b")).distinct()
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    turns = turns.withColumn("slice", F.floor(F.col("turn") / SLICE))
    slices = turns.groupBy("conv_id", "slice").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    zero = F.lit(0).cast("long")
    slices = slices.select(
        F.col("conv_id").alias("of"), F.col("slice").alias("at"), F.sum("n").over(whole).alias("total"),
        *(F.coalesce(f(c).over(earlier), zero).alias(f"{c}0") for c, f in (("n", F.sum), ("a", F.bit_xor), ("b", F.bit_xor))),
    )
    inside = Window.partitionBy("conv_id", "slice").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = turns.select("conv_id", "turn", "slice", F.sum("n").over(inside).alias("n1"), F.bit_xor("a").over(inside).alias("a1"), F.bit_xor("b").over(inside).alias("b1"))
    joined = running.join(slices, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    return joined.select(
        "conv_id", "turn", (F.col("n0") + F.col("n1")).alias("n"), F.col("a0").bitwiseXOR(F.col("a1")).alias("a"),
        F.col("b0").bitwiseXOR(F.col("b1")).alias("b"), "total",
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are not a prefix of, or equal to, one that stays."""
    hashes = prefix_hashes(conversations)
    # xor and count as aggregates: one row per key leaves each map task
    whole = hashes.where(F.col("n") == F.col("total")).groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    longer = hashes.where(F.col("n") < F.col("total")).select("n", "a", "b").distinct()
    return whole.join(longer, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def format_chat(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, part, n_turns, text``.

    A conversation is rendered in parts of 256 turn numbers, part 0 first, so no row
    grows without bound. Turns go by number, null last, equal numbers by role and
    text. Repeated rows of a conversation count once. Null role: ``unknown``; null
    text: empty. Rows with null conv_id form one conversation. Markers inside a text
    are broken up, so a text can't open a turn. Prefixes are judged on turn numbers,
    roles and texts. Other columns are not read; no rows give no rows.
    """
    kept = maximal_conversations(conversations).select(F.col("conv_id").alias("of"), "n_turns")
    rows = _turn_rows(conversations)
    rows = rows.join(kept, rows["conv_id"].eqNullSafe(kept["of"]))
    part = F.floor(F.col("turn") / SLICE)
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|im_", "<| im_")
    who = F.regexp_replace(F.coalesce("role", F.lit("unknown")), r"<\|im_", "<| im_")
    rendered = F.concat(F.lit("<|im_start|>"), who, F.lit("\n"), said, F.lit("<|im_end|>\n"))
    turns = rows.groupBy("conv_id", part.alias("part"), "n_turns").agg(
        F.array_sort(F.collect_set(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.isnull("role").alias("x"), F.isnull("text").alias("y"), rendered.alias("line")))).alias("turns")
    )
    return turns.select("conv_id", "part", "n_turns", F.concat_ws("", F.transform("turns", lambda t: t["line"])).alias("text"))


#: The same rows in DuckDB, on the texts themselves.
CHAT_SQL = r"""
WITH rows AS (SELECT DISTINCT conv_id, coalesce(turn, 4611686018427387903) AS turn, role, text FROM conversations),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, ''), role IS NULL, text IS NULL) AS n,
         count(*) OVER (PARTITION BY conv_id) AS total,
         md5(concat(turn, '|', coalesce(length(role), -1), '|', coalesce(role, ''), '|', coalesce(text, ''), '|', text IS NULL)) AS h
  FROM rows),
prefixes AS (SELECT conv_id, n, total, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY n) AS p FROM lines),
longer AS (SELECT DISTINCT p FROM prefixes WHERE n < total),
kept AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns FROM prefixes WHERE n = total AND p NOT IN (SELECT p FROM longer) GROUP BY p, n)
SELECT l.conv_id, CAST(floor(l.turn / 256) AS BIGINT) AS part, CAST(k.n_turns AS BIGINT) AS n_turns,
       string_agg('<|im_start|>' || replace(coalesce(l.role, 'unknown'), '<|im_', '<| im_') || chr(10)
                  || replace(coalesce(l.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY l.n) AS text
FROM lines l JOIN kept k ON l.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY l.conv_id, floor(l.turn / 256), k.n_turns
"""
