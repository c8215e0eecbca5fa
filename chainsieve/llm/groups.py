"""Documents in groups, and questions from groups to hash buckets and back.

An operator that compares all documents with each other meets them three times.
``grouped`` deals the texts to groups of a few megabytes by one shuffle, which all
later steps of the plan reuse. A group asks hash buckets about its distinct values,
packed into one row per bucket; a bucket answers with one bit per value, in the
order asked. A value that fills a third of all rows is asked about once per group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.common import texts

#: Bytes of text in a group, about.
GROUP_BYTES = 4 << 20
#: Stands for a null doc_id, which comes after all others.
NO_ID = np.int64((1 << 63) - 1)
ASKED = "bucket long, g int, payload binary"
TOLD = "g int, bucket long, payload binary"


@dataclass
class Groups:
    docs: DataFrame  # g, doc_id, text, and row if carried
    bytes: int
    count: int

    def buckets(self, values_per_byte: float, per_bucket: int = 1 << 20, packed: int = 64) -> int:
        """A power of two: buckets of about ``per_bucket`` values, yet rows of ``packed`` values and more; 0 lets the buckets grow with the input."""
        most = max(1.0, GROUP_BYTES * values_per_byte / packed) if packed else math.inf
        wanted = max(float(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.bytes * values_per_byte / per_bucket)
        return 1 << max(0, math.ceil(math.log2(min(wanted, most))))


def grouped(docs: DataFrame, group_bytes: int = GROUP_BYTES, carry: bool = False) -> Groups:
    """Deals ``doc_id, text`` out by a hash of the row; rows with null text stay as empty texts.

    With ``carry`` all columns of a document come along in the struct ``row.of``, the
    text only where it is null, as ``row.blank`` says.
    """
    own = [F.when(F.col("text").isNull(), F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    rows = texts(docs, *([F.struct(F.struct(*own).alias("of"), F.isnull("text").alias("blank")).alias("row")] if carry else [])).withColumn("text", F.coalesce("text", F.lit("")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    floor = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(floor, math.ceil(total / group_bytes))
    g = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g")
    return Groups(rows.select(g, *rows.columns).repartition(n, "g"), int(total), n)


def in_order(table: pa.Table) -> pa.Table:
    """A group's documents by doc_id, null last, then text: the same at every visit."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)


def bytes_of(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint8)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as gaps of the least whole number of bytes."""
    if not len(values):
        return b"\0"
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(raw: np.ndarray) -> np.ndarray:
    width = int(raw[0])
    if not width:
        return np.zeros(0, np.uint64)
    wide = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    wide[:, :width] = raw[1:].reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


@dataclass
class Asked:
    """How hashes are cut: the top bits name a bucket, the next ``bits`` are asked about."""

    buckets: int
    bits: int

    @property
    def top(self) -> int:
        return self.buckets.bit_length() - 1

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.top - self.bits)

    def split(self, cuts: np.ndarray) -> np.ndarray:
        """Where each bucket begins in ascending cut hashes; one entry more than buckets."""
        return np.searchsorted(cuts, np.arange(self.buckets + 1, dtype=np.uint64) << np.uint64(self.bits))

    @staticmethod
    def of(groups: Groups, values_per_byte: float, spare_bits: int, per_bucket: int = 1 << 20, packed: int = 64) -> Asked:
        """Enough bits that a value meets a foreign one by chance once in 2^spare_bits."""
        buckets = groups.buckets(values_per_byte, per_bucket, packed)
        total = math.ceil(math.log2(max(2.0, groups.bytes * values_per_byte))) + spare_bits
        top = buckets.bit_length() - 1
        return Asked(buckets, min(62 - top, max(8, total - top)))


def distinct_with_flags(cuts: np.ndarray, owner: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct cut hashes, with bit 0 if any is indexed and bit 1 if two owners have it."""
    order = np.argsort(cuts, kind="stable")
    c, o = cuts[order], owner[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return c, np.zeros(0, np.uint64)
    mixed = np.maximum.reduceat(o, at) != np.minimum.reduceat(o, at)
    return c[at], np.maximum.reduceat(indexed[order].astype(np.uint64), at) + (mixed.astype(np.uint64) << np.uint64(1))


def questions(asked: Asked, g: int, cuts: np.ndarray, flags: np.ndarray, flag_bits: int = 2) -> pa.Table:
    edges = asked.split(cuts)
    low = (cuts & np.uint64((1 << asked.bits) - 1)) << np.uint64(flag_bits) | flags
    full = np.flatnonzero(edges[1:] > edges[:-1])
    return pa.table(
        {
            "bucket": pa.array(full, pa.int64()),
            "g": pa.array(np.full(len(full), g, np.int32)),
            "payload": pa.array([pack_sorted(low[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
        }
    )


def shared_values(table: pa.Table, *, hot: int | None = None) -> pa.Table:
    """One bit per value asked: it is indexed somewhere, and two owners or two groups have it.

    With ``hot``, whole bytes of bits follow that say whether more than so many groups have it.
    """
    payloads = [unpack_sorted(bytes_of(x)) for x in table.column("payload")]
    lengths = np.array([len(x) for x in payloads])
    merged = np.concatenate(payloads) if payloads else np.zeros(0, np.uint64)
    value, flags = merged >> np.uint64(2), merged & np.uint64(3)
    order = np.argsort(value, kind="stable")
    v = value[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    many = np.zeros(len(v), bool)
    if len(at):
        f = np.bitwise_or.reduceat(flags[order], at)
        shared = ((f & np.uint64(1)) > 0) & ((np.diff(at, append=len(v)) > 1) | ((f & np.uint64(2)) > 0))
        answer = np.zeros(len(v), bool)
        n = np.diff(at, append=len(v))
        answer[order] = np.repeat(shared, n)
        if hot is not None:
            many[order] = np.repeat(n > hot, n)
    else:
        answer = np.zeros(0, bool)
    cuts = np.cumsum(lengths)[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(answer, cuts)] if payloads else []
    if hot is not None and payloads:
        bits = [a + np.packbits(x).tobytes() for a, x in zip(bits, np.split(many, cuts))]
    return pa.table({"g": table.column("g").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array(bits, pa.binary())})


def answers(table: pa.Table, asked: Asked, cuts: np.ndarray, hot: bool = False) -> np.ndarray:
    """The bits for ascending distinct cut hashes, as this group asked about them; with ``hot``, the second ones."""
    edges = asked.split(cuts)
    out = np.zeros(len(cuts), bool)
    for b, payload in zip(table.column("bucket").to_pylist(), table.column("payload")):
        n = int(edges[b + 1] - edges[b])
        out[edges[b] : edges[b + 1]] = np.unpackbits(bytes_of(payload)[(n + 7) // 8 if hot else 0 :], count=n).astype(bool)
    return out


def each_group(docs: DataFrame, work: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return work(key[0].as_py(), in_order(table))

    return docs.groupBy("g").applyInArrow(run, schema)


def with_answers(docs: DataFrame, told: DataFrame, work: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each group's documents with what the buckets told it."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return work(key[0].as_py(), in_order(left), right)

    return docs.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(run, schema)


def digests(kept: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
    import hashlib

    view = memoryview(np.ascontiguousarray(kept))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield hashlib.sha256(view[a:b]).hexdigest()
