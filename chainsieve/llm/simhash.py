"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of eight bytes that differ in at most four bits differ in at most four
bytes, so they share at least four bytes at their positions. Posting lists hold the
fingerprints that agree at a few positions; those positions are chosen such that any
four of eight contain one choice, so every pair with four shared bytes meets in a list.
There the shared positional bytes of a pair are tallied; pairs that reach the guaranteed
four are verified by their differing bits, each in one list only.

Links of a list leave it as a spanning forest, not as all pairs. A list that is longer
than a task should hold is compared with its most frequent fingerprint first: what links
with that one is one component already, and only the others go, block by block, against
all of the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.common import cut_lineage, texts
from chainsieve.operators.graph import connected_components

SEED, WORDS, BYTES = 42, 4, 8
#: Bytes of text whose words are split at once, members of a list that one task compares, links kept before they are folded.
STEP, LIST, FOLD = 1 << 20, 8192, 1 << 20
#: Distinct fingerprints up to which three positions make short lists; beyond, four.
THREE = 1 << 27


def _word_runs(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text, about a megabyte at a time."""
    at = 0
    while at < len(raw):
        end = at + STEP
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end].split()
        at = end


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:])], np.uint64)


def fingerprint(text: str | None, k: int = WORDS) -> int:
    """Bits that are set in over half of the shingles' hashes; zero without words."""
    held: list[bytes] = []
    ones, n = np.zeros(64, np.int64), 0

    def count(h: np.ndarray) -> None:
        nonlocal ones, n
        ones, n = ones + np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64), n + len(h)

    for words in _word_runs((text or "").encode().lower()):  # of bytes, only A-Z have a lower case
        held += words
        if len(held) >= k:
            count(_hashes(held, k))
            held = held[len(held) - k + 1 :]
    if not n and held:
        count(_hashes(held, len(held)))
    return int(np.packbits(2 * ones > n).view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def positions(size: int) -> list[tuple[int, ...]]:
    """Choices of positions such that any four of the eight contain one.

    Of three: three parts of the positions; a choice lies in one part, or has two of a
    part and one of the next. Four positions in three parts hold such a choice always.
    """
    if size == 4:
        return list(combinations(range(BYTES), 4))
    part = [p % 3 for p in range(BYTES)]

    def fits(choice: tuple[int, ...]) -> bool:
        of = sorted(part[p] for p in choice)
        return of[0] == of[2] or any(of.count(x) == 2 and of.count((x + 1) % 3) == 1 for x in range(3))

    return [c for c in combinations(range(BYTES), 3) if fits(c)]


def _owners(choices: list[tuple[int, ...]]) -> np.ndarray:
    """For each set of shared positions, as a mask: the first choice in it, whose list reports the pair."""
    return np.array([next((i for i, c in enumerate(choices) if all(m >> p & 1 for p in c)), -1) for m in range(256)])


def _key(choice: int, at: tuple[int, ...]) -> Column:
    key = F.lit(choice).cast("long")
    for p in at:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return key


def _shared(x: np.ndarray) -> np.ndarray:
    """Of the differences of pairs, one bit at the bottom of each byte that is shared."""
    y = x | x >> np.uint64(4)
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return ~y & np.uint64(0x0101010101010101)


def _linked(a: np.ndarray, b: np.ndarray, choice: np.ndarray, owners: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs reach the least tally of shared bytes, differ in few bits, and belong to this list."""
    x = a ^ b
    shared = _shared(x)
    at = np.flatnonzero(np.bitwise_count(shared) >= BYTES - bits)
    at = at[np.bitwise_count(x[at]) <= bits]
    masks = np.packbits(shared[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel() if len(at) else np.zeros(0, np.uint8)
    return at[owners[masks] == choice[at]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that join the same nodes as a and b do."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


class _Links:
    """Links found so far, folded to a forest now and then."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, FOLD

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.size += len(a)
            if self.size > self.limit:
                self.fold()

    def fold(self) -> None:
        if self.held:
            self.held = [forest(*(np.concatenate([h[i] for h in self.held]) for i in (0, 1)))]
            self.size = len(self.held[0][0])
            self.limit = max(FOLD, 2 * self.size)

    def table(self) -> pa.Table:
        self.fold()
        a, b = self.held[0] if self.held else (np.zeros(0, np.uint64),) * 2
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return np.ascontiguousarray(table.column(name).to_numpy()).view(np.uint64)


def _short_lists(table: pa.Table, choices: list[tuple[int, ...]], bits: int) -> pa.Table:
    """Links of the lists of a bucket: each member with the one d places on, for d = 1, 2, ..."""
    owners, links = _owners(choices), _Links()
    key, fp = table.column("key").to_numpy(), _unsigned(table, "fp")
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    choice = key >> (8 * len(choices[0]))
    left, d = np.arange(len(key)), 0
    while True:
        d += 1
        left = left[: np.searchsorted(left, len(key) - d)]
        left = left[key[left + d] == key[left]]
        if not len(left):
            return links.table()
        for own in np.array_split(left, math.ceil(len(left) / FOLD)):
            at = own[_linked(fp[own], fp[own + d], choice[own], owners, bits)]
            links.add(fp[at], fp[at + d])


def _block(table: pa.Table, choices: list[tuple[int, ...]], bits: int) -> pa.Table:
    """Links between two blocks of one list, or within one."""
    owners, links, fp = _owners(choices), _Links(), _unsigned(table, "fp")
    side = table.column("side").to_numpy()
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    a, b = (fp, fp) if same else (fp[side == 0], fp[side == 1])
    choice = np.full(1, table.column("key")[0].as_py() >> (8 * len(choices[0])))
    for at in range(0, len(a), 128):
        x, y = np.repeat(a[at : at + 128], len(b)), np.tile(b, len(a[at : at + 128]))
        pair = _linked(x, y, np.broadcast_to(choice, len(x)), owners, bits)
        links.add(x[pair], y[pair])
    return links.table()


def _long_lists(lists: DataFrame, long: DataFrame, choices: list[tuple[int, ...]], bits: int, limit: int) -> DataFrame:
    """Links of long lists. Members near the list's most frequent fingerprint (the hub) link with it; the others meet all, in blocks."""
    members = cut_lineage(lists.join(long, "key"))
    hubs = members.groupBy("key").agg(F.max_by("fp", F.struct("n", "fp")).alias("hub"))
    members = members.join(hubs, "key").withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= bits)
    to_hub = members.where(F.col("near") & (F.col("fp") != F.col("hub"))).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    sizes = members.groupBy("key").agg(*(F.ceil(F.count_if(c) / F.lit(limit)).cast("int").alias(name) for c, name in ((~F.col("near"), "others"), (F.col("near"), "around"))))
    dealt = members.join(sizes.where("others > 0"), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.when(F.col("near"), F.col("around")).otherwise(F.col("others"))).cast("int"))
    # block j of the hub's side is numbered others + j, so i <= j holds for all pairs of blocks
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    first, zero = F.lit(0), F.lit(0)
    as_left = F.transform(upto(F.col("own"), F.col("others") + F.col("around") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), zero.alias("side")))
    as_right = F.transform(upto(first, F.col("own") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    of_hub = F.transform(upto(first, F.col("others") - 1), lambda i: F.struct(i.alias("i"), (F.col("others") + F.col("own")).alias("j"), F.lit(1).alias("side")))
    blocks = dealt.select("key", "fp", F.explode(F.when(F.col("near"), of_hub).otherwise(F.concat(as_left, as_right))).alias("at")).select("key", "fp", "at.*")
    return to_hub.unionByName(blocks.groupBy("key", "i", "j").applyInArrow(lambda t: _block(t, choices, bits), "a long, b long"))


def links(classes: DataFrame, bits: int = 4, limit: int = LIST, size: int | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` (each held by ``n`` rows) that differ in at most ``bits`` (4 or fewer) bits.

    The links have the components of all such pairs; within a dense list they are a
    spanning forest. ``size`` is the number of positions of a posting list.
    """
    if not 0 <= bits <= 4:
        raise ValueError("any four of eight positions are covered, so at most 4 bits may differ")
    n = classes.count()
    choices = positions(size or (3 if n <= THREE else 4))
    keys = F.array(*(_key(i, c) for i, c in enumerate(choices)))
    lists = classes.select("fp", "n", F.explode(keys).alias("key"))
    long = cut_lineage(lists.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > limit).select("key"))
    buckets = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(choices) / (1 << 19)))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    any_long = not long.isEmpty()
    short = (lists.join(long, "key", "left_anti") if any_long else lists).select("key", "fp", bucket)
    found = short.groupBy("bucket").applyInArrow(lambda t: _short_lists(t, choices, bits), "a long, b long")
    return found.unionByName(_long_lists(lists, long, choices, bits, limit)) if any_long else found


def near_duplicates(docs: DataFrame, k: int = WORDS, bits: int = 4, limit: int = LIST) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable over links of ``bits`` differing bits.

    Words of A-Z are lower-cased; shingles of ``k`` words count as often as they occur; a
    text of fewer words is one shingle; one without words, null included, has the
    fingerprint zero and is linked like any other. Repeated rows are returned each, and
    rows with one doc_id have the component of their own text. A row with a null doc_id is
    linked too, and names a component only where all of its rows have none (then null).
    Other columns are not read. Exact copies of a fingerprint meet once, as a class.
    """
    rows = cut_lineage(fingerprints(docs, k))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    parts = connected_components(links(classes, bits, limit))
    linked = classes.join(parts.withColumnRenamed("vertex", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(linked.join(lowest, "component").select("fp", "component_id", F.lit(True).alias("linked")), "fp", "left")
    named = named.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
