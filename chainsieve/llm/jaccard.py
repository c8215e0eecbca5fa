"""N-gram Jaccard join over word shingles.

Rare-first prefix filtering: the shingles of a document go by how many documents
have them, and of two similar documents the first few of each side, the prefixes,
have one in common. Documents meet on prefix shingles; lengths and positions rule
pairs out before, a suffix filter after their sets are fetched, and what is left is
verified once per pair.

Equal sets are one class and join through its smallest doc_id. Links are found in two
rounds, so that a group of near copies costs about one pair per member. First every
document meets a hub, the first document with its prefix shingle among those of about
its size. What two documents differ in from a common hub tells what they differ in
from each other: those that lie in different components can link only if they share
enough of these differences. So the second round is a prefix-filtered join again, on
differences from the hub, which are few and, in their prefixes, rare.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.llm.common import buffers, cut_lineage, gram_hashes, lower_ascii, mix, steps, word_bounds, word_hashes
from chainsieve.llm.groups import ASKED, NO_ID, TOLD, Asked, bytes_of, doc_ids, each_group, grouped, pack_sorted, unpack_sorted, with_answers
from chainsieve.operators.graph import connected_components

#: Shingles per byte of text, about.
DENSITY = 1 / 6
#: Bits of a shingle's hash that its key keeps behind the rarity.
KEY_BITS = 51
RARITIES = 31


class _Sets:
    """Distinct shingle hashes of a group's documents, by document and hash."""

    def __init__(self, table: pa.Table, k: int):
        self.ids = doc_ids(table)
        raw, offsets = buffers(table.column("text"))
        docs, hashes = [], []
        for a, b in steps(offsets):
            part = lower_ascii(raw[offsets[a] : offsets[b]])
            starts, ends, before = word_bounds(part, offsets[a : b + 1] - offsets[a])
            words = word_hashes(part, starts, ends)
            n = np.diff(before)
            doc = np.repeat(np.arange(a, b), n)
            grams = gram_hashes(words, k)
            whole = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
            docs.append(doc[whole])
            hashes.append(grams[whole])
            for size in range(1, k):  # fewer words: the whole sequence
                short = np.flatnonzero(n == size)
                if len(short):
                    h = words[before[short]]
                    for i in range(1, size):
                        h = mix(h ^ mix(words[before[short] + i], i), 40)
                    docs.append(short + a)
                    hashes.append(mix(h, 50 + size))
        doc = np.concatenate(docs or [np.zeros(0, np.int64)])
        h = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.h = doc[new], h[new]
        self.edges = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))
        self.n = np.diff(self.edges)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(self.h, s), dtype=np.uint64)]) for s in (61, 62)]
        with np.errstate(over="ignore"):
            self.d0, self.d1 = (mix((s[self.edges[1:]] - s[self.edges[:-1]]) + self.n.astype(np.uint64), 63) for s in sums)
        # documents are in order of doc_id, so the first of equal sets has the smallest
        full = np.flatnonzero(self.n > 0)
        order = full[np.lexsort((full, self.d1[full], self.d0[full]))]
        lead = np.ones(len(order), bool)
        lead[1:] = (self.d0[order[1:]] != self.d0[order[:-1]]) | (self.d1[order[1:]] != self.d1[order[:-1]])
        self.leader = np.arange(len(self.ids))
        self.leader[order] = order[lead][np.cumsum(lead) - 1] if len(order) else order
        self.leads = (self.leader == np.arange(len(self.ids))) & (self.n > 0)


def _distinct(s: _Sets, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cut hashes of the group's distinct sets, their number of sets up to 3, and each shingle's place among them."""
    use = s.leads[s.doc]
    values, back, count = np.unique(asked.cut(s.h[use]), return_inverse=True, return_counts=True)
    return values, np.minimum(count, 3).astype(np.uint8), back


def _packed_counts(low: np.ndarray, count: np.ndarray) -> bytes:
    two = np.packbits(np.stack([count & 2, count & 1], 1).astype(bool).ravel())
    return np.array([len(low)], np.int64).tobytes() + two.tobytes() + pack_sorted(low)


def _unpacked_counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(raw[:8].view(np.int64)[0])
    at = 8 + (2 * n + 7) // 8
    two = np.unpackbits(raw[8:at], count=2 * n).reshape(-1, 2)
    return unpack_sorted(raw[at:]), (2 * two[:, 0] + two[:, 1]).astype(np.int64)


def _by_digest(s: _Sets, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Leading documents in order of their digest, and bucket edges over them."""
    lead = np.flatnonzero(s.leads)
    lead = lead[np.lexsort((s.d1[lead], s.d0[lead]))]
    top = (s.d0[lead] >> np.uint64(64 - asked.top)).astype(np.int64) if asked.top else np.zeros(len(lead), np.int64)
    return lead, np.searchsorted(top, np.arange(asked.buckets + 1))


def _ask(k: int, asked: Asked):
    """Buckets below ``asked.buckets`` are asked how many documents have a shingle, the ones above which document is the first with a set."""

    def work(g: int, table: pa.Table) -> pa.Table:
        s = _Sets(table, k)
        values, count, _ = _distinct(s, asked)
        edges, low = asked.split(values), values & np.uint64((1 << asked.bits) - 1)
        rows = [(int(b), _packed_counts(low[edges[b] : edges[b + 1]], count[edges[b] : edges[b + 1]])) for b in np.flatnonzero(edges[1:] > edges[:-1])]
        lead, edges = _by_digest(s, asked)
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            i = lead[edges[b] : edges[b + 1]]
            rows.append((int(b) + asked.buckets, s.d0[i].tobytes() + s.d1[i].tobytes() + s.ids[i].tobytes()))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "g": pa.array([g] * len(rows), pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return work


def _rarity(count: np.ndarray) -> np.ndarray:
    """0 for one document, then exact up to 8, then by powers of the root of two."""
    steps_ = np.where(count <= 8, count - 1, 7 + np.ceil(2 * np.log2(np.maximum(count, 1) / 8)))
    return np.minimum(steps_, RARITIES).astype(np.uint8)


def _tell(buckets: int):
    def work(table: pa.Table) -> pa.Table:
        squeeze = pa.Codec("zstd", 1)
        payloads = [bytes_of(x) for x in table.column("payload")]
        if not payloads:
            return table.select(["g", "bucket", "payload"])
        if table.column("bucket")[0].as_py() >= buckets:
            parts = [x.reshape(3, -1).view(np.uint64) for x in payloads]
            d0, d1, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
            ids = ids.view(np.int64)
            order = np.lexsort((ids, d1, d0))
            lead = np.ones(len(order), bool)
            lead[1:] = (d0[order[1:]] != d0[order[:-1]]) | (d1[order[1:]] != d1[order[:-1]])
            first = np.zeros(len(order), np.int64)
            first[order] = ids[order][lead][np.cumsum(lead) - 1]
            told = [x.tobytes() for x in np.split(first, np.cumsum([p.shape[1] for p in parts])[:-1])]
        else:
            parts = [_unpacked_counts(x) for x in payloads]
            value, count = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = np.argsort(value, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = value[order[1:]] != value[order[:-1]]
            at = np.flatnonzero(new)
            rarity = np.zeros(len(order), np.uint8)
            rarity[order] = np.repeat(_rarity(np.add.reduceat(count[order], at)), np.diff(at, append=len(order))) if len(at) else 0
            told = [squeeze.compress(x.tobytes(), asbytes=True) for x in np.split(rarity, np.cumsum([len(p[0]) for p in parts])[:-1])]
        return pa.table({"g": table.column("g").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array(told, pa.binary())})

    return work


def least_common(n: np.ndarray | int, share: tuple[int, int]) -> np.ndarray | int:
    """The fewest common shingles of a set of n with any set that it links to."""
    return -(-n * share[0] // share[1])


def _keys(k: int, asked: Asked, share: tuple[int, int]):
    """doc_id, n, rep, keys: keys (rarity, then hash, ascending) only of the first document of a class that may have a partner."""

    def work(g: int, table: pa.Table, told: pa.Table) -> pa.Table:
        s = _Sets(table, k)
        said = dict(zip(told.column("bucket").to_pylist(), told.column("payload")))
        squeeze = pa.Codec("zstd", 1)
        values, _, back = _distinct(s, asked)
        edges = asked.split(values)
        rarity = np.zeros(len(values), np.uint8)
        lead, by = _by_digest(s, asked)
        rep = s.ids.copy()
        for b, payload in said.items():
            if b < asked.buckets:
                size = int(edges[b + 1] - edges[b])
                rarity[edges[b] : edges[b + 1]] = np.frombuffer(squeeze.decompress(payload.as_py(), size), np.uint8)
            else:
                rep[lead[by[b - asked.buckets] : by[b - asked.buckets + 1]]] = bytes_of(payload).view(np.int64)
        rep = rep[s.leader]
        use = s.leads[s.doc]
        doc, r = s.doc[use], rarity[back]
        key = (r.astype(np.uint64) << np.uint64(KEY_BITS)) | (s.h[use] >> np.uint64(64 - KEY_BITS))
        shared = np.bincount(doc[r > 0], minlength=len(s.ids))
        able = s.leads & (rep == s.ids) & (shared >= least_common(s.n, share))
        at = np.searchsorted(doc, np.arange(len(s.ids) + 1))
        keys = [pack_sorted(np.sort(key[at[i] : at[i + 1]])) if able[i] else None for i in range(len(s.ids))]
        return pa.table({"doc": pa.array(s.ids), "n": pa.array(s.n, pa.int64()), "rep": pa.array(rep), "keys": pa.array(keys, pa.binary())})

    return work


def _prefixes(share: tuple[int, int]):
    """One row per prefix shingle that another document may have: token, doc, size, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1)):
                    keys = unpack_sorted(bytes_of(raw))
                    n = len(keys)
                    prefix = keys[: n - least_common(n, share) + 1]
                    at = np.flatnonzero(prefix >> np.uint64(KEY_BITS))
                    for c, v in zip(cols, (prefix[at].astype(np.int64), np.full(len(at), doc), np.full(len(at), n), at)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols], names=["token", "doc", "n", "at"])

    return run


def overlap_reaches(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Suffix filter: False only if halving around the middle key shows fewer than ``need`` common keys."""

    def most(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or min(len(x), len(y)) < 16:
            return min(len(x), len(y))
        pivot = x[len(x) // 2]
        at = int(np.searchsorted(y, pivot))
        return most(x[: len(x) // 2], y[:at], depth - 1) + most(x[len(x) // 2 :], y[at:], depth - 1)

    return most(x, y, depth) >= need


def _verify(share: tuple[int, int]):
    """Pairs (a, b, deltas) with both key sets: whether they link, both sizes and, where ``deltas``, the keys of one alone."""
    p, q = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            linked, sizes, deltas = np.zeros(n, bool), np.zeros((2, n), np.int64), [None] * n
            last, x = None, np.zeros(0, np.uint64)
            for i, (a, want, r, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4))):
                if a != last:
                    last, x = a, unpack_sorted(bytes_of(r))
                y = unpack_sorted(bytes_of(s))
                sizes[:, i] = len(x), len(y)
                if want or overlap_reaches(x, y, -(-p * (len(x) + len(y)) // (p + q))):
                    both = np.concatenate([x, y])
                    both.sort()
                    same = both[1:] == both[:-1]
                    common = int(same.sum())
                    linked[i] = q * common >= p * (len(x) + len(y) - common)
                    if want:
                        alone = np.ones(len(both), bool)
                        alone[1:] &= ~same
                        alone[:-1] &= ~same
                        deltas[i] = both[alone].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes[0]), pa.array(sizes[1]), pa.array(linked), pa.array(deltas, pa.list_(pa.int64()))],
                names=["a", "b", "na", "nb", "linked", "delta"],
            )

    return run


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    first, second = sets.select(F.col("doc").alias("a"), F.col("keys").alias("x")), sets.select(F.col("doc").alias("b"), F.col("keys").alias("y"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "deltas", "x", "y")
    return joined.mapInArrow(_verify(share), "a long, b long, na long, nb long, linked boolean, delta array<long>")


def _hub_pairs(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) of a document and a hub; ``deltas`` where the hub has other documents too.

    Sizes of two that link lie in the same band or in neighbouring ones, so with the
    hubs of three bands every two documents that share a prefix shingle and may link
    have a hub in common. A pair whose hub has nobody else is subject to the length
    and positional filters at once.
    """
    p, q = share
    often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("token")
    banded = entries.join(often, "token").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(q / p) if p < q else F.col("n").cast("double")))
    hubs = banded.groupBy("token", "band").agg(F.min(F.struct("doc", "n", "at")).alias("h")).select("token", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"), F.col("h.doc").alias("hub"), F.col("h.n").alias("hn"), F.col("h.at").alias("hat"))
    met = banded.join(hubs, ["token", "band"]).where(F.col("doc") != F.col("hub"))
    # a bound on the common shingles: those before the token in both, the token, and those behind it
    most = F.least("at", "hat") + 1 + F.least(F.col("n") - F.col("at"), F.col("hn") - F.col("hat")) - 1
    met = met.groupBy(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).agg(
        F.bool_or(F.col("hub") < F.col("doc")).alias("hub_a"), F.bool_or(F.col("hub") > F.col("doc")).alias("hub_b"), F.min(most).alias("most"), F.min("n").alias("n"), F.min("hn").alias("hn")
    )
    met = cut_lineage(met)
    crowd = met.select(F.explode(F.array_compact(F.array(F.when(F.col("hub_a"), F.col("a")), F.when(F.col("hub_b"), F.col("b"))))).alias("hub")).groupBy("hub").agg((F.count(F.lit(1)) > 1).alias("crowded"))
    met = met.join(crowd.select(F.col("hub").alias("a"), F.col("crowded").alias("ca")), "a", "left").join(crowd.select(F.col("hub").alias("b"), F.col("crowded").alias("cb")), "b", "left")
    met = met.withColumn("deltas_a", F.col("hub_a") & F.col("ca")).withColumn("deltas_b", F.col("hub_b") & F.col("cb")).fillna(False, ["deltas_a", "deltas_b"])
    met = met.withColumn("deltas", F.col("deltas_a") | F.col("deltas_b"))
    possible = (q * F.least("n", "hn") >= p * F.greatest("n", "hn")) & ((p + q) * F.col("most") >= p * (F.col("n") + F.col("hn")))
    return met.where(F.col("deltas") | possible).select("a", "b", "deltas", "deltas_a", "deltas_b")


def _delta_pairs(met: DataFrame, parts: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs in different components that share enough of their differences from a common hub.

    x and y link if they differ in at most c (nx + ny) shingles. With dx and dy
    differences from the hub, o = (dx + dy - c (nx + ny)) / 2 of them have to be
    common. If that is 0 or less, both link to the hub itself and are in one component.
    """
    c = (share[1] - share[0]) / (share[1] + share[0])
    row = lambda flag, hub, doc, n, m: F.when(F.col(flag), F.struct(F.col(hub).alias("hub"), F.col(doc).alias("doc"), F.col(n).alias("n"), F.col(m).alias("hn")))
    sides = F.array_compact(F.array(row("deltas_a", "a", "b", "nb", "na"), row("deltas_b", "b", "a", "na", "nb")))
    rows = met.where(F.col("delta").isNotNull()).select(F.explode(sides).alias("s"), "delta").select("s.*", "delta", F.size("delta").alias("d"))
    rows = rows.join(parts, "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    mixed = rows.groupBy("hub").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where(F.col("lo") < F.col("hi")).select("hub")
    rows = rows.join(mixed, "hub")
    ceil = lambda x: F.ceil(x - 1e-9)
    over = F.col("d") - c * (F.col("n") + F.col("hn"))
    fewest = F.greatest(F.lit(1), F.when(over <= 1e-9, ceil(F.col("d") * (1 - c) / 2)).otherwise(ceil((over + 1 - c) / 2)))
    items = rows.withColumn("fewest", fewest).select("hub", "doc", "n", "d", "part", "fewest", F.explode("delta").alias("item"))
    counted = items.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("times"))
    place = Window.partitionBy("hub", "doc").orderBy("times", "item")
    items = items.join(counted, ["hub", "item"]).withColumn("at", F.row_number().over(place) - 1)
    items = items.where((F.col("times") > 1) & (F.col("at") <= F.col("d") - F.col("fewest"))).drop("times", "fewest")
    other = items.select("hub", "item", *(F.col(x).alias(f"{x}2") for x in ("doc", "n", "d", "part", "at")))
    need = ceil((F.col("d") + F.col("d2") - c * (F.col("n") + F.col("n2"))) / 2)
    behind = F.least("at", "at2") + 1 + F.least(F.col("d") - F.col("at"), F.col("d2") - F.col("at2")) - 1
    fits = (F.col("part") < F.col("part2")) & (F.col("at") <= F.col("d") - need) & (F.col("at2") <= F.col("d2") - need) & (behind >= need) & (share[1] * F.least("n", "n2") >= share[0] * F.greatest("n", "n2"))
    return items.join(other, ["hub", "item"]).where(fits).select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 3, share: tuple[int, int] = (90, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; two link at a Jaccard similarity of share[0] / share[1].

    Words are lower-cased A-Z. With fewer than k words the whole sequence is one
    shingle; without words (or text) a document has none and links with nothing.
    component_id is the smallest doc_id reachable. A null doc_id counts as the
    largest and is given back as null; rows with one doc_id are one node, which has
    the links of each. Other columns are not read.
    """
    groups = grouped(docs)
    asked = Asked.of(groups, DENSITY, 2)
    asking = each_group(groups.docs, _ask(k, asked), ASKED)
    told = asking.groupBy("bucket").applyInArrow(_tell(asked.buckets), TOLD)
    rows = cut_lineage(with_answers(groups.docs, told, _keys(k, asked, share), "doc long, n long, rep long, keys binary"))
    sets = rows.where(F.col("keys").isNotNull()).select("doc", "keys")
    entries = cut_lineage(sets.mapInArrow(_prefixes(share), "token long, doc long, n long, at long"))

    pairs = cut_lineage(_hub_pairs(entries, share))
    met = cut_lineage(_verified(pairs, sets, share))
    links = met.where("linked").select("a", "b")
    parts = connected_components(links).select(F.col("vertex").alias("doc"), F.col("component").alias("part"))
    rest = _delta_pairs(met.join(pairs.select("a", "b", "deltas_a", "deltas_b"), ["a", "b"]), parts, share)
    rest = rest.join(pairs.select("a", "b"), ["a", "b"], "left_anti").withColumn("deltas", F.lit(False))
    more = cut_lineage(_verified(rest, sets, share).where("linked").select("a", "b"))
    at = connected_components(links.unionByName(more)).select(F.col("vertex").alias("rep"), "component")
    found = rows.select("doc", "n", "rep").join(at, "rep", "left")
    real = lambda c: F.when(c != F.lit(int(NO_ID)), c)
    return found.select(real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "rep")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 3, share: tuple[int, int] = (90, 100)) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, and of several rows with it the one of least text.

    Documents without words link with nothing and stay. So do rows without doc_id,
    which can't be told apart.
    """
    stay = jaccard_components(docs, k, share).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    with_id = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    first = Window.partitionBy("id").orderBy("text")
    kept = with_id.join(stay, "id", "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


#: The same rows in DuckDB, by brute force over the pairs that share a shingle.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
"""
