"""Boosted trees over more rows than a task should hold: every row takes part in every histogram.

The rows of a part lie in shards, which stay where they are. A level of a tree is one job:
each shard counts the gradients of its own rows per bin, for the nodes that are asked about
(of two children the smaller one; the other is what is left of their parent), the sums are
added up, and the driver picks the best cuts. All targets, learners and parts grow their
trees in the same jobs, so their number is that of the levels of one model. A shard holds
``rows_per_part`` rows, the driver histograms and trees; neither grows with the rows.

Bins are cut at exact quantiles of all rows, found digit by digit. Which rows a tree sees is
drawn from the row's own hash, so it doesn't depend on how rows are dealt to shards.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.ml.boosting import Bins, Booster, DeepTree, Tree, start

Key = tuple[str, str, int]  # target, learner, part
DIGIT = 4  # bits of a value that a pass over the rows settles
COLLECTED = 64  # sums of so many tasks are added on the driver; those of more meet on executors first
REBASED = 32  # trees after which margins are computed from the rows again, so that the lineage stays short
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def value_of(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >> np.uint64(63) == 1, bits & ~np.uint64(1 << 63), ~bits).view(np.float64)


def drawn(at: np.ndarray, turn: int, spec: Booster) -> np.ndarray:
    """Which rows the tree of a turn sees, of the rows' hashes."""
    if spec.rows >= 1:
        return np.ones(len(at), bool)
    with np.errstate(over="ignore"):
        z = at + _GOLDEN * np.uint64(turn + 1) + np.uint64(spec.seed % (1 << 64)) * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z < np.uint64(int(spec.rows * 2**64))


# ---------------------------------------------------------------- shards of rows
def dealt_shards(labelled: DataFrame, x, at, part, targets: Sequence[str], parts: int, shards: int) -> RDD:
    """Per shard (part, features, labels, where there is a label, hashes); a task holds shards of one part."""
    sc, width, count = labelled.sparkSession.sparkContext, len(targets), parts * shards
    ys = F.array(*[F.col(t).cast("double") for t in targets])
    # the shard is drawn, not hashed: rows that are equal in all columns can be very many
    rows = labelled.select(part.alias("part"), F.floor(F.rand(0) * shards).cast("int").alias("shard"), at.alias("at"), x.alias("x"), ys.alias("ys"))

    def packed(table: pa.Table) -> pa.Table:
        flat = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        labels = table.column("ys").combine_chunks().flatten()
        known = labels.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
        y = labels.to_numpy(zero_copy_only=False).reshape(-1, width)
        hashes = table.column("at").to_numpy()
        order = np.lexsort((*y.T, *flat.T[::-1], hashes))
        flat, y, known, hashes = flat[order], y[order], known[order], hashes[order].view(np.uint64)
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        again = np.arange(len(hashes)) - np.repeat(first, np.diff(np.r_[first, len(hashes)]))
        with np.errstate(over="ignore"):
            hashes = hashes + again.astype(np.uint64) * _GOLDEN  # equal rows are drawn one by one
        mine = (table.column("part")[0].as_py(), flat, y, known, hashes)
        return pa.table({"part": [mine[0]], "shard": [table.column("shard")[0].as_py()], "rows": pa.array([pickle.dumps(mine, 5)], pa.binary())},
                        schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("rows", pa.binary())]))

    made = rows.groupBy("part", "shard").applyInArrow(packed, "part int, shard int, rows binary")
    tasks = max(1, min(shards, math.ceil(2 * sc.defaultParallelism / parts)))
    keyed = made.rdd.map(lambda r: (r["part"] * tasks + r["shard"] % tasks, bytes(r["rows"])))
    return keyed.partitionBy(min(count, parts * tasks), lambda k: k).map(lambda r: pickle.loads(r[1]))


def added(rdd: RDD, count: Callable[[Iterable], dict[object, np.ndarray]]) -> dict[object, np.ndarray]:
    """Sums per key over all tasks."""

    def both(a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = a[k] + v if k in a else v
        return a

    counted = rdd.mapPartitions(lambda shards: [count(shards)])
    if rdd.getNumPartitions() > COLLECTED:
        return counted.treeReduce(both, 2)
    out: dict[object, np.ndarray] = {}
    for own in counted.collect():
        both(out, own)
    return out


# ---------------------------------------------------------------- cuts
def _sizes(targets: Sequence[str], shards: Iterable) -> dict:
    """Per target and part: rows, sum, least and greatest label."""
    out: dict = {}
    for part, _, y, known, _ in shards:
        for t, target in enumerate(targets):
            own = y[known[:, t], t]
            if len(own):
                old = out.get((target, part), np.array([0.0, 0.0, math.inf, -math.inf]))
                out[target, part] = np.array([old[0] + len(own), old[1] + own.sum(), min(old[2], own.min()), max(old[3], own.max())])
    return out


def _distinct(targets: Sequence[str], most: int, shards: Iterable) -> dict:
    """Per target, part and feature the ascending values, or None where they are more than ``most``."""
    out: dict = {}
    for part, x, _, known, _ in shards:
        for t, target in enumerate(targets):
            for f, column in enumerate(x[known[:, t]].T):
                key = (target, part, f)
                if out.get(key, ()) is not None:
                    values = np.unique(np.r_[out.get(key, ()), column])
                    out[key] = values if len(values) <= most else None
    return out


def _digits(targets: Sequence[str], shift: int, asked: Mapping, shards: Iterable) -> dict:
    """Per target, part and feature: rows by next digit, for each of the asked beginnings."""
    out: dict = {}
    for part, x, _, known, _ in shards:
        for t, target in enumerate(targets):
            for f in range(x.shape[1]):
                if (begun := asked.get((target, part, f))) is None:
                    continue
                bits = ordered_bits(x[known[:, t], f]) >> np.uint64(shift)
                head = bits >> np.uint64(DIGIT)
                at = np.searchsorted(begun, head).clip(max=len(begun) - 1)
                here = begun[at] == head
                cells = (at[here] << DIGIT) + (bits[here] & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                counted = np.bincount(cells, minlength=len(begun) << DIGIT).reshape(-1, 1 << DIGIT)
                out[target, part, f] = out[target, part, f] + counted if (target, part, f) in out else counted
    return out


def exact_cuts(raw: RDD, targets: Sequence[str], sizes: Mapping[tuple[str, int], int], bins: Sequence[int], width: int) -> dict[tuple[str, int, int], list[np.ndarray]]:
    """``cut_points`` of all rows of each (target, part), for each number of bins."""
    distinct: dict = {}
    for own in raw.mapPartitions(lambda shards: [_distinct(targets, max(bins), shards)]).collect():
        for k, v in own.items():
            values = None if v is None or distinct.get(k, ()) is None else np.unique(np.r_[distinct.get(k, ()), v])
            distinct[k] = values if values is not None and len(values) <= max(bins) else None
    ranks = {}
    for (target, part, f), values in distinct.items():
        wide = [b for b in bins if values is None or len(values) > b]
        if wide:
            n = sizes[target, part]
            ranks[target, part, f] = {b: np.floor(np.linspace(0, 1, b + 1)[1:-1] * (n - 1)).astype(np.int64) for b in wide}
    wanted = {k: np.unique(np.concatenate(list(v.values()))) for k, v in ranks.items()}
    heads = {k: np.zeros(len(v), np.uint64) for k, v in wanted.items()}  # digits found so far, per rank
    below = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}  # rows before that beginning
    for shift in range(64 - DIGIT, -1, -DIGIT) if wanted else ():
        asked = {k: np.unique(v) for k, v in heads.items()}
        counted = added(raw, partial(_digits, targets, shift, asked))
        for k, cells in counted.items():
            own = cells[np.searchsorted(asked[k], heads[k])]
            upto = below[k][:, None] + np.cumsum(own, axis=1)
            digit = (upto <= wanted[k][:, None]).sum(axis=1)
            below[k] = upto[np.arange(len(digit)), digit] - own[np.arange(len(digit)), digit]
            heads[k] = (heads[k] << np.uint64(DIGIT)) | digit.astype(np.uint64)
    out = {}
    for target, part in sizes:
        for b in bins:
            cuts = []
            for f in range(width):
                k = (target, part, f)
                if b in ranks.get(k, ()):
                    found = value_of(heads[k][np.searchsorted(wanted[k], ranks[k][b])])
                    cuts.append(np.unique(found[~np.isnan(found)]))
                else:
                    cuts.append(distinct[k][:-1])
            out[target, part, b] = cuts
    return out


def feature_cuts(rows: DataFrame, names: Sequence[str], bins: int) -> list[np.ndarray]:
    """``cut_points`` of all rows; missing values count as 0."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten().to_numpy().reshape(-1, len(names))
            shard = (0, flat, None, np.ones((len(flat), 1), bool), None)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(shard, 5)], pa.binary())], names=["rows"])

    raw = rows.select(x.alias("x")).mapInArrow(packed, "rows binary").rdd.map(lambda r: pickle.loads(bytes(r["rows"]))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = raw.map(lambda shard: len(shard[1])).sum()
        return exact_cuts(raw, [""], {("", 0): n}, [bins], len(names))["", 0, bins] if n else [np.array([])] * len(names)
    finally:
        raw.unpersist()


# ---------------------------------------------------------------- trees
class Growth:
    """One tree of one model, a level at a time."""

    def __init__(self, bins: Bins, usable: np.ndarray):
        self.bins, self.usable, self.level = bins, usable, 0
        self.total, self.gain, self.cut, self.below = [(0.0, 0.0)], [0.0], [(-1, 0)], [None]
        self.asked, self.pairs = [0], []  # nodes whose histogram is wanted; (sibling, parent's histogram) of each

    def _arrays(self, order: Sequence[int], value: Sequence[float], open_: set[int]) -> dict[str, list]:
        """The tree of these nodes; those that aren't open are leaves."""
        place = {i: k for k, i in enumerate(order)}
        cut = [self.cut[i] if i in open_ else None for i in order]
        return {
            "feature": [c[0] if c else -1 for c in cut],
            "threshold": [float(self.bins.cuts[c[0]][c[1]]) if c else 0.0 for c in cut],
            "left": [place[self.below[i][0]] if c else k for k, (i, c) in enumerate(zip(order, cut))],
            "right": [place[self.below[i][1]] if c else k for k, (i, c) in enumerate(zip(order, cut))],
            "value": list(value),
            "gain": [self.gain[i] if c else 0.0 for i, c in zip(order, cut)],
        }

    def asking(self) -> dict[str, list]:
        """What has grown, with a leaf's value the place of its node among those asked for, or -1."""
        place = {i: float(k) for k, i in enumerate(self.asked)}
        every = range(len(self.cut))
        return self._arrays(every, [place.get(i, -1.0) for i in every], {i for i in every if self.below[i]})

    def take(self, sums: np.ndarray) -> None:
        """Histograms of the nodes asked for: (3, nodes, bins of all features)."""
        s = self.bins.spec
        full = np.zeros((3, len(self.asked), *self.bins.real.shape))
        full[:, :, self.bins.real] = sums
        hist = {i: full[:, k] for k, i in enumerate(self.asked)}
        for i, (sibling, parent) in zip(self.asked, self.pairs):
            hist[sibling] = parent - hist[i]
        if not self.level:
            self.total[0] = tuple(full[:2, 0, 0].sum(axis=1).tolist()) if self.bins.cuts else (0.0, 0.0)
        here, self.asked, self.pairs = sorted(hist), [], []
        self.level += 1
        if self.level > s.depth:
            return
        for i, gain, f, b in zip(here, *(v.tolist() for v in self.bins.split(np.stack([hist[i] for i in here], axis=1), self.usable))):
            if gain <= 1e-12:
                continue
            left = hist[i][:, f, : b + 1].sum(axis=1)
            right = hist[i][:, f].sum(axis=1) - left
            children = (len(self.cut), len(self.cut) + 1)
            self.gain[i], self.cut[i], self.below[i] = gain, (f, b), children
            for side in (left, right):
                self.total.append((float(side[0]), float(side[1])))
                self.gain.append(0.0)
                self.cut.append((-1, 0))
                self.below.append(None)
            if self.level < s.depth:
                small = 0 if left[2] <= right[2] else 1
                self.asked.append(children[small])
                self.pairs.append((children[1 - small], hist[i]))

    def grown(self) -> dict[str, list]:
        """The tree: level by level, or, where leaves are bounded, with the cuts that gain most."""
        s = self.bins.spec
        order, waiting, open_ = [0], [], set()

        def met(i: int) -> None:
            if self.below[i]:
                heapq.heappush(waiting, (-self.gain[i] if s.leaves else len(order), len(order), i))

        met(0)
        while waiting and (s.leaves is None or len(open_) + 1 < s.leaves):
            i = heapq.heappop(waiting)[2]
            open_.add(i)
            for child in self.below[i]:
                order.append(child)
                met(child)
        value = [-s.rate * g / (h + s.penalty) if h + s.penalty > 0 else 0.0 for g, h in (self.total[i] for i in order)]
        return self._arrays(order, value, open_)


def _looked_up(tree: dict, cuts: Sequence[np.ndarray]) -> Tree | DeepTree:
    return (Tree if sum(f < 0 for f in tree["feature"]) <= 64 else DeepTree)(tree, cuts)


def _narrow(y: np.ndarray) -> np.ndarray:
    """The labels in the shortest type that holds them."""
    for kind in (np.int8, np.float32):
        with np.errstate(invalid="ignore", over="ignore"):
            if (y.astype(kind) == y).all():
                return y.astype(kind)
    return y


def _coded(targets: Sequence[str], specs: Mapping[str, Booster], cuts, bases, shard: tuple) -> tuple:
    """(part, {target: (labels, hashes, {learner: (bins per feature, margin)})}) of the rows with a label."""
    part, x, y, known, at = shard
    out, all_cuts = {}, cuts.value
    for t, target in enumerate(targets):
        own = {n: bases[target, n, part] for n in specs if (target, n, part) in bases}
        if own:
            rows = known[:, t]
            coded = {}
            for n, base in own.items():
                mine = all_cuts[target, part, specs[n].bins]
                kind = np.min_scalar_type(max((len(c) for c in mine), default=0))
                coded[n] = ([np.searchsorted(c, column, "left").astype(kind) for c, column in zip(mine, x[rows].T)], np.full(rows.sum(), base))
            out[target] = (_narrow(y[rows, t]), at[rows], coded)
    return part, out


def _with_trees(specs: Mapping[str, Booster], cuts, trees: Mapping[Key, list[dict]], shards: Iterable) -> Iterator[tuple]:
    """The shards with the values of further trees in their margins."""
    ready: dict = {}
    for part, sets in shards:
        out = {}
        for target, (y, at, coded) in sets.items():
            scored = {}
            for n, (codes, margin) in coded.items():
                key = (target, n, part)
                if key not in ready:
                    ready[key] = [_looked_up(t, cuts.value[target, part, specs[n].bins]) for t in trees.get(key, ())]
                for tree in ready[key]:
                    margin = margin + tree.values(codes)
                scored[n] = (codes, margin)
            out[target] = (y, at, scored)
        yield part, out


def _histograms(specs: Mapping[str, Booster], cuts, turn: int, asked: Mapping[Key, tuple[dict, int]], shards: Iterable) -> dict[Key, np.ndarray]:
    """Sums of gradients, second derivatives and rows per (node asked for, bin of a feature)."""
    out, ready = {}, {}
    for part, sets in shards:
        for target, (y, at, coded) in sets.items():
            for n, (codes, margin) in coded.items():
                key, spec = (target, n, part), specs[n]
                if key not in asked:
                    continue
                tree, k = asked[key]
                own = cuts.value[target, part, spec.bins]
                if key not in ready:
                    ready[key], out[key] = _looked_up(tree, own), np.zeros((3, k, sum(len(c) + 1 for c in own)))
                node = np.broadcast_to(ready[key].values(codes), margin.shape)
                seen = np.flatnonzero(drawn(at, turn, spec) & (node >= 0))
                node, m, label = node[seen].astype(np.int64), margin[seen], y[seen]
                p = 1 / (1 + np.exp(-m)) if spec.logistic else m
                g, h = p - label, p * (1 - p) if spec.logistic else None
                begin = 0
                for c, code in zip(own, codes):
                    size = len(c) + 1
                    cell = node * size + code[seen] if k > 1 else code[seen].astype(np.int64)
                    rows = np.bincount(cell, minlength=k * size).reshape(k, size)
                    out[key][0, :, begin : begin + size] += np.bincount(cell, g, k * size).reshape(k, size)
                    out[key][1, :, begin : begin + size] += rows if h is None else np.bincount(cell, h, k * size).reshape(k, size)
                    out[key][2, :, begin : begin + size] += rows
                    begin += size
    return out


def grow(labelled: DataFrame, x, at, part, targets: Sequence[str], learners: Mapping[str, Booster], width: int, parts: int, shards: int) -> tuple[dict[Key, float], dict[Key, list[dict]]]:
    """Start values and trees of every (target, learner, part)."""
    sc, keep = labelled.sparkSession.sparkContext, StorageLevel.MEMORY_AND_DISK
    raw = dealt_shards(labelled, x, at, part, targets, parts, shards).persist(keep)
    held = [raw]
    try:
        stats: dict = {}
        for own in raw.mapPartitions(lambda r: [_sizes(targets, r)]).collect():
            for k, v in own.items():
                old = stats.get(k, np.array([0.0, 0.0, math.inf, -math.inf]))
                stats[k] = np.array([old[0] + v[0], old[1] + v[1], min(old[2], v[2]), max(old[3], v[3])])
        bases = {(t, n, p): start(v[1] / v[0], spec) for (t, p), v in stats.items() for n, spec in learners.items()}
        grows = {(t, n, p) for t, n, p in bases if stats[t, p][2] != stats[t, p][3]}
        trees: dict[Key, list[dict]] = {k: [] for k in bases}
        bins = sorted({s.bins for s in learners.values()})
        found = exact_cuts(raw, targets, {k: int(v[0]) for k, v in stats.items()}, bins, width)
        cuts = sc.broadcast(found)
        coded = raw.map(partial(_coded, targets, learners, cuts, {k: bases[k] for k in grows})).persist(keep)
        held.append(coded)
        rngs = {k: np.random.default_rng(learners[k[1]].seed) for k in grows}
        edges = {k: Bins(found[k[0], k[2], learners[k[1]].bins], learners[k[1]]) for k in grows}
        now = coded
        for turn in range(max(s.trees for s in learners.values()) if grows else 0):
            growths = {}
            for k in grows:
                if turn < learners[k[1]].trees:
                    usable = np.zeros(width, bool)
                    usable[rngs[k].permutation(width)[: max(1, round(learners[k[1]].columns * width))]] = True
                    growths[k] = Growth(edges[k], usable)
            while asked := {k: (v.asking(), len(v.asked)) for k, v in growths.items() if v.asked}:
                for k, sums in added(now, partial(_histograms, learners, cuts, turn, asked)).items():
                    growths[k].take(sums)
                for old in [r for r in held if r is not now and r is not coded]:  # margins are kept by now
                    old.unpersist()
                    held.remove(old)
            new = {k: [v.grown()] for k, v in growths.items()}
            for k, v in new.items():
                trees[k] += v
            rebased = turn % REBASED == REBASED - 1
            now = (coded if rebased else now).mapPartitions(partial(_with_trees, learners, cuts, {k: list(v) for k, v in trees.items()} if rebased else new)).persist(keep)
            held.append(now)
        return bases, trees
    finally:
        for r in held:
            r.unpersist()
