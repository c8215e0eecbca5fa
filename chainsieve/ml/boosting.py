"""Histogram-boosted trees for many targets, learners and folds in one Spark job.

All labelled rows are dealt by hash to parts, and each (target, learner, part) is a task
of its own: it bins the features once, then grows the trees on histograms of gradients.
A model is a table with one row per tree; the probabilities of a learner's parts are
averaged. So a fit is one job however many targets it has, and a lost executor costs its
own parts only.

With ``rows_per_part`` rows or fewer there is one part, which is ordinary boosting.
``most_parts`` bounds the size of a model, not its rows: where parts would get more than
``rows_per_part`` rows, each lies in shards of that size, and its trees grow on histograms
of all of them (``sharded``). No task holds more rows than a shard has.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES = ("target string, learner string, part int, tree int, logistic boolean, base double, "
         "feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gain array<double>")


@dataclass(frozen=True)
class Booster:
    """How trees grow: level by level to ``depth``, or, with ``leaves``, always at the leaf that gains most."""

    trees: int = 200
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8  # share of rows a tree sees
    columns: float = 0.8  # share of features a tree sees
    leaves: int | None = None
    least_rows: int = 1
    least_weight: float = 1.0  # sum of second derivatives in a leaf
    penalty: float = 1.0
    bins: int = 256
    logistic: bool = True
    seed: int = 42


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending cuts per feature; a value is in the bin of the number of cuts below it."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            out.append(values)
        else:
            out.append(values[:-1])
    return out


class Bins:
    """Where the features of a training set can be cut, and which cut of a histogram is best."""

    def __init__(self, cuts: list[np.ndarray], spec: Booster):
        self.spec, self.cuts = spec, cuts
        self.width = max((len(c) for c in cuts), default=0) + 1
        sizes = np.array([len(c) for c in cuts], int)[:, None]
        # the last bin of a feature, and what lies behind it, can't be cut
        self.can = np.arange(self.width - 1)[None, :] < sizes
        self.real = np.arange(self.width)[None, :] <= sizes

    def split(self, hist: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain, feature and last bin of the left side of each node's best cut; gain 0 if none is any good. ``hist``: (3, nodes, features, bins)."""
        s = self.spec
        left = np.cumsum(hist, axis=3)[:, :, :, :-1]
        total = hist.sum(axis=3)[:, :, :, None]
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + s.penalty) + right[0] ** 2 / (right[1] + s.penalty) - total[0] ** 2 / (total[1] + s.penalty)
        fine = self.can & usable[:, None]
        for side in (left, right):
            fine = fine & (side[1] >= s.least_weight) & (side[2] >= s.least_rows)
        gain = np.where(fine, gain, 0.0).reshape(hist.shape[1], -1)
        if not gain.size:
            none = np.zeros(hist.shape[1], int)
            return none.astype(float), none, none
        at = gain.argmax(axis=1)
        return gain[np.arange(len(at)), at], at // self.can.shape[1], at % self.can.shape[1]


class Grower(Bins):
    """One training set in bins; grows trees for given gradients."""

    def __init__(self, x: np.ndarray, spec: Booster):
        super().__init__(cut_points(x, spec.bins), spec)
        self.codes = np.stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T)], axis=1).astype(np.int32)
        self.offset = np.arange(len(self.cuts), dtype=np.int32) * self.width

    def histogram(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        n, f = len(self.cuts) * self.width, len(self.cuts)
        flat = (self.codes[rows] + self.offset).ravel()
        sums = [np.bincount(flat, np.repeat(v[rows], f), n) for v in (g, h)] + [np.bincount(flat, minlength=n)]
        return np.stack(sums).reshape(3, f, self.width)

    def tree(self, g: np.ndarray, h: np.ndarray, rows: np.ndarray, usable: np.ndarray) -> tuple[dict[str, list], np.ndarray]:
        """The tree's arrays, and each row's value of all rows of the set."""
        s = self.spec
        out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "gain")}
        waiting: list[tuple] = []
        value = np.zeros(len(self.codes))
        everyone = np.arange(len(self.codes))

        def node(seen: np.ndarray, all_: np.ndarray, hist: np.ndarray, depth: int) -> int:
            i = len(out["feature"])
            total = hist[:, 0].sum(axis=1)
            own = -s.rate * total[0] / (total[1] + s.penalty) if total[1] + s.penalty > 0 else 0.0
            for k, v in (("feature", -1), ("threshold", 0.0), ("left", i), ("right", i), ("value", own), ("gain", 0.0)):
                out[k].append(v)
            value[all_] = own
            if depth < s.depth:
                gain, f, b = (v[0].item() for v in self.split(hist[:, None], usable))
                if gain > 1e-12:
                    heapq.heappush(waiting, (-gain if s.leaves else i, i, gain, f, b, seen, all_, hist, depth))
            return i

        node(rows, everyone, self.histogram(rows, g, h), 0)
        leaves = 1
        while waiting and (s.leaves is None or leaves < s.leaves):
            _, i, gain, f, b, seen, all_, hist, depth = heapq.heappop(waiting)
            goes, goes_all = self.codes[seen, f] <= b, self.codes[all_, f] <= b
            parts = [(seen[goes], all_[goes_all]), (seen[~goes], all_[~goes_all])]
            small = 0 if len(parts[0][0]) <= len(parts[1][0]) else 1
            counted = self.histogram(parts[small][0], g, h)
            hists = [counted, hist - counted] if small == 0 else [hist - counted, counted]
            out["feature"][i], out["threshold"][i], out["gain"][i] = f, float(self.cuts[f][b]), gain
            out["left"][i] = node(*parts[0], hists[0], depth + 1)
            out["right"][i] = node(*parts[1], hists[1], depth + 1)
            leaves += 1
        return out, value


def start(mean: float, spec: Booster) -> float:
    """The margin before any tree, of the labels' mean."""
    if not spec.logistic:
        return mean
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return math.log(mean / (1 - mean))


def boost(x: np.ndarray, y: np.ndarray, spec: Booster) -> tuple[float, list[dict[str, list]]]:
    """Start value and trees of one model."""
    rng, n, f = np.random.default_rng(spec.seed), len(y), x.shape[1]
    base = start(float(y.mean()) if n else 0.0, spec)
    if not n or y.min() == y.max():
        return base, []
    grower, margin, trees = Grower(x, spec), np.full(n, base), []
    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-margin)) if spec.logistic else margin
        h = p * (1 - p) if spec.logistic else np.ones(n)
        rows = np.flatnonzero(rng.random(n) < spec.rows) if spec.rows < 1 else np.arange(n)
        usable = np.zeros(f, bool)
        usable[rng.permutation(f)[: max(1, round(spec.columns * f))]] = True
        tree, value = grower.tree(p - y, h, rows if len(rows) else np.arange(n), usable)
        margin += value
        trees.append(tree)
    return base, trees


def _rows(target: str, learner: str, part: int, spec: Booster, base: float, trees: list[dict[str, list]]) -> list[dict]:
    """A model as rows of the table of trees; one without trees is a row as well."""
    trees = trees or [{"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "value": [0.0], "gain": [0.0]}]
    return [{"target": target, "learner": learner, "part": part, "tree": i, "logistic": spec.logistic, "base": base, **t} for i, t in enumerate(trees)]


def fit(rows: DataFrame, names: Sequence[str], targets: Sequence[str], learners: Mapping[str, Booster], *, row_id: Sequence[str] = (), rows_per_part: int = 1 << 16, most_parts: int = 4) -> DataFrame:
    """Trees of every learner for every target column; a row whose target is null is not in that target's training set.

    Missing features count as 0. Rows are dealt to ``most_parts`` parts at most by a hash
    of their features and ``row_id``; every labelled row is fitted on, however many there
    are. A target with one value gets its start value and no tree.
    """
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    some = F.greatest(*[F.col(c).isNotNull() for c in targets], F.lit(False))
    labelled = rows.where(some)
    n = labelled.count()
    parts = max(1, min(most_parts, math.ceil(n / rows_per_part)))
    at = F.xxhash64(*dict.fromkeys([*row_id, *names]))
    part = F.pmod(at, F.lit(parts)).cast("int")
    if n > rows_per_part * parts:
        from chainsieve.ml import sharded

        bases, trees = sharded.grow(labelled, x, at, part, targets, learners, len(names), parts, math.ceil(n / parts / rows_per_part))
        found = [r for k in sorted(bases) for r in _rows(*k, learners[k[1]], bases[k], trees[k])]
        return rows.sparkSession.createDataFrame(pa.Table.from_pylist(found, _SCHEMA), TREES)
    wanted = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(n).alias("learner"), F.col(t).cast("double").alias("y")) for t in targets for n in learners])
    # rows that tie in their features differ in row_id; the order inside a task decides which rows a tree sees
    long = labelled.select(x.alias("x"), part.alias("part"), at.alias("at"), F.explode(wanted).alias("w"))
    long = long.where(F.col("w.y").isNotNull()).select("w.target", "w.learner", "part", "at", "x", "w.y")
    specs, width = dict(learners), len(names)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        target, learner, k = (v.as_py() for v in key)
        flat = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
        y, at = table.column("y").to_numpy(), table.column("at").to_numpy()
        order = np.lexsort((y, *flat.T[::-1], at))
        base, trees = boost(flat[order], y[order], specs[learner])
        return pa.Table.from_pylist(_rows(target, learner, k, specs[learner], base, trees), _SCHEMA)

    return long.groupBy("target", "learner", "part").applyInArrow(run, TREES)


_SCHEMA = pa.schema(
    [("target", pa.string()), ("learner", pa.string()), ("part", pa.int32()), ("tree", pa.int32()), ("logistic", pa.bool_()), ("base", pa.float64())]
    + [(c, pa.list_(pa.int32() if c in ("feature", "left", "right") else pa.float64())) for c in ("feature", "threshold", "left", "right", "value", "gain")]
)


_SLOT = 0x03F79D71B4CB0A89  # de Bruijn number: times a power of two, its six highest bits differ for all 64 powers


class Tree:
    """One tree of up to 64 leaves as sets of leaves, each set the bits of a word.

    The leaves are numbered from left to right. A value that is not at or below a
    threshold rules out the leaves left of that cut; the lowest leaf that no feature
    rules out is the row's. So a feature takes one look-up for all its cuts.
    """

    def __init__(self, tree: dict, cuts: Sequence[np.ndarray]):
        leaves, found = [], [[] for _ in cuts]

        def walk(i: int) -> int:
            """Leaves below node ``i`` as bits."""
            f = tree["feature"][i]
            if f < 0:
                leaves.append(tree["value"][i])
                return 1 << (len(leaves) - 1)
            left = walk(tree["left"][i])
            found[f].append((int(np.searchsorted(cuts[f], tree["threshold"][i])), left))
            return left | walk(tree["right"][i])

        every = walk(0)
        self.features = []  # (feature, words, for how many bins in a row each holds)
        for f, own in enumerate(found):
            if own:
                own.sort()
                words = [every]
                for _, left in own:
                    words.append(words[-1] & ~left)
                at = [0, *(place + 1 for place, _ in own), len(cuts[f]) + 1]
                self.features.append((f, np.array(words, np.uint64), np.diff(at)))
        self.value = np.zeros(64)
        for k, value in enumerate(leaves):
            self.value[(_SLOT << k & (1 << 64) - 1) >> 58] = value
        self.first = leaves[0]

    def values(self, bins: Sequence[np.ndarray]) -> np.ndarray | float:
        """Each row's value, of the rows' bins per feature."""
        left = None
        for f, words, run in self.features:
            own = np.repeat(words, run).take(bins[f])
            left = own if left is None else np.bitwise_and(left, own, out=left)
        if left is None:
            return self.first
        left &= np.negative(left)
        left *= np.uint64(_SLOT)
        left >>= np.uint64(58)
        return self.value.take(left.view(np.int64))


class DeepTree:
    """One tree of any size, followed node by node."""

    def __init__(self, tree: dict, cuts: Sequence[np.ndarray]):
        self.feature, self.left, self.right = (np.array(tree[c], np.int32) for c in ("feature", "left", "right"))
        self.value = np.array(tree["value"], float)
        self.place = np.array([np.searchsorted(cuts[f], t) if f >= 0 else 0 for f, t in zip(tree["feature"], tree["threshold"])], np.int32)

    def values(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        bins = np.stack(bins)
        at, rows = np.zeros(bins.shape[1], np.int32), np.arange(bins.shape[1])
        while (self.feature[at] >= 0).any():
            goes = bins[np.maximum(self.feature[at], 0), rows] <= self.place[at]
            at = np.where(goes, self.left[at], self.right[at])  # a leaf leads to itself
        return self.value[at]


class Forest:
    """All trees of one learner for one target."""

    def __init__(self, trees: list[dict]):
        self.logistic = trees[0]["logistic"]
        self.parts = []  # (start value, the part's cuts per feature, its trees)
        width = max(f for t in trees for f in t["feature"]) + 1
        for p in sorted({t["part"] for t in trees}):
            own = [t for t in trees if t["part"] == p]
            cuts = [np.unique([c for t in own for g, c in zip(t["feature"], t["threshold"]) if g == f]) for f in range(width)]
            self.parts.append((own[0]["base"], cuts, [(Tree if sum(f < 0 for f in t["feature"]) <= 64 else DeepTree)(t, cuts) for t in own]))

    def members(self, x: np.ndarray) -> np.ndarray:
        """Prediction of each part's trees: (rows, parts)."""
        margin = np.zeros((len(x), len(self.parts)))
        for p, (base, cuts, trees) in enumerate(self.parts):
            bins = [np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)]
            total = np.zeros(len(x))
            for tree in trees:
                total += tree.values(bins)
            margin[:, p] = base + total
        return 1 / (1 + np.exp(-margin)) if self.logistic else margin


Model = dict[tuple[str, str], Forest]


def load(trees: DataFrame) -> Model:
    """The fitted model, whose size is bounded by targets, learners, parts and trees."""
    by: dict[tuple[str, str], list[dict]] = {}
    # sorted here, as Spark would run the fit once more to sample it for a sort
    for r in sorted(trees.collect(), key=lambda r: (r["target"], r["learner"], r["part"], r["tree"])):
        by.setdefault((r["target"], r["learner"]), []).append(r.asDict())
    return {k: Forest(v) for k, v in by.items()}


def dealt(rows: DataFrame) -> DataFrame:
    """The rows spread evenly over tasks, however few files or row groups they come from; the runtime picks the number by measured size."""
    return rows.hint("rebalance")


def predict(rows: DataFrame, names: Sequence[str], model: Model, outputs: Mapping[str, tuple[str, str]], *, spread: Sequence[str] = ()) -> DataFrame:
    """Adds a column per output, the mean over the parts of (target, learner); for those in ``spread`` also ``{output}_spread``, the parts' standard deviation.

    A row passes some thousand trees, so the rows are dealt to tasks first: a file of one row group would be one task.
    """
    wanted = [(o, model[k]) for o, k in outputs.items()]
    more = [*outputs, *(f"{o}_spread" for o in spread)]
    kept = [c for c in rows.columns if c not in more]
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    asked = dealt(rows.select(*kept)).select(F.struct(*kept).alias("__row"), x.alias("__x"))
    kind, width = asked.schema["__row"].dataType, len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(-1, width)
            each = {o: f.members(flat) for o, f in wanted}
            columns = [pa.array(each[o].mean(axis=1)) for o in outputs] + [pa.array(each[o].std(axis=1)) for o in spread]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__row", *more])

    schema = f"__row {kind.simpleString()}, " + ", ".join(f"`{c}` double" for c in more)
    return asked.mapInArrow(run, schema).select("__row.*", *more)


def importance(trees: DataFrame, names: Sequence[str]) -> DataFrame:
    """target, learner, feature, importance: each feature's share of the gain of all cuts."""
    cuts = trees.select("target", "learner", F.explode(F.arrays_zip("feature", "gain")).alias("c")).where("c.feature >= 0")
    gains = cuts.groupBy("target", "learner", F.col("c.feature").alias("i")).agg(F.sum("c.gain").alias("gain"))
    totals = gains.groupBy("target", "learner").agg(F.sum("gain").alias("total"))
    every = trees.select("target", "learner").distinct().select("*", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "feature"))
    out = every.join(gains, ["target", "learner", "i"], "left").join(totals, ["target", "learner"], "left")
    return out.select("target", "learner", "feature", F.coalesce(F.col("gain") / F.col("total"), F.lit(0.0)).alias("importance"))
