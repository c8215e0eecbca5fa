"""Quality scores by co-training.

Two classifiers see different sides of a document: one its text (word presence and
the shape of the writing), one its page metadata (source, language, length). Both
start from labelled documents, of which a bounded number comes to the driver. In each
round either view labels all other documents that it is sure of, where they are, and
the other one learns from them: what comes back are counts per word and class, sums
per shape and class, and counts per metadata cell and class. On labelled documents
kept back, each view's scores are calibrated and the two are combined; the result
scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.common import buffers, lower_ascii, mix, steps, texts, word_bounds, word_hashes

#: Labelled documents that the fit uses, at most about; words that the text view takes from these, and again from the others; rounds of exchange.
LABELLED, WORDS, ROUNDS = 12_000, 2_048, 4
#: How sure a view has to be of a document that it labels.
SURE = 0.98
#: Hash slots of the metadata view: source, language, length.
SLOTS = 64
SIZES = 16
N_META = SLOTS + SLOTS // 4 + SIZES
#: Word counts that a task gathers before it hands them on.
GATHERED = 1 << 20
SHAPES = 10

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 other printable ASCII, 4 line break
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[10] = 4


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features of each text, and its distinct lower-case word hashes: (shapes, row, hash)."""
    raw, offsets = buffers(column)
    shapes, rows, hashes = [], [], []
    for a, b in steps(offsets):
        part = raw[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        starts, ends, before = word_bounds(part, at)
        h = word_hashes(lower_ascii(part), starts, ends)
        n = np.diff(before)
        doc = np.repeat(np.arange(b - a), n)
        order = np.lexsort((h, doc))
        d, s = doc[order], h[order]
        new = np.ones(len(s), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        times = np.diff(first, append=len(s))
        most = np.zeros(b - a)
        np.maximum.at(most, d[first], times)
        kind = _KIND[part]
        size = np.maximum(np.diff(at), 1)
        kinds = [np.diff(np.concatenate([[0], np.cumsum(kind == k)])[at]) / size for k in (1, 2, 3, 4)]
        words, distinct = np.maximum(n, 1), np.bincount(d[first], minlength=b - a)
        length = np.bincount(doc, (ends - starts).astype(float), b - a) / words
        shapes.append(np.column_stack([np.log1p(n), np.log1p(np.diff(at)), *kinds, distinct / words, most / words, np.log1p(length), (n == 0).astype(float)]))
        rows.append(d[first] + a)
        hashes.append(s[first])
    return np.concatenate(shapes or [np.zeros((0, SHAPES))]), np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def metadata(name: str) -> list[Column]:
    """Slots of source and language, and length in steps of doubling; nulls have their own."""
    slot = lambda c, salt, n: F.pmod(F.xxhash64(F.lit(salt), F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n))
    size = F.least(F.lit(15), F.floor(F.log2(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)))
    return [F.array(slot("source", "s", SLOTS), slot("lang", "l", SLOTS // 4) + SLOTS, size + SLOTS + SLOTS // 4).cast("array<int>").alias(name)]


def _logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int], y: np.ndarray, weight: np.ndarray, ridge: float, iterations: int = 250) -> np.ndarray:
    """Weights and, last, the intercept of a weighted logistic regression on sparse rows, by Adam over the whole batch."""
    w = np.zeros(shape[1] + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    total = max(weight.sum(), 1e-9)
    for t in range(1, iterations + 1):
        z = np.bincount(rows, values * w[cols], shape[0]) + w[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        g = np.append(np.bincount(cols, values * e[rows], shape[1]), e.sum())
        g[:-1] += ridge * w[:-1] / total
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.3 * (1 - t / (iterations + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-10)
    return w


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Calibration of columns of logits: weights and, last, the intercept, by Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    return w


@dataclass
class QualityModel:
    words: np.ndarray  # sorted hashes
    centre: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    text_fit: np.ndarray | None = None
    meta_fit: np.ndarray | None = None
    both_fit: np.ndarray | None = None
    threshold: float = 0.5

    def scaled(self, shapes: np.ndarray) -> np.ndarray:
        return np.clip((shapes - self.centre) / self.scale, -6, 6)

    def text_rows(self, shapes: np.ndarray, row: np.ndarray, h: np.ndarray):
        """Sparse rows of the text view: chosen words, then scaled shapes."""
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        hit = np.flatnonzero(self.words[at] == h) if len(self.words) else np.zeros(0, np.int64)
        n = len(self.words)
        scaled = self.scaled(shapes)
        i, j = np.indices(scaled.shape)
        return np.concatenate([row[hit], i.ravel()]), np.concatenate([at[hit], n + j.ravel()]), np.concatenate([np.ones(len(hit)), scaled.ravel()])

    def logits(self, view: tuple, meta: np.ndarray) -> np.ndarray:
        rows, cols, values = self.text_rows(*view)
        text = np.bincount(rows, values * self.text[cols], len(meta)) + self.text[-1]
        return np.column_stack([text, self.meta[meta].sum(1) + self.meta[-1]])

    def scores(self, view: tuple, meta: np.ndarray) -> np.ndarray:
        """Calibrated score of the text view, of the metadata view, and of both."""
        z = self.logits(view, meta)
        fits = ((z[:, :1], self.text_fit), (z[:, 1:], self.meta_fit), (z, self.both_fit))
        return np.column_stack([1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40))) for x, w in fits])


def _choose_words(row: np.ndarray, h: np.ndarray, y: np.ndarray, share: float, most: int) -> np.ndarray:
    """Hashes of the words whose presence tells the classes apart best, by a z-score of at least 6.

    With a million words to choose from, less arises by chance.
    """
    words, at, count = np.unique(h, return_inverse=True, return_counts=True)
    good = np.bincount(at, y[row], len(words))
    z = np.abs(good - count * share) / np.sqrt(np.maximum(count * share * (1 - share), 1e-9))
    z[(count < 5) | (z < 6)] = 0
    top = np.argsort(-z, kind="stable")[:most]
    return np.sort(words[top[z[top] > 0]])


@dataclass
class Taught:
    """What the views learned from unlabelled documents in a round; index 0 of a pair is bad, 1 good."""

    words: np.ndarray  # sorted hashes: the wanted ones, and those that tell the classes apart best
    counts: np.ndarray  # documents per word and class
    documents: np.ndarray  # documents per class
    shapes: np.ndarray  # sums of scaled shapes: (class, shape)
    cells: np.ndarray  # documents per metadata cell (source, language, length) and class


def _labels(p: np.ndarray) -> np.ndarray:
    """1 and 0 where a probability is sure enough, else -1."""
    return np.where(p >= SURE, 1, np.where(1 - p >= SURE, 0, -1))


def exchange(rows: DataFrame, model: QualityModel, fits: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, words: int) -> Taught:
    """One round over all ``rows`` (doc_id, text, meta): each view labels those it is sure of for the other one.

    A text that repeats within a task counts once, as copies would pass for evidence.
    """
    sent = rows.sparkSession.sparkContext.broadcast((model, fits, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fits, wanted = sent.value
        documents, shapes_, cells = np.zeros(2, np.int64), np.zeros((2, SHAPES)), np.zeros((SLOTS * (SLOTS // 4) * SIZES, 2), np.int64)
        seen: set[int] = set()
        held, n_held = [], 0

        def out(kind, key, bad, good):
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(kind, len(key)).astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(bad.astype(float)), pa.array(good.astype(float))], names=["kind", "key", "bad", "good"])

        def counted() -> pa.RecordBatch:
            h, y = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            key, at = np.unique(h, return_inverse=True)
            return out(np.isin(key, wanted), key.view(np.int64), np.bincount(at, y == 0, len(key)), np.bincount(at, y == 1, len(key)))

        for batch in batches:
            if not batch.num_rows:
                continue
            shapes, row, h = text_view(batch.column(1))
            meta = batch.column(2).flatten().to_numpy().reshape(-1, 3)
            z = model.logits((shapes, row, h), meta)
            by_text, by_meta = (_labels(1 / (1 + np.exp(-np.clip(z[:, i] * w[0] + w[1], -40, 40)))) for i, w in enumerate(fits))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            fresh = shapes[:, -1] == 0  # a document without words says nothing
            for i in np.flatnonzero(fresh & ((by_text >= 0) | (by_meta >= 0))).tolist():
                k = hash(h[edges[i] : edges[i + 1]].tobytes())
                fresh[i] = k not in seen
                seen.add(k)
            by_text[~fresh] = by_meta[~fresh] = -1
            scaled = model.scaled(shapes)
            for c in (0, 1):
                mine = by_meta == c
                documents[c] += mine.sum()
                shapes_[c] += scaled[mine].sum(0)
                cell = meta[by_text == c] - [0, SLOTS, SLOTS + SLOTS // 4]
                np.add.at(cells[:, c], (cell[:, 0] * (SLOTS // 4) + cell[:, 1]) * SIZES + cell[:, 2], 1)
            keep = by_meta[row] >= 0
            held.append((h[keep], by_meta[row[keep]]))
            n_held += int(keep.sum())
            if n_held >= GATHERED:
                yield counted()
                held, n_held = [], 0
        if n_held:
            yield counted()
        full = np.flatnonzero(cells.any(1))
        yield out(2, full, cells[full, 0], cells[full, 1])
        yield out(3, np.arange(SHAPES), shapes_[0], shapes_[1])
        yield out(4, np.zeros(1), documents[:1], documents[1:])

    sums = rows.mapInArrow(run, "kind int, key long, bad double, good double").groupBy("kind", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
    few = sums.where("kind > 0").collect()  # wanted words, metadata cells, shapes
    documents, shapes, cells = np.zeros(2), np.zeros((2, SHAPES)), []
    for r in few:
        if r["kind"] == 4:
            documents[:] = r["bad"], r["good"]
        elif r["kind"] == 3:
            shapes[:, r["key"]] = r["bad"], r["good"]
        elif r["kind"] == 2:
            cells.append((r["key"], r["bad"], r["good"]))
    share = float(np.clip(documents[1] / max(documents.sum(), 1), 0.01, 0.99))
    n = F.col("bad") + F.col("good")
    z = F.abs(F.col("good") - n * share) / F.sqrt(n * (share * (1 - share)))
    best = sums.where("kind = 0").where((n >= 5) & (z >= 6)).orderBy(z.desc(), "key").limit(words).collect() if documents.all() else []
    sums.unpersist()
    found = sorted((int(np.int64(r["key"]).view(np.uint64)), r["bad"], r["good"]) for r in [*(r for r in few if r["kind"] == 1), *best])
    return Taught(np.array([x[0] for x in found], np.uint64), np.array([x[1:] for x in found]).reshape(-1, 2), documents, shapes, np.array(sorted(cells)).reshape(-1, 3))


def _text_lessons(model: QualityModel, taught: Taught | None, weight: np.ndarray):
    """The taught documents as sparse rows for the text view: one per word and class, and one of mean shapes per class; with labels and weights.

    All rows of a class weigh ``weight`` together, half of it for the shapes.
    """
    if taught is None or not taught.documents.all() or not taught.counts.any(0).all():
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(0), np.zeros(0)
    at, n = np.searchsorted(model.words, taught.words), len(model.words)  # all of them are words of the model
    k = 2 * len(at)
    rows = np.concatenate([np.arange(k), np.repeat([k, k + 1], SHAPES)])
    cols = np.concatenate([at, at, np.tile(np.arange(n, n + SHAPES), 2)])
    values = np.concatenate([np.ones(k), (taught.shapes / taught.documents[:, None]).ravel()])
    heavy = np.concatenate([*(taught.counts[:, c] * weight[c] / 2 / taught.counts[:, c].sum() for c in (0, 1)), weight / 2])
    return (rows, cols, values), np.concatenate([np.repeat([0.0, 1.0], len(at)), [0.0, 1.0]]), heavy


def co_train(view: tuple, meta: np.ndarray, y: np.ndarray, others: DataFrame | None, rounds: int = ROUNDS, words: int = WORDS) -> QualityModel:
    """A model from labelled documents with y = 1 (good) or 0 (bad), every fourth of which is kept for calibration, and ``others`` without a label (doc_id, text, meta)."""
    shapes, row, h = view
    every = np.arange(len(y))
    held, own = every[3::4], np.delete(every, np.s_[3::4])
    judge = held if len(held) and 0 < y[held].mean() < 1 else every
    truth = y[judge].astype(float)
    mine = np.isin(row, own)
    share = np.clip(y[own].mean(), 0.01, 0.99)
    chosen = _choose_words(row[mine], h[mine], np.where(np.isin(every, own), y, 0), share, words) if len(own) else np.zeros(0, np.uint64)
    model = QualityModel(chosen, shapes[own].mean(0), shapes[own].std(0) + 1e-6, np.zeros(0), np.zeros(0))
    label, weight = y.astype(float), np.zeros(len(y))
    weight[own] = np.where(y[own] > 0, 0.5 / share, 0.5 / (1 - share))
    m_cols = meta.ravel()
    taught = None
    for r in range(rounds + 1):
        if taught is not None:
            model.words = np.union1d(chosen, taught.words)
        rows, cols, values = model.text_rows(shapes, row, h)
        n_text = len(model.words) + SHAPES
        # all taught documents of a class together weigh at most as much as the labelled ones
        most = np.array([weight[own][y[own] == c].sum() for c in (0, 1)])
        each = 0.2 * np.array([0.5 / (1 - share), 0.5 / share])
        lessons, l_label, l_weight = _text_lessons(model, taught, np.minimum(most, each * taught.documents) if taught is not None else most)
        parts = ([a, b + len(y) * (i == 0)] for i, (a, b) in enumerate(zip((rows, cols, values), lessons)))
        rows, cols, values = (np.concatenate(x) for x in parts)
        model.text = _logistic(rows, cols, values, (len(y) + len(l_label), n_text), np.concatenate([label, l_label]), np.concatenate([weight, l_weight]), 0.3)
        cells = taught.cells if taught is not None else np.zeros((0, 3))
        key, n_cells = cells[:, 0].astype(np.int64), cells[:, 1:].sum(0)
        c_weight = (cells[:, 1:] * np.minimum(each, most / np.maximum(n_cells, 1))).T
        parts = np.column_stack([key // (SLOTS // 4 * SIZES), key // SIZES % (SLOTS // 4) + SLOTS, key % SIZES + SLOTS + SLOTS // 4])
        n = len(y) + 2 * len(cells)
        both = np.concatenate([m_cols, np.tile(parts, (2, 1)).ravel()])
        model.meta = _logistic(np.repeat(np.arange(n), 3), both, np.ones(len(both)), (n, N_META), np.concatenate([label, np.repeat([0.0, 1.0], len(cells))]), np.concatenate([weight, c_weight.ravel()]), 5.0, 80)
        if r == rounds or others is None:
            break
        # sureness is judged after calibration, so a view that knows little labels little
        z = model.logits(view, meta)[judge]
        taught = exchange(others, model, (_platt(z[:, :1], truth), _platt(z[:, 1:], truth)), chosen, words)
    z = model.logits(view, meta)
    use = judge
    model.text_fit, model.meta_fit, model.both_fit = _platt(z[use, :1], truth), _platt(z[use, 1:], truth), _platt(z[use], truth)
    p = model.scores((shapes, row, h), meta)[use, 2]
    # the threshold that errs least on held documents, where it costs good ones twice as much to go
    steps_ = np.unique(np.concatenate([[0.5], np.quantile(p, np.linspace(0, 0.5, 51))]))
    cost = [2 * ((p < t) & (truth > 0)).sum() + ((p >= t) & (truth == 0)).sum() for t in steps_]
    model.threshold = float(steps_[int(np.argmin(cost))])
    return model


def _chance(salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / float(1 << 30)


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> QualityModel | None:
    """A model of good documents (quality 1, not toxic); None without labels of both kinds.

    At most about ``labelled`` labelled documents come to the driver, picked by a hash of
    doc_id. All other documents take part in the exchange. Several labels of a document count as its worst. A null
    quality is no label, a null toxic counts as 0.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")).where("id IS NOT NULL AND quality IS NOT NULL")
    n_marks = marks.count()
    if not n_marks:
        return None
    picked = marks.withColumnRenamed("id", "doc_id").where(_chance("label") < min(1.0, labelled / n_marks)).groupBy("doc_id").agg((F.min("quality") * (1 - F.max("toxic"))).alias("y"))
    rows = texts(docs, *metadata("meta"))
    known = rows.join(F.broadcast(picked), "doc_id")  # some ``labelled`` rows of two numbers
    others = rows.join(F.broadcast(picked), "doc_id", "left_anti").select("doc_id", "text", "meta")
    got = known.select("doc_id", "text", "meta", F.col("y").cast("int").alias("y"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, row, h = text_view(batch.column(1))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(2), pa.array(list(shapes), pa.list_(pa.float64())), pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                names=["doc_id", "y", "meta", "shapes", "words"],
            )

    found = got.mapInArrow(read, "doc_id long, y int, meta array<int>, shapes array<double>, words binary").collect()
    found.sort(key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["words"]))
    y = np.array([r["y"] for r in found])
    if not (y == 1).any() or not (y == 0).any():
        return None
    seen: set[tuple] = set()  # copies would pass for evidence
    keep = [not ((k := (r["words"], r["y"])) in seen or seen.add(k)) for r in found]
    found, y = [r for r, k in zip(found, keep) if k], y[keep]
    words = [np.frombuffer(r["words"], np.uint64) for r in found]
    shapes, meta = np.array([r["shapes"] for r in found]), np.array([r["meta"] for r in found])
    row, h = np.repeat(np.arange(len(found), dtype=np.int32), [len(w) for w in words]), np.concatenate(words)
    del found, words
    return co_train((shapes, row, h), meta, y, others)


def quality_scores(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, text_score, meta_score, score and keep of every document.

    Scores are calibrated probabilities that a document is good. A document without
    words scores 0 in the text view and in all, and isn't kept. Without labels of both
    kinds there is nothing to learn: every other document scores 0.5 and is kept.
    Missing metadata has its own slot. Repeated rows score alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, labelled))  # at most twice WORDS words and some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            view = text_view(batch.column(1))
            meta = batch.column(2).flatten().to_numpy().reshape(-1, 3)
            m = model.value
            p = m.scores(view, meta) if m else np.full((batch.num_rows, 3), 0.5)
            empty = view[0][:, -1] > 0
            p[empty, 0] = p[empty, 2] = 0.0
            keep = (p[:, 2] >= (m.threshold if m else 0.5)) & ~empty
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(3)), pa.array(keep)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return texts(docs, *metadata("meta")).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
