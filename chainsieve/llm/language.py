"""Language identification with interpolated Kneser-Ney character models.

One model per language over runs of up to four characters. For every order the seen
runs of all languages are one sorted array of 64-bit codes with a row of
log-probabilities beside it, so scoring a text is a binary search per character
instead of one per character and language. The language with the lowest
cross-entropy per character wins; scores and rejection are calibrated on documents
that were held back from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.common import texts

#: Labelled documents per language that a model is fitted on, about.
PER_LANGUAGE = 1500
#: Symbols: 0 for whatever is no letter, 1 for a rare letter, then the letters by frequency.
SYMBOLS = 256
#: Characters scored in one numpy step.
STEP = 1 << 20


def hash_fold(folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def _symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text in lower case, runs of symbol 0 as one, with one at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    ids = table[np.minimum(points, len(table) - 1)]
    out = np.zeros(len(ids) + 2, np.uint8)
    out[1:-1] = ids
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def _codes(s: np.ndarray, order: int) -> np.ndarray:
    """Code of the run of ``order`` symbols that ends at each position from order-1 on."""
    out = s[: len(s) - order + 1].astype(np.uint64)
    for i in range(1, order):
        out = (out << np.uint64(8)) | s[i : len(s) - order + 1 + i]
    return out


@dataclass
class LanguageModel:
    """Everything a task needs: symbol table, sorted arrays and calibration."""

    languages: list[str]
    table: np.ndarray
    runs4: np.ndarray
    logs4: np.ndarray
    contexts3: np.ndarray
    back3: np.ndarray
    runs3: np.ndarray
    logs3: np.ndarray
    back2: np.ndarray
    logs2: np.ndarray
    weights: np.ndarray | None = None
    usual: np.ndarray | None = None

    def char_logs(self, s: np.ndarray) -> np.ndarray:
        """log2 probability of each symbol after the third, one column per language."""
        codes = _codes(s, 4)
        at = np.minimum(np.searchsorted(self.runs4, codes), len(self.runs4) - 1)
        out = self.logs4[at]
        missed = np.flatnonzero(self.runs4[at] != codes)
        if len(missed):
            c = codes[missed]
            context = c >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts3, context), len(self.contexts3) - 1)
            back = np.where((self.contexts3[at] == context)[:, None], self.back3[at], np.float32(0))
            c3 = c & np.uint64(0xFFFFFF)
            at = np.minimum(np.searchsorted(self.runs3, c3), len(self.runs3) - 1)
            low = self.back2[(c3 >> np.uint64(8)).astype(np.int64)] + self.logs2[(c3 & np.uint64(0xFFFF)).astype(np.int64)]
            out[missed] = back + np.where((self.runs3[at] == c3)[:, None], self.logs3[at], low)
        return out

    def entropies(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and the number of characters scored."""
        sums, counts = np.zeros((len(batch), len(self.languages))), np.zeros(len(batch), np.int64)
        gathered: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            if not gathered:
                return
            lengths = np.array([len(x) for x in gathered])
            s = np.concatenate(gathered)
            logs = self.char_logs(s)
            last = np.cumsum(lengths)
            first = last - lengths
            logs = np.vstack([logs, np.zeros((3, logs.shape[1]), np.float32)])
            for o, a, b in zip(owners, first, last - 3):
                sums[o] += logs[a:b].sum(axis=0, dtype=np.float64)
                counts[o] += b - a
            gathered.clear()
            owners.clear()

        size = 0
        for i, text in enumerate(batch):
            if not text:
                continue
            s = np.concatenate([np.zeros(2, np.uint8), _symbols(text, self.table)])
            for a in range(0, len(s) - 3, STEP):
                piece = s[a : a + STEP + 3]
                gathered.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= STEP:
                    flush()
                    size = 0
        flush()
        return -sums / np.maximum(counts, 1)[:, None], counts

    def predict(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, calibrated score in [0, 1], and whether the text is accepted."""
        bits, n = self.entropies(batch)
        best = bits.argmin(axis=1)
        score = 1 / (1 + np.exp(-np.clip(_features(bits, n) @ self.weights, -40, 40)))
        mean, spread = self.usual[best].T
        # a typical text of n characters lies within a few standard errors of its language's mean
        accepted = bits.min(axis=1) <= mean + 2.0 + 6 * spread / np.sqrt(np.maximum(n, 1))
        return best, score, accepted


def _features(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    ranked = np.sort(bits, axis=1)
    margin = ranked[:, 1] - ranked[:, 0] if bits.shape[1] > 1 else np.ones(len(bits))
    return np.column_stack([np.ones(len(bits)), margin, margin * np.log1p(n), -ranked[:, 0]])


def _count(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(values), return_counts=True) if values else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _order(runs: np.ndarray, counts: np.ndarray):
    """Discount, context totals and context fan-out of one order."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    contexts, at = np.unique(runs >> np.uint64(8), return_inverse=True)
    return discount, contexts, np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts))


def fit(samples: dict[str, list[str]]) -> LanguageModel:
    """Models of the languages of ``samples``; every fourth text is kept for calibration."""
    languages = sorted(samples)
    known = {l: [t for i, t in enumerate(samples[l]) if i % 4 != 3 or len(samples[l]) < 4] for l in languages}
    tally = np.zeros(0x110000, np.int64)
    for l in languages:
        for t in known[l]:
            points = np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)
            tally += np.bincount(points, minlength=len(tally)) if len(points) > 1e6 else 0
            if len(points) <= 1e6:
                np.add.at(tally, points, 1)
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([p for p in range(0x110000) if chr(p).isalpha()])
    table[letters] = 1
    common = letters[np.argsort(-tally[letters], kind="stable")][: SYMBOLS - 2]
    common = common[tally[common] > 0]
    table[common] = np.arange(2, 2 + len(common))

    per = []
    for l in languages:
        streams = [np.concatenate([np.zeros(2, np.uint8), _symbols(t, table)]) for t in known[l]]
        runs4, n4 = _count([_codes(s, 4) for s in streams if len(s) >= 4])
        runs3, n3 = np.unique(runs4 & np.uint64(0xFFFFFF), return_counts=True)  # continuations: distinct left neighbours
        runs2, n2 = np.unique(runs3 & np.uint64(0xFFFF), return_counts=True)
        runs1, n1 = np.unique(runs2 & np.uint64(0xFF), return_counts=True)
        per.append(((runs4, n4), (runs3, n3), (runs2, n2), (runs1, n1)))
    union = [np.unique(np.concatenate([p[k][0] for p in per] + [np.zeros(1, np.uint64)])) for k in range(4)]
    size = len(languages)
    logs2, back2 = np.zeros((65536, size), np.float32), np.zeros((65536, size), np.float32)
    contexts3 = np.unique(union[0] >> np.uint64(8))
    logs3, logs4, back3 = (np.zeros((len(x), size), np.float32) for x in (union[1], union[0], contexts3))
    for l, ((r4, n4), (r3, n3), (r2, n2), (r1, n1)) in enumerate(per):
        p1 = np.full(256, 0.5 / 256)
        p1[r1.astype(np.int64)] += 0.5 * n1 / max(n1.sum(), 1) if len(r1) else 0
        p1 /= p1.sum()
        every = np.arange(65536, dtype=np.uint64)

        def level(runs, counts, wanted, lower):
            discount, contexts, total, fan = _order(runs, counts)
            context = wanted >> np.uint64(8)
            t = _lookup(contexts, total, context)
            gamma = np.where(t > 0, discount * _lookup(contexts, fan, context) / np.maximum(t, 1), 1.0)
            return np.maximum(_lookup(runs, counts, wanted) - discount, 0) / np.maximum(t, 1) + gamma * lower, (discount, contexts, total, fan)

        def gammas(parts, context):
            discount, contexts, total, fan = parts
            t = _lookup(contexts, total, context)
            return np.log2(np.where(t > 0, discount * _lookup(contexts, fan, context) / np.maximum(t, 1), 1.0))

        p2, _ = level(r2, n2, every, p1[(every & np.uint64(0xFF)).astype(np.int64)])
        logs2[:, l] = np.log2(p2)
        c2 = np.arange(65536, dtype=np.uint64)
        p3, parts3 = level(r3, n3, union[1], p2[(union[1] & np.uint64(0xFFFF)).astype(np.int64)])
        logs3[:, l] = np.log2(p3)
        back2[:, l] = gammas(parts3, c2)
        low = union[0] & np.uint64(0xFFFFFF)
        p4, parts4 = level(r4, n4, union[0], p3[np.searchsorted(union[1], low)])
        logs4[:, l] = np.log2(p4)
        back3[:, l] = gammas(parts4, contexts3)
    model = LanguageModel(languages, table, union[0], logs4, contexts3, back3, union[1], logs3, back2, logs2)

    held = [(i, t) for i, l in enumerate(languages) for k, t in enumerate(samples[l]) if k % 4 == 3 or len(samples[l]) < 4]
    bits, n = model.entropies([t for _, t in held])
    truth = np.array([i for i, _ in held])
    right = (bits.argmin(axis=1) == truth).astype(float)
    model.weights = _logistic(_features(bits, n), right)
    usual = []
    for i in range(size):
        own = bits[(truth == i) & (right > 0) & (n >= 100), i]
        own = own if len(own) else bits[truth == i, i]
        usual.append((np.median(own), max(1.0, 10 * np.std(own))))
    model.usual = np.array(usual)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the ridge keeps it finite where every case is right."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """A model from about ``per_language`` labelled documents of each language, outside the held-out fold.

    Documents are picked by a hash of doc_id under a rate per language, so the sample
    doesn't depend on order or partitions. None if no document is labelled.
    """
    usable = texts(docs, F.col("lang").cast("string")).where((hash_fold() != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    rate = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, per_language / n)))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(chance < rate[F.col("lang")]).select("lang", "doc_id", "text").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return fit(samples)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``accepted`` behind its own columns.

    Null text or one without a letter: ``und``, score 0, not accepted. Without a model
    nothing can be rejected by it: every text with a letter is ``und``, score 0, and
    accepted. The prediction reads the text alone.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # at most 256^4 runs in theory; some 10^5 for a sample of bounded size
    schema = docs.select(*docs.columns).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [t if t and any(map(str.isalpha, t)) else None for t in part.column(at).to_pylist()]
                best, score, accepted = model.predict(found) if model else (np.zeros(len(found), int), np.zeros(len(found)), np.ones(len(found), bool))
                names = [model.languages[b] if t and model else "und" for b, t in zip(best, found)]
                has = np.array([t is not None for t in found])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(accepted & has)],
                    names=[*part.schema.names, "lang_pred", "score", "accepted"],
                )

    return docs.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean"))


def identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with their own columns, whatever those are called."""
    shown = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index("text")
    kept = identify(shown.withColumnRenamed(f"c{at}", "text"), model).where("accepted")
    return kept.select(*("text" if i == at else f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every document, the model trained on the others.

    lang, source and doc_id are no inputs of a prediction. Repeated rows get equal
    answers; a null doc_id counts as the empty string for the fold.
    """
    model = train(docs, per_language)
    rows = identify(texts(docs).select("doc_id", "text", (hash_fold() == 2).alias("held_out")), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "accepted")
