"""Substring dedup over words: passages that an earlier document has already are cut.

Fixed-block anchors: every document is cut into non-overlapping blocks of 7 words,
the reference index; every rolling window of 7 words probes it. A run of 13 words
that two documents share holds a whole block of either, so each shared run shows up
as a hit. Hits are then extended: the 13-word windows around them are compared as a
whole, wherever they lie, and neighbouring windows join to maximal exact repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.common import buffers, gram_hashes, steps, whole_grams, word_bounds, word_hashes
from chainsieve.llm.groups import ASKED, TOLD, Asked, answers, bytes_of, digests, distinct_with_flags, doc_ids, each_group, grouped, questions, shared_values, with_answers

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,words:int>>"
#: Words per byte of text, about.
DENSITY = 1 / 6


class _Words:
    """Words of a group's documents and their hashes."""

    def __init__(self, table: pa.Table):
        self.ids = doc_ids(table)
        self.raw, self.offsets = buffers(table.column("text"))
        bounds, hashes = [], []
        for a, b in steps(self.offsets):
            base = self.offsets[a]
            raw = self.raw[base : self.offsets[b]]
            starts, ends, before = word_bounds(raw, self.offsets[a : b + 1] - base)
            bounds.append((starts + base, ends + base, before))
            hashes.append((word_hashes(raw, starts, ends), word_hashes(raw, starts, ends, 1)))
        none = np.zeros(0, np.int64)
        self.starts = np.concatenate([x[0] for x in bounds] or [none])
        self.ends = np.concatenate([x[1] for x in bounds] or [none])
        self.before = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in bounds] or [none]))]).astype(np.int64)
        self.h = [np.concatenate([x[i] for x in hashes] or [np.zeros(0, np.uint64)]) for i in (0, 1)]
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.before))

    def windows(self, k: int) -> np.ndarray:
        """First words of the runs of k words inside one document."""
        return np.flatnonzero(whole_grams(self.before, k))


def _probes(w: _Words, block: int, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    at = w.windows(block)
    return at, asked.cut(gram_hashes(w.h[0], block)[at])


def _ask(block: int, asked: Asked):
    def work(g: int, table: pa.Table) -> pa.Table:
        w = _Words(table)
        at, cuts = _probes(w, block, asked)
        anchored = (at - w.before[w.doc[at]]) % block == 0
        # equal doc_ids are one owner: no document repeats itself
        owner = np.unique(w.ids, return_inverse=True)[1][w.doc[at]] if len(at) else at
        return questions(asked, g, *distinct_with_flags(cuts, owner, anchored))

    return work


def _windows(w: _Words, at: np.ndarray, window: int):
    """The windows at ``at`` in order of their 128-bit hash, and where each distinct one begins."""
    a, b = gram_hashes(w.h[0], window)[at], gram_hashes(w.h[1], window, 1)[at]
    order = np.lexsort((at, b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a, b, order, np.flatnonzero(new)


def _extend(block: int, window: int, asked: Asked):
    """Asks about the distinct windows around hits, and keeps a note for the group itself of where they are."""

    def work(g: int, table: pa.Table, told: pa.Table) -> pa.Table:
        w = _Words(table)
        probe, cuts = _probes(w, block, asked)
        values, back = np.unique(cuts, return_inverse=True)
        hit = answers(told, asked, values)[back] if len(values) else np.zeros(0, bool)
        near = np.zeros(len(w.doc) + 1, np.int32)
        np.add.at(near, np.maximum(probe[hit] - (window - block), 0), 1)
        np.add.at(near, probe[hit] + 1, -1)
        at = w.windows(window)
        at = at[np.cumsum(near)[at] > 0]
        edge = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        note = np.concatenate([at[edge], np.diff(np.append(edge, len(at)))]).astype(np.int64).tobytes()
        a, b, order, first = _windows(w, at, window)
        doc = w.doc[at[order]][first]  # documents are in order, so the first one is the smallest
        a, b = a[first], b[first]
        top = np.searchsorted(a >> np.uint64(64 - asked.top), np.arange(asked.buckets + 1, dtype=np.uint64)) if asked.top else np.array([0, len(a)])
        rows = [(-1 - g, note)]
        for k in np.flatnonzero(top[1:] > top[:-1]):
            s = slice(top[k], top[k + 1])
            ids, index = np.unique(w.ids[doc[s]], return_inverse=True)
            small = np.uint16 if len(ids) < 1 << 16 else np.uint32
            head = np.array([len(ids), top[k + 1] - top[k]], np.int64)
            parts = (head, ids, a[s], (b[s] >> np.uint64(32)).astype(np.uint32), index.astype(small))
            rows.append((int(k), b"".join(x.tobytes() for x in parts)))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "g": pa.array([g] * len(rows), pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return work


def _earlier(table: pa.Table) -> pa.Table:
    """One bit per window asked: a smaller document outside the group has it. Notes pass through."""
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        return table.select(["g", "bucket", "payload"])
    got = []
    for x in table.column("payload"):
        raw = bytes_of(x)
        n_ids, n = raw[:16].view(np.int64)
        at = 16 + 8 * n_ids
        ids = raw[16:at].view(np.int64)
        a = raw[at : at + 8 * n].view(np.uint64)
        b = raw[at + 8 * n : at + 12 * n].view(np.uint32)
        index = raw[at + 12 * n :].view(np.uint16 if n_ids < 1 << 16 else np.uint32)
        got.append((a, b, ids[index]))
    lengths = [len(x[0]) for x in got]
    a, b, ids = (np.concatenate([x[i] for x in got]) for i in range(3))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(first, append=len(a)))
    answer = np.zeros(len(a), bool)
    answer[order] = least < ids[order]
    bits = [np.packbits(x).tobytes() for x in np.split(answer, np.cumsum(lengths)[:-1])]
    return pa.table({"g": table.column("g").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array(bits, pa.binary())})


def _cut(window: int, asked: Asked):
    def work(g: int, table: pa.Table, told: pa.Table) -> pa.Table:
        w = _Words(table)
        said = dict(zip(told.column("bucket").to_pylist(), told.column("payload")))
        note = bytes_of(said[-1 - g]).view(np.int64) if -1 - g in said else np.zeros(0, np.int64)
        first, length = note[: len(note) // 2], note[len(note) // 2 :]
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
        a, b, order, new = _windows(w, at, window)
        outside = np.zeros(len(new), bool)
        top = np.searchsorted(a[new] >> np.uint64(64 - asked.top), np.arange(asked.buckets + 1, dtype=np.uint64)) if asked.top else np.array([0, len(new)])
        for k, payload in said.items():
            if k >= 0:
                outside[top[k] : top[k + 1]] = np.unpackbits(bytes_of(payload), count=int(top[k + 1] - top[k])).astype(bool)
        times = np.diff(new, append=len(a))
        ids = w.ids[w.doc[at[order]]]
        gone = at[order][np.repeat(outside, times) | (ids > np.repeat(ids[new], times))] if len(at) else at
        cover = np.zeros(len(w.doc) + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        removed = np.cumsum(cover)[:-1] > 0
        return _report(w, removed)

    return work


def _report(w: _Words, removed: np.ndarray) -> pa.Table:
    n = np.diff(w.before)
    gone = np.concatenate([[0], np.cumsum(removed)])
    kept = np.flatnonzero(~removed)
    last = np.ones(len(kept), bool)
    last[:-1] = w.doc[kept[1:]] != w.doc[kept[:-1]]
    edge = np.zeros(len(w.raw) + 1, np.int8)
    edge[w.starts[kept]] += 1
    edge[w.ends[kept]] -= 1
    keep = np.cumsum(edge, dtype=np.int8)[:-1] > 0
    space = w.ends[kept[~last]]
    out = w.raw.copy()
    out[space] = 32
    keep[space] = True
    bounds = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
    start = removed.copy()
    if len(removed):
        start[1:] &= ~removed[:-1] | (w.doc[1:] != w.doc[:-1])
    end = removed.copy()
    if len(removed):
        end[:-1] &= ~removed[1:] | (w.doc[1:] != w.doc[:-1])
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    spans = pa.StructArray.from_arrays([pa.array((s - w.before[w.doc[s]]).astype(np.int32)), pa.array((e - s).astype(np.int32))], names=["first", "words"])
    where = np.searchsorted(s, w.before).astype(np.int32)
    return pa.table(
        {
            "doc_id": pa.array(w.ids, pa.int64(), mask=w.ids == np.int64((1 << 63) - 1)),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(gone[w.before[1:]] - gone[w.before[:-1]], pa.int64()),
            "kept_sha256": pa.array(list(digests(out[keep], bounds)), pa.string()),
            "spans": pa.ListArray.from_arrays(pa.array(where), spans),
        }
    )


def dedup_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """Words of every document that a window of ``window`` words shares with a smaller doc_id, and what is left.

    Returns doc_id, n_words, n_removed, kept_sha256 and the removed spans (first word,
    number of words). Null and empty texts have no words. A null doc_id counts as the
    largest; rows with one doc_id don't cut each other. Other columns are not read.
    """
    block = (window + 1) // 2
    groups = grouped(docs)
    asked = Asked.of(groups, DENSITY, 7)
    probes = each_group(groups.docs, _ask(block, asked), ASKED)
    hits = probes.groupBy("bucket").applyInArrow(shared_values, TOLD)
    windows = with_answers(groups.docs, hits, _extend(block, window, asked), ASKED)
    repeats = windows.groupBy("bucket").applyInArrow(_earlier, TOLD)
    return with_answers(groups.docs, repeats, _cut(window, asked), RESULT)


#: The same rows in DuckDB, window by window.
PASSAGES_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words)),
firsts AS (SELECT t, min(doc_id) AS first_doc FROM windows GROUP BY t),
cut AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM windows JOIN firsts USING (t) WHERE first_doc < doc_id),
parts AS (
  SELECT p.doc_id, p.i, p.word, c.i IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words) p LEFT JOIN cut c ON p.doc_id = c.doc_id AND p.i = c.i),
summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM parts GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN summed s USING (doc_id)
"""
