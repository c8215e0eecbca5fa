"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers split the same bytes. A byte offset where a token of each ends is a
shared cut. An interval of both token sequences is cut at a common end near its middle,
found by bisect, and both halves are cut in the same way; an interval without an inner
common end is a group. All intervals of a batch of texts are worked on at once, level by
level, so the recursion is a few numpy steps per level and not a call per group.

The two tokens that end at a cut are linked. How often an id pair is linked in the whole
corpus is counted per group of documents first, then by pair; a group of documents gets
each of its distinct pairs answered once.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsieve.llm import bpe
from chainsieve.llm.common import cut_lineage, texts
from chainsieve.llm.groups import bytes_of, pack_sorted, unpack_sorted

#: Bytes of text that are cut at once, characters that a remembered word has at most, bytes of all remembered words.
STEP, SHORT, MEMORY = 1 << 19, 48, 96 << 20
#: Links of a group of documents that are answered together, about.
GROUP_LINKS = 2 << 20
#: Places next to the middle that are tried one by one, before all of an interval are.
TRIES = 4

SPACED = re.compile(r" +[^ ]*")
STATS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteTokens:
    """A: byte-level BPE of a space and the text; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        self.model = bpe.Transducer(path)
        self.size = self.model.size
        self.bytes = [self.model.bytes_of.get(i, b"") for i in range(self.size)]
        ids = self.model.ids
        made = [ids[a + b] for a, b in sorted(self.model.ranks, key=self.model.ranks.get)]
        plain = {b: i for b, i in ids.items() if b.decode("utf-8", "replace") not in self.model.added}
        # merges in order of their ids: the library that ranks merges by id then makes the same ones
        self.fast = tiktoken.Encoding("plain", pat_str=bpe.SPLIT, mergeable_ranks=plain, special_tokens={}) if made == sorted(made) else None

    def encode(self, spaced: str) -> np.ndarray:
        if self.fast and len(spaced) <= bpe.WINDOW:
            return np.array(self.fast.encode_ordinary(spaced), np.int32)
        return np.array([i for found in self.model.pieces(spaced) for p in found for i in self.model.merge(p.encode())], np.int32)


class PieceTokens:
    """B: sentence pieces of the text, to which the model adds a space.

    Where no piece has a space behind another character, no merge crosses from a word
    to the space behind it, so words are encoded, and remembered, one by one.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _words(self, text: str) -> list[str]:
        """The words of a text, each without the one space in front of it."""
        words = text.split(" ")
        return [w[1:] for w in SPACED.findall(" " + text)] if "" in words else words

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words; none where the normalizer changes a word."""
        for word, ids in zip(words, self.model.encode(words, num_threads=1)):
            if not word:  # a lone space, to which the model adds none
                ids = [self.model.piece_to_id("▁")]
            if b"".join([self.bytes[i] for i in ids]) != b" " + word.encode():
                ids = []
            self.known[word] = array("i", ids).tobytes()
            self.held += 200 + len(word)

    def _whole(self, text: str) -> np.ndarray:
        ids = self.model.encode(text)
        same = b"".join([self.bytes[i] for i in ids]) == b" " + text.encode()
        return np.array(ids if same else [], np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; none of a text that doesn't come back the same."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        if self.held > MEMORY:
            self.known, self.held = {}, 0
        known, split = self.known, [self._words(t) for t in texts]
        new = list(set().union(*split).difference(known))
        self._learn(new)
        out = []
        for text, words in zip(texts, split):
            found = [known[w] for w in words]
            out.append(np.frombuffer(b"".join(found), np.int32) if all(found) else self._whole(text))
        for word in new:
            if len(word) > SHORT:
                self.held -= 200 + len(word)
                del known[word]
        return out


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    """One pair per worker process."""
    return ByteTokens(a), PieceTokens(b)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of A and of B) at all shared cuts, ascending.

    ``ends`` ascend over all texts of a batch; ``last`` are the numbers of each text's
    last tokens, which end together.
    """
    found = [(last_a, last_b)]
    lo_a, hi_a = np.append(0, last_a[:-1] + 1), last_a.copy()  # tokens lo..hi, of which hi ends at a cut
    lo_b, hi_b = np.append(0, last_b[:-1] + 1), last_b.copy()
    while True:
        inner = np.flatnonzero((hi_a > lo_a) & (hi_b > lo_b))
        if not len(inner):
            break
        lo_a, hi_a, lo_b, hi_b = lo_a[inner], hi_a[inner], lo_b[inner], hi_b[inner]
        at_a, at_b = np.full(len(inner), -1), np.full(len(inner), -1)
        middle, todo = (lo_a + hi_a - 1) >> 1, np.arange(len(inner))
        for k in range(TRIES):
            step = (k + 1) // 2 * (1 if k % 2 else -1)
            tried = middle[todo] + step
            place = np.searchsorted(ends_b, ends_a[tried])
            hit = (ends_b[place] == ends_a[tried]) & (tried >= lo_a[todo]) & (tried < hi_a[todo])
            at_a[todo[hit]], at_b[todo[hit]] = tried[hit], place[hit]
            todo = todo[~hit]
            if not len(todo):
                break
            todo = todo[(hi_a - lo_a)[todo] > k + 1]
        if len(todo):  # the rest of these intervals, by distance from the middle
            n = (hi_a - lo_a)[todo]
            of = np.repeat(np.arange(len(todo)), n)
            tried = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo_a[todo][of]
            place = np.searchsorted(ends_b, ends_a[tried])
            hit = np.flatnonzero(ends_b[place] == ends_a[tried])
            hit = hit[np.lexsort((np.abs(tried[hit] - middle[todo][of[hit]]), of[hit]))]
            hit = hit[np.diff(of[hit], prepend=-1) != 0]
            at_a[todo[of[hit]]], at_b[todo[of[hit]]] = tried[hit], place[hit]
        cut = at_a >= 0
        found.append((at_a[cut], at_b[cut]))
        lo_a, hi_a = np.concatenate([lo_a[cut], at_a[cut] + 1]), np.concatenate([at_a[cut], hi_a[cut]])
        lo_b, hi_b = np.concatenate([lo_b[cut], at_b[cut] + 1]), np.concatenate([at_b[cut], hi_b[cut]])
    a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    order = np.argsort(a)
    return a[order], b[order]


@dataclass
class Aligned:
    """A batch of texts: per text the number of tokens and cuts; ids and cuts of all texts, one after another."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_cuts: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = tokenizers(a, b)
        self.wide_a, self.wide_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        # decimal ids with what may stand behind them: "," within a side; "|" behind A's side, ";" behind B's
        self.shown = [f"{i}{s}" for i in range(self.a.size) for s in ",|"] + [f"{i}{s}" for i in range(self.b.size) for s in ",;"]

    def ids(self, batch: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, np.int32)
        out = []
        for text, b in zip(batch, self.b.encode([t or "" for t in batch])):
            a = self.a.encode(" " + text) if text and len(b) else none
            out.append((a, b) if len(a) and self.wide_a[a].sum() == self.wide_b[b].sum() else (none, none))
        return out

    def align(self, batch: list[str | None]) -> Aligned:
        pairs = self.ids(batch)
        n_a, n_b = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int32) for i in (0, 1))
        full = n_a > 0
        last_a, last_b = np.cumsum(n_a)[full] - 1, np.cumsum(n_b)[full] - 1
        cut_a, cut_b = shared_cuts(np.cumsum(self.wide_a[a]), np.cumsum(self.wide_b[b]), last_a, last_b) if full.any() else (last_a, last_b)
        n_cuts = np.diff(np.searchsorted(cut_a, np.append(0, np.cumsum(n_a))))
        return Aligned(n_a, n_b, n_cuts, a, b, cut_a, cut_b)

    def groups(self, x: Aligned) -> Iterator[str]:
        """The groups of each text: ids of A joined by commas, "|", those of B; groups joined by ";"."""
        side_a, side_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        side_a[x.cut_a], side_b[x.cut_b] = 1, 1
        group_a, group_b = np.cumsum(side_a) - side_a, np.cumsum(side_b) - side_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        codes = np.concatenate([2 * x.a + side_a, 2 * (self.a.size + x.b) + side_b])[order]
        at = 0
        for n in (x.n_a + x.n_b).tolist():
            yield "".join(map(self.shown.__getitem__, codes[at : at + n].tolist()))[:-1]
            at += n

    def links(self, x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's distinct linked pairs, as a * size of B + b, and how often it links them."""
        code = x.a[x.cut_a].astype(np.uint64) * np.uint64(self.b.size) + x.b[x.cut_b].astype(np.uint64)
        for own in np.split(code, np.cumsum(x.n_cuts)[:-1]):
            yield np.unique(own, return_counts=True)


def _batches(table: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows with about STEP bytes of text."""
    sizes = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in table.column(1)])
    a = 0
    while a < table.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + STEP, "right")))
        part = table.slice(a, b - a)
        yield part, part.column(1).to_pylist()
        a = b


def align_documents(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, a, b, cuts``: ids by both tokenizers, and the number of tokens of A and of B before each cut.

    A text that is null, empty, or not the same bytes in both tokenizers has no tokens.
    """
    paths = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for batch in batches:
            for part, own in _batches(batch):
                x = aligner.align(own)
                at = [np.append(0, np.cumsum(n)) for n in (x.n_a, x.n_b, x.n_cuts)]
                before = [np.repeat(o[:-1], x.n_cuts) for o in at[:2]]
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((at[0], x.a), (at[1], x.b))]
                cuts = pa.StructArray.from_arrays([pa.array(c - o + 1, pa.int32()) for c, o in zip((x.cut_a, x.cut_b), before)], names=["a", "b"])
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.ListArray.from_arrays(pa.array(at[2], pa.int32()), cuts)], names=["doc_id", "a", "b", "cuts"])

    return texts(docs).mapInArrow(run, "doc_id long, a array<int>, b array<int>, cuts array<struct<a int, b int>>")


def _aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in batches:
            for part, own in _batches(batch):
                x = aligner.align(own)
                shown = [hashlib.sha256(s.encode()).hexdigest() if n else "" for s, n in zip(aligner.groups(x), x.n_a.tolist())]
                links = list(aligner.links(x))
                columns = [x.n_a, x.n_b, x.n_cuts, x.n_cuts, shown, [pack_sorted(p) for p, _ in links], [_small(t) for _, t in links]]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return texts(docs).mapInArrow(run, STATS)


def _small(counts: np.ndarray) -> bytes:
    """Counts in the least of 1, 2, 4 or 8 bytes each, after that width."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _counts(raw: np.ndarray) -> np.ndarray:
    return raw[1:].view(f"<u{raw[0]}") if raw[0] == 1 else np.frombuffer(raw[1:].tobytes(), f"<u{raw[0]}")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts, and the row of each, of a group's documents."""
    pairs = [unpack_sorted(bytes_of(p)) for p in table.column("pairs")]
    times = [_counts(bytes_of(t)) for t in table.column("times")]
    rows = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    return np.concatenate([np.zeros(0, np.uint64), *pairs]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *times]).astype(np.int64), rows


def _pairs_of_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    pairs, times, _ = _unpacked(table)
    distinct, at = np.unique(pairs, return_inverse=True)
    n = np.zeros(len(distinct), np.int64)
    np.add.at(n, at, times)
    return pa.table({"g": pa.array(np.full(len(distinct), key[0].as_py(), np.int32)), "pair": distinct, "n": n})


def _with_counts(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    pairs, times, rows = _unpacked(left)
    told = right.sort_by("pair")
    at = np.searchsorted(told.column("pair").to_numpy(), pairs)
    total, best = told.column("total").to_numpy(), told.column("best").to_numpy(zero_copy_only=False)
    sums = [np.zeros(left.num_rows, np.int64) for _ in range(2)]
    if len(pairs):
        np.add.at(sums[0], rows, times * best[at])
        np.add.at(sums[1], rows, times * total[at])
    keep = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(keep | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": left.column("groups_sha256")})


def _counted(aligned: DataFrame, n: int, size_b: int) -> tuple[DataFrame, DataFrame]:
    """Documents by group; and each group's distinct pairs with their corpus count, and whether it is the highest of their B id."""
    dealt = aligned.withColumn("g", F.pmod(F.xxhash64("doc_id", "groups_sha256", "pairs"), F.lit(n)).cast("int"))
    asked = dealt.groupBy("g").applyInArrow(_pairs_of_group, "g int, pair long, n long")
    told = asked.withColumn("total", F.sum("n").over(Window.partitionBy("pair"))).withColumn("b", F.col("pair") % size_b)
    highest = told.groupBy("b").agg(F.max("total").alias("highest"))  # one row per id of B at most
    return dealt, told.join(F.broadcast(highest), "b").select("g", "pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def alignment_counts(docs: DataFrame, vocabularies: tuple[str, str] | None = None, group_links: int = GROUP_LINKS) -> DataFrame:
    """Per row of ``docs``: how its two tokenizations align, and how usual its links are in the corpus.

    doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair count is the
    highest of their B id, ties included), count_sum (pair counts, summed over links) and
    groups_sha256. A text that is null, empty, or differs in bytes after either tokenizer
    (normalization) has zeros and an empty digest. Repeated rows are counted and returned
    each; other columns are not read. Texts are tokenized once: their packed links are
    checkpointed, dealt to groups of about ``group_links`` links, and answered per group.
    """
    paths = vocabularies or default_vocabularies()
    aligned = cut_lineage(_aligned(docs, paths))
    links = aligned.agg(F.sum("n_links")).first()[0] or 0
    dealt, told = _counted(aligned, max(1, math.ceil(links / group_links)), tokenizers(*paths)[1].size)
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_with_counts, RESULT)


def pair_counts(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``a_id, b_id, count``: how many links of the corpus hold each pair of ids."""
    paths = vocabularies or default_vocabularies()
    size = tokenizers(*paths)[1].size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, _ = _unpacked(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([pa.array(pairs // size, pa.int32()), pa.array(pairs % size, pa.int32()), pa.array(times)], names=["a_id", "b_id", "n"])

    return _aligned(docs, paths).select("pairs", "times").mapInArrow(run, "a_id int, b_id int, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("count"))
