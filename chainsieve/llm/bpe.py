"""Byte-pair encoding and decoding as streaming transducers.

Encoding keeps a buffer of bytes. The merge list has a sufficient lookahead: a
number of bytes beyond which no further input can change a token. Tokens that end
that far before the end of the buffer are stable; they are emitted and forgotten, so
memory stays constant however long the input is. Decoding is a state machine from
token bytes to text that holds at most one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chainsieve.llm.common import texts

# Fixed values of byte-level BPE: the split pattern, and the characters that stand for bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Remembered pieces of text per worker, and characters that are split at once.
MEMORY, WINDOW = 400_000, 1 << 18


def byte_characters() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_characters()
        as_bytes = lambda token: bytes(of[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((as_bytes(a), as_bytes(b)), rank)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.size = max(self.bytes_of) + 1
        self.single = [self.ids.get(bytes([b]), 0) for b in range(256)]
        self.pairs = {self.ids[a] * self.size + self.ids[b]: rank for (a, b), rank in self.ranks.items()}
        self.made = {rank: self.ids[a + b] for (a, b), rank in self.ranks.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = regex.compile(SPLIT)
        self.lookahead = self._lookahead()
        self.known: dict[str, str] = {}
        self.shown = {str(i): b for i, b in self.bytes_of.items()}

    def _lookahead(self) -> int:
        """Bytes behind a token that can still change it.

        The right part v of a merge (u, v) at rank r is disturbed only by a merge of
        an earlier rank whose left part lies on the right edge of v, and that one
        only by still earlier merges on its own right edge. Ranks fall along such a
        chain, so going through the merges in order of rank, and keeping for each
        left part the longest reach so far, gives the longest chain.
        """
        reach: dict[bytes, int] = {}
        made: dict[bytes, tuple[bytes, int]] = {}  # token: its right part, and the reach of the merge that makes it
        longest = 0
        for (a, b), _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            need, edge = 0, b
            while True:
                need = max(need, reach.get(edge, 0))
                if edge not in made:
                    break
                edge, own = made[edge]
                need = max(need, own)
            made.setdefault(a + b, (b, need))
            reach[a] = max(reach.get(a, 0), len(b) + need)
            longest = max(longest, len(b) + need)
        return longest + max(map(len, self.ids))

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a whole piece: the lowest rank first, the leftmost of equals first."""
        single, pairs, made, size, none = self.single, self.pairs, self.made, self.size, 1 << 60
        parts = [single[b] for b in data]
        ranks = [pairs.get(a * size + b, none) for a, b in zip(parts, parts[1:])]
        if len(parts) < 100:
            while ranks and (rank := min(ranks)) != none:
                i = ranks.index(rank)
                parts[i : i + 2] = [new] = [made[rank]]
                del ranks[i]
                if i:
                    ranks[i - 1] = pairs.get(parts[i - 1] * size + new, none)
                if i < len(ranks):
                    ranks[i] = pairs.get(new * size + parts[i + 1], none)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(ranks) if r != none]
        ranks.append(none)
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:  # one of the two has merged with something else
                continue
            new, j = made[rank], after[i]
            parts[i], parts[j], ranks[j] = new, -1, none
            k = after[i] = after[j]
            ranks[i] = none
            if k < n:
                before[k] = i
                if (r := pairs.get(new * size + parts[k], none)) != none:
                    ranks[i] = r
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0:
                ranks[h] = pairs.get(parts[h] * size + new, none)
                if ranks[h] != none:
                    heapq.heappush(heap, (ranks[h], h))
        return [p for p in parts if p >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that comes in chunks; holds a few lookaheads of bytes."""
        held = b""
        for chunk in chunks:
            held += chunk
            if len(held) < 4 * self.lookahead:
                continue
            stable, done = len(held) - self.lookahead, 0
            for token in self.merge(held):
                if done + len(self.bytes_of[token]) > stable:
                    break
                yield token
                done += len(self.bytes_of[token])
            held = held[done:]
        if held:
            yield from self.merge(held)

    def piece(self, text: str) -> str:
        """Decimal ids of a piece, joined by commas."""
        step = 2 * self.lookahead
        if len(text) <= step:
            tokens: Iterable[int] = self.merge(text.encode())
        else:
            tokens = self.stream(text[i : i + step].encode() for i in range(0, len(text), step))
        return ",".join(map(str, tokens))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in lists; each looks no further than one window unless a piece is longer."""
        at, n = 0, len(text)
        while at < n:
            found = self.split.findall(text, at, min(n, at + WINDOW))
            if at + WINDOW < n:  # the end of the window may have cut a piece
                found = found[:-3] or [self.split.match(text, at).group()]
            at += sum(map(len, found))
            yield found

    def encode(self, text: str) -> Iterator[str]:
        """Runs of decimal ids joined by commas, in order."""
        known, start = self.known, 0
        marks = list(self.special.finditer(text)) if self.special and "<|" in text else []
        for mark in [*marks, None]:
            plain = text[start : mark.start() if mark else len(text)] if marks else text
            for found in self.pieces(plain):
                if len(known) > MEMORY:
                    known.clear()
                try:
                    yield ",".join([known[p] for p in found])
                except KeyError:
                    for p in found:
                        if p not in known and len(p) <= 64:
                            known[p] = self.piece(p)
                    yield ",".join([known.get(p) or self.piece(p) for p in found])
            if mark:
                yield str(self.added[mark.group()])
                start = mark.end()

    def decode(self, runs: Iterable[str]) -> Iterator[str]:
        """Text of runs of decimal ids; invalid bytes become U+FFFD, as each is told apart from an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for run in runs:
            yield machine.decode(b"".join([self.shown[i] for i in run.split(",")]))
        yield machine.decode(b"", True)


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every document as an array; null text gives no ids."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [[int(i) for run in t.encode(text or "") for i in run.split(",")] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                shown = ["".join(t.decode([",".join(map(str, ids))] if ids else [])) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shown, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids and of the text decoded from them.

    Null or empty text: no tokens, and the digests of nothing. Digests are fed run by
    run, so a document's ids and decoded text are never held whole. Repeated rows give
    repeated rows; other columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def digests(t: Transducer, text: str) -> tuple[int, str, str]:
        n, ids, shown = 0, hashlib.sha256(), hashlib.sha256()

        def runs() -> Iterator[str]:
            nonlocal n
            for run in t.encode(text):
                ids.update((("," if n else "") + run).encode())
                n += run.count(",") + 1
                yield run

        for piece in t.decode(runs()):
            shown.update(piece.encode())
        return n, ids.hexdigest(), shown.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows = [digests(t, text.as_py() or "") for text in part.column(1)]
                n, ids, shown = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
