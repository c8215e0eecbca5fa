"""Brute-force versions and odd inputs for the operators of the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, hash long, g int, bucket int, row string, n long, part int, kept string"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def odd_documents(seed: int = 0) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows; the last columns only clash in name."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, long = say(150), say(40), say(30_000)
    near = base.split()
    near[70] = "changed"
    edited = base.split()
    edited[20:24] = ["quite", "another", "run", "here"]
    texts = [
        (0, base), (1, " ".join(near)), (2, base.upper()), (3, "  " + base.replace(" ", "\n\t")), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, "one two"),
        (10, passage + " " + say(60)), (11, say(50) + " " + passage), (12, say(30) + " " + passage + " " + say(30) + " " + passage), (13, long), (14, say(5) + " " + long), (15, "er. " * 400),
        (16, "-" * 700), (17, "日本語の文" * 80), (17, "日本語の文" * 80), (18, " ".join(edited)), (None, base), (None, say(80)), (None, None), (20, "<|endoftext|> and <|im_start|>"), (21, "1234 !!! ..."),
        (-3, say(20) + " " + passage), (22, base + " " + base), (23, say(8)), (24, passage[:100]),
    ]
    langs, sources = ["en", "fr", None], ["a", "b", None, "é"]
    return [(i, t, langs[k % 3], sources[k % 4], None if k % 5 == 0 else len(t or ""), 1, 2, 3, 4, "x", 5, 6, "y") for k, (i, t) in enumerate(texts)]


def passages(docs: list[tuple], window: int = 13) -> dict:
    """op6 of (doc_id, text) with distinct ids."""
    last = float("inf")
    first: dict[tuple, float] = {}
    split = {i: words(t) for i, t in docs}
    key = lambda i: last if i is None else i
    for i, w in split.items():
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, last), key(i))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < key(i):
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def repeats(docs: list[tuple], window: int = 100) -> dict:
    """op8 of (doc_id, text) with distinct ids, in order of doc_id, null last; also the mask of removed bytes."""
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            else:
                seen.add(w)
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)), gone)
    return out


def components(docs: list[tuple], k: int = 3) -> dict:
    """op1 of (doc_id, text) with distinct ids that aren't null."""
    sets = {}
    for i, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
