"""Cross-tokenizer alignment against the two libraries and brute force."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from chainsieve.llm import alignment  # noqa: E402

ODD = ["  a  b ", "\n x", "foo\n  bar", "日本語  の▁文", "<s> </s> <0x41> <unk>", "é ﬁ ½", " x　y", "\t\t a", "a" * 3000, " ", "   ", "▁", "á b\r\n c", "x ̈y", "word" + " " * 70 + "end  "]


def brute(docs):
    """The query's rows by both libraries, sets of offsets and counters."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    wide_a = lambda i: len(a.id_to_token(i))  # noqa: E731  a character of an entry stands for a byte
    done, count = [], Counter()
    for i, text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = b"".join(bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)])
        if not text or raw != (" " + text).encode():
            done.append((i, [], [], []))
            continue
        sizes = [1 if b.is_byte(x) else len(b.id_to_piece(x).replace("▁", " ").encode()) for x in ids_b]
        ends_a, ends_b = np.cumsum([wide_a(x) for x in ids_a]).tolist(), np.cumsum(sizes).tolist()
        links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in sorted(set(ends_a) & set(ends_b))]
        count.update(links)
        groups, x, y = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, ids_a[x:p])) + "|" + ",".join(map(str, ids_b[y:q])))
            x, y = p, q
        done.append((i, ids_a, ids_b, links, ";".join(groups)))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [
        (i, len(a_), len(b_), len(links), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(s[0].encode()).hexdigest() if s else "")
        for i, a_, b_, links, *s in done
    ]


def key(r):
    return (r[0] is None, *map(str, r))


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in H.odd_documents() if len(r[1] or "") < 20_000] + [(100 + i, t) for i, t in enumerate(ODD)]


def test_counts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit("x")).withColumn("pairs", F.lit(1)).repartition(4)
    got = alignment.alignment_counts(docs, group_links=500)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)
    whole = alignment.alignment_counts(docs.coalesce(1))
    assert sorted(map(tuple, whole.collect()), key=key) == sorted(map(tuple, got.collect()), key=key)


def test_empty(spark):
    none = spark.createDataFrame([], H.DOCS)
    assert alignment.alignment_counts(none).collect() == [] and alignment.align_documents(none).collect() == [] and alignment.pair_counts(none).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.alignment_counts(blank).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)}


def test_outputs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aligner = alignment.Aligner(*alignment.default_vocabularies())
    texts = {str(i): " " + (t or "") for i, t in rows}
    for r in alignment.align_documents(docs).collect():
        x = y = 0
        for c in r.cuts:
            assert b"".join(aligner.a.bytes[i] for i in r.a[x : c.a]) == b"".join(aligner.b.bytes[i] for i in r.b[y : c.b])
            x, y = c.a, c.b
        if r.cuts and r.doc_id is not None:
            assert (x, y) == (len(r.a), len(r.b)) and b"".join(aligner.a.bytes[i] for i in r.a).decode() == texts[str(r.doc_id)]
    want = {r.doc_id: r.count_sum for r in alignment.alignment_counts(docs.where("doc_id = 0")).collect()}
    assert sum(r["count"] ** 2 for r in alignment.pair_counts(docs.where("doc_id = 0")).collect()) == want[0]


@pytest.mark.parametrize("seed", range(20))
def test_cuts(seed):
    """All common ends are found, also in long intervals that have none but at their edge."""
    rng = random.Random(seed)
    ends_a, ends_b, last_a, last_b, at = [], [], [], [], 0
    for _ in range(rng.randint(1, 6)):
        size = rng.randint(1, 4000)
        for ends, last in ((ends_a, last_a), (ends_b, last_b)):
            ends += sorted({at + size, *(at + rng.randint(1, size) for _ in range(rng.choice([0, 3, 300, 3000])))})
            last.append(len(ends) - 1)
        at += size
    a, b = alignment.shared_cuts(*(np.array(x) for x in (ends_a, ends_b, last_a, last_b)))
    assert np.array(ends_a)[a].tolist() == np.array(ends_b)[b].tolist() == sorted(set(ends_a) & set(ends_b))
