"""Operators use all rows where an earlier version used a part of them."""

import os
import random
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers as H  # noqa: E402
import pyarrow.compute  # noqa: E402

from chainsieve.llm import language, quality, suffixes  # noqa: E402
from chainsieve.llm.common import buffers, lower_ascii, word_bounds, word_hashes  # noqa: E402
from chainsieve.llm.groups import Asked, Groups, in_order, shared_values  # noqa: E402


def hashes(word):
    raw, offsets = buffers(pa.array([word]))
    starts, ends, _ = word_bounds(raw, offsets)
    return word_hashes(lower_ascii(raw), starts, ends)


def test_words_of_unlabelled_documents_reach_the_text_view(spark):
    rng = random.Random(1)
    say = lambda words: " ".join(rng.choice(words) for _ in range(12))
    common, rows, marks = [f"w{i}" for i in range(40)], [], []
    for i in range(1600):  # labelled: the source tells the class, the words say little
        good = i % 2
        rows.append((i, say(common + (["fine"] if good else ["junk"])), "en", "left" if good else "right", 60))
        marks.append((i, good, 0))
    for i in range(1600, 6000):  # not labelled; words of their own
        good = i % 2
        rows.append((i, say([*common, "novelgood" if good else "novelbad"] if i < 2400 else common), "en", "left" if good else "right", 60))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    weight = {}
    for word in ("novelgood", "novelbad"):
        at = np.flatnonzero(model.words == hashes(word)[0])
        assert len(at) == 1, f"{word} occurs in unlabelled documents only and is no word of the model"
        weight[word] = model.text[at[0]]
    assert weight["novelgood"] > 0 > weight["novelbad"]
    seen = quality.exchange(docs.select("doc_id", "text", *quality.metadata("meta")), model, (np.array([1.0, 0.0]), np.array([50.0, 0.0])), model.words, 10)
    assert seen.documents.sum() > 5900  # a teacher that is sure of all labels all, not a share or a sample of them


def test_hot_anchor_is_spread(spark):
    """A passage in documents that differ around it: they do not all meet in one bucket."""
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    n, passage, asked = 80, say(260), Asked(64, 50)
    tables = [in_order(pa.table({"doc_id": pa.array(range(g * n, g * n + n), pa.int64()), "text": [say(150) + passage + say(150) for _ in range(n)]})) for g in (0, 1)]

    def answered(rows, g, work):
        parts = [work(rows.filter(pa.compute.equal(rows.column("bucket"), b))) for b in sorted(set(rows.column("bucket").to_pylist()))]
        return pa.concat_tables([t.filter(pa.compute.equal(t.column("g"), g)) for t in parts])

    def most(hot):
        anchors = pa.concat_tables([suffixes._ask(100, asked)(g, t) for g, t in enumerate(tables)])
        asks = pa.concat_tables([suffixes._ask_windows(100, asked, asked)(g, t, answered(anchors, g, lambda rows: shared_values(rows, hot=hot))) for g, t in enumerate(tables)])
        load = {}
        for g, t in enumerate(tables):
            sent = suffixes._send(100, asked, asked)(g, t, answered(asks, g, suffixes._shared_windows))
            for b, payload in zip(sent.column("bucket").to_pylist(), sent.column("payload").to_pylist()):
                if b >= 0:
                    load[b] = load.get(b, 0) + int(np.frombuffer(payload[8:16], np.int64)[0])
        return max(load.values())

    assert most(hot=1 << 30) > 1.5 * n  # by anchor: a stretch of nearly every document in one bucket
    assert 0 < most(hot=1) < n // 2


def test_hot_anchors_leave_the_result_as_it_is(spark):
    rows = H.odd_documents(3)
    docs = spark.createDataFrame(rows, H.DOCS).repartition(5)
    some = lambda df: sorted(map(str, df.collect()))
    assert some(suffixes.dedup_bytes(docs, hot=0)) == some(suffixes.dedup_bytes(docs, hot=1 << 30))


def test_common_passages_cost_the_same_when_hot():
    """The inside of a passage that is in every group is sent in runs, not window by window."""
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, asked = say(3000), Asked(64, 50)
    tables = [in_order(pa.table({"doc_id": pa.array(range(3 * g, 3 * g + 3), pa.int64()), "text": [say(200) + passage + say(200) for _ in range(3)]})) for g in range(8)]

    def answered(rows, work):
        parts = pa.concat_tables([work(rows.filter(pa.compute.equal(rows.column("bucket"), b))) for b in sorted(set(rows.column("bucket").to_pylist()))])
        return [parts.filter(pa.compute.equal(parts.column("g"), g)) for g in range(len(tables))]

    def windows_and_bytes(hot):
        anchors = pa.concat_tables([suffixes._ask(100, asked)(g, t) for g, t in enumerate(tables)])
        asks = pa.concat_tables([suffixes._ask_windows(100, asked, asked)(g, t, told) for (g, t), told in zip(enumerate(tables), answered(anchors, lambda rows: shared_values(rows, hot=hot)))])
        sent = [suffixes._send(100, asked, asked)(g, t, told) for (g, t), told in zip(enumerate(tables), answered(asks, suffixes._shared_windows))]
        heads = [np.frombuffer(p[8:24], np.int64) for t in sent for b, p in zip(t.column("bucket").to_pylist(), t.column("payload").to_pylist()) if b >= 0]
        return sum(int(plain) - 99 * int(n) for n, plain in heads), sum(int(plain) + 33 * int(n) for n, plain in heads)

    (cold, cold_bytes), (hot, hot_bytes) = windows_and_bytes(1 << 30), windows_and_bytes(1)
    assert hot >= 8 * (len(passage) - 99) and cold >= hot  # every group still sends every window of the passage
    assert hot_bytes < 3 * cold_bytes


def test_edited_and_cut_copies_of_a_hot_passage(spark):
    """Runs of a block, parts of it and single windows meet: against brute force."""
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, rows = say(700), []
    for i in range(90):
        text = passage[rng.choice((0, 0, 0, 37, 250)) : rng.choice((700, 700, 700, 655, 400))]
        if i % 7 == 3:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + rng.choice((0, 1)) :]
        rows.append((i, say(rng.choice((0, 1, 60))) + text + rng.choice(("", say(2), say(90), " " + passage[:130]))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: v[:4] for i, v in H.repeats(rows).items()}
    for hot in (0, 3, 64):
        assert {r.doc_id: tuple(r)[1:5] for r in suffixes.dedup_bytes(docs, hot=hot).collect()} == want, hot


def test_buckets_of_suffixes_grow_with_the_input():
    class Docs:
        class sparkSession:  # noqa: N801
            class conf:  # noqa: N801
                get = staticmethod(lambda name: "12")

    at = lambda size: Asked.of(Groups(Docs, size, 1), 2 / 78, 9, suffixes.PER_BUCKET, packed=0).buckets
    assert at(1 << 44) == 16 * at(1 << 40) > 1 << 18


def test_without_a_language_model_no_text_is_rejected(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "1234", None), (3, None, None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in language.identify(docs, model).collect()}
    assert model is None and got == {1: ("und", 0.0, True), 2: ("und", 0.0, False), 3: ("und", 0.0, False)}
