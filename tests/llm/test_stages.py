"""Every stage of the pipeline on tables whose columns can't be null or have the names that operators use."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

import corpus_pipeline  # noqa: E402
from chainsieve.llm import suffixes  # noqa: E402

NAMES = ["score", "accepted", "lang_pred", "__t", "__n", "__id", "__hash", "__time", "__row", "__null", "row", "kept", "time", "hash", "id", "n", "g", "c0", "c1", "size", "bucket"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4] or 0) for r in H.odd_documents() if r[0] is not None and len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    fixed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    out = fixed.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)], F.struct(F.lit(1).alias("a"), F.array(F.lit("x")).alias("b")).alias("nested"), F.create_map(F.lit("k"), F.lit(2)).alias("map"))
    assert not out.schema["doc_id"].nullable and not out.schema["nested"].nullable
    return out


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, clashing, "")
    found = got.collect()
    assert found
    if name != "bpe":
        assert got.columns == clashing.columns
        assert all([r[n] for n in NAMES] == list(range(len(NAMES))) and r["nested"]["b"] == ["x"] and r["map"] == {"k": 2} for r in found)
    plain = stage(spark, clashing.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    shown = lambda rows: sorted((r["doc_id"], str(r["text"] if "text" in r else r["ids_sha256"])) for r in rows)
    assert shown(found) == shown(plain)


def test_repeats_of_periodic_and_tied_text(spark):
    """Windows that hold their core more than once, next to windows that don't."""
    unit = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [
        (1, unit * 9 + " and more of it " + unit * 2), (2, "x" + unit * 6), (3, unit[5:] * 8), (4, ("ab" * 80) + unit * 3), (5, "zz" + "ab" * 90), (6, unit * 3 + unit[:17] + unit * 3),
        (7, unit * 3 + unit[:17] + unit * 3 + "!"), (8, "q" * 300), (9, "q" * 120 + unit + "q" * 130), (10, "".join(chr(97 + (i * i) % 26) for i in range(900))), (11, "".join(chr(97 + (i * i) % 26) for i in range(13, 700))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: v[:4] for i, v in H.repeats(rows).items()}
    for hot in (0, 64):
        got = suffixes.dedup_bytes(docs, hot=hot).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    for window in (24, 25, 60, 101, 255):
        got = suffixes.dedup_bytes(docs, window=window).collect()
        assert {r.doc_id: r.n_removed for r in got} == {i: v[1] for i, v in H.repeats(rows, window).items()}, window
