"""Registered queries against SQL, libraries, labels and brute force on the smallest tables."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))
import helpers as H  # noqa: E402
from comparing import difference, duck  # noqa: E402

from chainsieve.llm import jaccard, language, mixing, suffixes  # noqa: E402
from chainsieve.llm.queries import CHECKS, QUERIES  # noqa: E402

TINY = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, name):
    assert difference(spark, name, QUERIES[name], CHECKS[name], TINY, duck(TINY)) is None


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet").cache()


def test_suffixes_against_brute_force(spark, documents):
    want = H.repeats([(r.doc_id, r.text) for r in documents.collect()])
    got = QUERIES["op8_suffix_dedup"](spark, TINY).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: v[:4] for i, v in want.items()}


def test_bpe_against_the_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in documents.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), H.sha(",".join(map(str, ids)).encode()), H.sha(reference.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_bpe_round_trip"](spark, TINY).collect()} == want


def test_language_on_held_out_documents(spark, documents):
    found = QUERIES["op9_language_id"](spark, TINY).join(documents, "doc_id").where("held_out").toPandas()
    assert len(found) > 20 and (found.lang == found.lang_pred).mean() >= 0.95


def test_quality_tells_labelled_documents_apart(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op2_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good = ((found.quality == 1) & (found.toxic == 0)).to_numpy()
    rank = found.score.rank().to_numpy()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc >= 0.95 and found.keep[good].mean() >= 0.97


def test_neighbours_recall(spark):
    vectors = spark.read.parquet(f"{TINY}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(vectors.embedding.tolist(), float), vectors.vec_id.to_numpy()
    got = QUERIES["op10_nearest_neighbours"](spark, TINY).toPandas()
    hits = total = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 20
        assert np.allclose(own.sort_values("rank").score, s[np.searchsorted(ids, own.sort_values("rank").vec_id)])
    assert hits >= 0.9 * total


def test_pipeline_stage_by_stage(spark, documents, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs, columns = documents, documents.columns

    def step(name):
        stages[name](spark, docs, TINY).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    out = step("language_id")
    accepted = language.identify(docs, language.train(docs)).where("accepted")
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in accepted.collect()}
    docs = out
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = step("ngram_jaccard_join")
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(i for i, (_, c) in H.components(rows).items() if i == c)
    before = [(r.doc_id, r.text) for r in docs.collect()]
    docs = step("suffix_array_dedup")
    assert docs.columns == columns
    masks, texts = H.repeats(before), dict(before)
    for r in docs.collect():
        gone, at, left = masks[r.doc_id][4], 0, []
        for c in texts[r.doc_id] or "":
            size = len(c.encode())
            left.append("" if all(gone[at : at + size]) else c)
            at += size
        assert r.text == "".join(left) and r.n_chars == len(r.text)
    con = duck(TINY)
    con.register("left_docs", docs.toPandas())
    want = con.execute(mixing.MIX_SQL.replace("FROM documents", "FROM left_docs")).df()
    docs = step("mix_sources")
    times = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert docs.columns == columns
    assert {r.doc_id: times.get(r.doc_id, 0) * r.size for r in want.itertuples()} == {r.doc_id: r.taken for r in want.itertuples()}
    assert sum(times.values()) == step("bpe").count()


def test_entry_has_the_queries():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(CHECKS) <= set(__spark_entry__.oracle_sql())


def test_source_weights_and_caps(spark):
    """Water filling: caps stop small sources, the rest share by weight."""
    totals = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(totals, (5, 2, 1), 1.5, 2.0).collect()}
    # 2415 words; a is weight 5 with cap 20, null weight 5 with cap 200; b and c share 2195 by 2 : 1, c below its cap of 1000
    assert got["a"] == 20 and got[None] == 200 and got["b"] == pytest.approx(2195 * 2 / 3) and got["c"] == pytest.approx(2195 / 3)


def test_periodic_and_random_suffixes():
    rng = np.random.default_rng(0)
    for t in range(300):
        n = int(rng.integers(120, 300))
        text = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8) if t % 2 else np.resize(rng.integers(97, 100, rng.integers(1, 8)), n).astype(np.uint8)
        wanted = np.sort(rng.choice(n - 100, min(n - 100, 60), replace=False))
        order = suffixes.suffix_order(text, wanted, 100)
        raw = text.tobytes() + bytes(120)
        keys = [raw[i : i + 100] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(wanted)


@pytest.mark.parametrize("edits", [3, 6])
def test_near_copies_of_one_text(spark, edits):
    """A group whose members differ from each other by more than from their hub, against all pairs."""
    rng = np.random.default_rng(edits)
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(150)]
    docs = []
    for i in range(60):
        text = list(base)
        for p in rng.choice(150, rng.integers(0, edits), replace=False):
            text[p] = f"x{rng.integers(0, 4)}"
        docs.append((i, " ".join(text)))
    docs += [(100 + i, " ".join(base[:k])) for i, k in enumerate((2, 3, 9, 10, 100, 130, 136, 140, 149))]
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("x", F.lit(0)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == H.components(docs)
