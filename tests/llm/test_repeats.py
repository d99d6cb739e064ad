"""Repeated rows, null ids and long secrets in the older operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import common, language, leakage, pieces, quality, secrets
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def plain_pieces(texts, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [[*sp.encode(t or ""), sp.eos_id()] for t in texts]


@pytest.mark.parametrize("files", [1, 2])
def test_equal_blocks(spark, tmp_path, monkeypatch, model, files):
    """The same rows in two files, and in two batches of a file, are encoded each."""
    rng = random.Random(1)
    rows = [(1, words(rng, 50)), (None, words(rng, 30)), (2, "")]
    for k in range(files):
        spark.createDataFrame(rows * (3 - files), "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = pieces.encode(spark.read.parquet(str(tmp_path / "docs")), model).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_pieces([t for _, t in rows] * 2, model)
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in got))) == sorted(map(str, zip([i for i, _ in rows] * 2, want)))


def spans_of(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    _, found = secrets.scan_versions(df)
    return {int(r.doc_id): [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("jwt", "login")] for r in found.collect()}


def test_long_secrets(spark):
    part = "A1b_" * 25_000
    token = f"eyJ{part}.eyJ{part}.{part}"
    texts = [f"a {token} b", f"x-{token}", f"https://user:{'p' * 250}@host", f"https://{'u' * 5000}:{'p' * 5000}@host https://a:b@c", "eyJabc.eyJabcdefghij.abcdefghij", f"eyJ{part}.{part}", "eyJ" * 300_000]
    got = spans_of(spark, texts)
    assert got[0] == [("jwt", 2, 2 + len(token))] and got[1] == [("jwt", 0, 2 + len(token))]
    assert got[2] == [("login", 0, 264)] and got[3] == [("login", 0, 10_010), ("login", 10_015, 10_027)]
    assert got[4] == got[5] == got[6] == []


def test_ids_of_any_type(spark, tmp_path):
    spark.createDataFrame([("a", "password=abcdefgh"), (None, None), ("b", "x")], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id or "", r.n_assign) for r in secrets.op4_blob_ledger_secrets(spark, str(tmp_path)).collect()) == [("", 0), ("a", 1), ("b", 0)]


def test_share_of_null_ids(spark):
    """Null ids come in by their texts, and repeated rows once."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.when(F.col("id") % 5 > 0, F.col("id")).otherwise(0).alias("text")).withColumn("address", F.xxhash64("id", "text"))
    got = common.hash_share(df, "address", 1000)
    n = got.count()
    assert 850 < n < 1150 and 200 < got.filter("id is null").count() < 450 and got.select("address").distinct().count() == n


def test_forest_of_null_ids_in_any_order(spark):
    rng = random.Random(2)
    rows = [(None, words(rng, 60 + i % 40, 50 + i), i) for i in range(400)]
    score = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, place int").repartition(3)
        score.append(sorted(r.score for r in quality.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect()))
    assert np.allclose(*score, rtol=0, atol=0) and len(set(score[0])) > 1


def test_rare_language_and_null_ids(spark):
    """One text in 300 is of a second language; a third of the ids are null. Both are learned, from about as many texts as are asked for."""
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i, " ".join(rng.choice(["den", "kaffe", "skog", "blå"] if i % 300 == 7 else ["the", "tree", "house", "which"]) for _ in range(20)), "sv" if i % 300 == 7 else "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, _, prior = language.train(df, most=100)
    assert names == ["en", "sv"] and abs(np.exp(prior[1]) - 1 / 300) < 1e-9
    got = language.predict(df, language.train(df, most=100)).collect()
    assert all(r.lang_pred == r.lang for r in got)


@pytest.mark.parametrize("limit", [leakage.QUERY_BYTES, 0])
def test_a_large_benchmark_is_dealt(spark, limit, monkeypatch):
    """Broadcast or dealt to segments: each window found where it stands, items of all lengths, repeated and null ids, common terms."""
    monkeypatch.setattr(leakage, "SEGMENT_MB", 0.002)
    rng = random.Random(6)
    texts = [words(rng, rng.randrange(5, 120), 60) for _ in range(60)]
    items = [(None if k % 7 == 0 else k % 20, " ".join(texts[k].split()[3:40]) if k % 2 else words(rng, 30, 60)) for k in range(40)]
    items += [(50, "w1a"), (51, ""), (52, None), (53, " ".join(texts[5].split()[:4])), (50, "w1a"), (54, texts[8] + " nowhere " + texts[9])]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = leakage.build_index(docs)
    got = {r.id: (r.n_hit, tuple(r["items"])) for r in leakage.contamination(index, leakage.phrase_matches(index, bench, limit=limit)).collect()}
    asked = [("" if i is None else str(i), (t or "").split()) for i, t in items]
    for k, text in enumerate([*texts, "", ""]):
        own, hit, found = text.split(), set(), set()
        for name, w in asked:
            n = min(13, len(w))
            for a in range(len(w) - n + 1 if n else 0):
                for b in range(len(own) - n + 1):
                    if own[b : b + n] == w[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(name)
        assert got[k] == (len(hit), tuple(sorted(found))), k
    near = leakage.proximity_matches(index, bench.limit(0).union(spark.createDataFrame([(1, " ".join(texts[3].split()[4:7]))], bench.schema)), within=4, limit=limit)
    assert near.count() >= 1
