"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

import corpus_pipeline as P
from tallyline.llm import queries

from .conftest import words


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    clean = [words(rng, 80, 9999) for _ in range(30)]
    item = words(rng, 30, 9999)
    rows = [(i, t, "en") for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en"), (101, clean[1] + " more", "en"), (102, words(rng, 20, 9999) + " " + item, "en"), (103, "12 34 !!", None), (104, None, None), (105, words(rng, 50, 9999) + " token = abcdefgh12", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        left.append({r.doc_id for r in docs.collect()})
        if k < 4:
            assert docs.columns == P.COLUMNS
    every = {r[0] for r in rows}
    assert left[0] == every - {103, 104}
    assert left[1] == left[0] - {100, 101}
    assert left[2] == left[1] - {102}
    assert left[3] == left[4] == left[2]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == left[4]
    secret = spark.read.parquet(str(tmp_path / "s3")).filter("doc_id = 105").first().text
    assert "abcdefgh12" not in secret and "*" in secret


def test_decontamination_keeps_clean_rows_of_an_id(spark, tmp_path):
    rng = random.Random(14)
    item, clean = words(rng, 30, 9999), [words(rng, 60, 9999) for _ in range(4)]
    rows = [(None, item + " x"), (None, clean[0]), (None, None), (7, clean[1]), (7, "y " + item), (7, "y " + item), (8, clean[2]), (9, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = P.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == P.COLUMNS
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, clean[0]), (None, None), (7, clean[1]), (8, clean[2])}


def test_empty_tables(spark, tmp_path):
    """Without documents there are no rows; without benchmark items, nothing is dropped for them."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(15)
    rows = [(i, words(rng, 60, 9999), "en", "s", 1) for i in range(5)]
    for name, own in (("none", []), ("some", rows)):
        spark.createDataFrame(own, kind).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert {r.doc_id for r in P.run(spark, str(tmp_path / name)).collect()} == {r[0] for r in own}


def test_registered():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
