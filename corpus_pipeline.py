"""A corpus pipeline in five stages over `documents`; counted as part of tallyline.llm.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents. Only language ID,
the similarity join and decontamination drop documents: those without a language, all but one of each class, and those of which
a twentieth or more stands in a benchmark. The secret stage keeps every document and masks what it finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import chosenpath, language, leakage, pieces, secrets
from tallyline.llm.common import table, text_of, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; learned from labelled rows of docs that aren't held out."""
    return language.predict(docs, language.model_of(docs), score="__score", lang="__lang").filter(F.col("__lang") != "und").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of five-word shingles at a similarity of 0.8 or more."""
    return chosenpath.one_of_each(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: rows of the id and the text, by its MD5, that are; a clean row with the same id, or also a null one, stays."""
    marked = docs.withColumn("__address", F.unhex(F.md5(text_of().cast("binary"))))
    found = leakage.decontaminate(marked.withColumn("__key", F.struct("doc_id", "__address")), table(spark, sf_dir, "benchmark"), "__key")
    gone = written(found.filter("contaminated").select(F.col("id.doc_id").alias("__gone"), F.col("id.__address").alias("__gone_address")).distinct(), "contaminated")
    same = (marked["__address"] == gone["__gone_address"]) & marked["doc_id"].eqNullSafe(gone["__gone"])
    return marked.join(gone, same, "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; the characters of each secret become asterisks, so that lengths stay."""
    return secrets.mask(docs).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded)."""
    import public_tokenizers

    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]
#: the stages hold a trained model, a randomised join and a tokenizer, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
