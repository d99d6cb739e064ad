"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased; every other character is one word gap. The n-grams of 1 to 3 characters, gaps included, are hashed to
2**16 columns. Training counts columns by language, on about MAX_TRAIN different texts, as many of each language, that are chosen by
a hash of id and text, spread over the cluster; the log-probability matrix, of at most MAX_LANGUAGES x columns, is broadcast, with the
share of each language in all labelled texts as its prior. Scoring gathers the rows of the
matrix for the n-grams of a batch of texts and sums them by text; no count is limited and whole texts are read.

The score is the posterior of the predicted language, with the log-odds of a text of n n-grams scaled by TEMPERATURE / sqrt(n), as
neighbouring n-grams repeat each other's evidence.

Defined cases: a null text, or one without a letter, is `und` with score 0; languages with equal posteriors go to the lesser
name; without any usable training row every text is `und`; repeated rows are scored each; an empty table gives no rows; more
languages than MAX_LANGUAGES are a ValueError; columns of the input are kept, but that those named like what is added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import batches_of, table, text_of

BITS, ORDERS, MAX_TRAIN, MAX_LANGUAGES, TEMPERATURE = 16, (1, 2, 3), 8000, 200, 0.25
#: text that a task works on at once: about 60 bytes of arrays for each of its characters
BATCH_MB = 1.0
_U = np.uint32


def _classes() -> np.ndarray:
    """For each code point of the first 2**16: its lower-case letter, or 0."""
    out = np.zeros(1 << 16, _U)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTER: np.ndarray | None = None


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters, 0 for a gap, with a gap before and after each text; first place of each text and one more)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _classes()
    joined = "".join(f"\n{x or ''}\n" for x in texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(joined, _U)
    size = np.array([len(x or "") for x in texts.to_pylist()], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 2)])
    low = code < (1 << 16)
    letter = _LETTER[np.where(low, code, 0)]
    if not low.all():
        rare, which = np.unique(code[~low], return_inverse=True)
        small = [(x.lower() if len(x.lower()) == 1 else x) if x.isalpha() else "\0" for x in map(chr, rare.tolist())]
        letter[~low] = np.array([ord(x) for x in small], _U)[which]
    return letter, first


def grams(letter: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (column, text) of the n-grams; a run of gaps is one gap, and no n-gram reaches over two texts."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (text[1:] != text[:-1])
    letter, text = letter[keep], text[keep]
    for n in ORDERS:
        if len(letter) < n:
            continue
        h = np.full(len(letter) - n + 1, n, _U)
        for i in range(n):
            h = (h ^ letter[i : len(letter) - n + 1 + i]) * _U(0x9E3779B1)
            h ^= h >> _U(15)
        ok = (text[: len(h)] == text[n - 1 :]) & ((letter[: len(h)] > 0) if n == 1 else True)
        yield (h >> _U(32 - BITS))[ok], text[: len(h)][ok]


def train(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", most: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix, log priors) from about `most` rows with a label and a text, chosen by a hash of key and text.

    Each language gives an equal part of the `most`, or all it has, so that a rare one is learned too; the priors are the shares of all labelled rows.
    Counts of rows by language come to the driver, and summed counts of at most languages x 2**BITS cells.
    """
    address = F.xxhash64(F.col(key).cast("string"), F.col(text))
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), address.alias("address"))
    sizes = labelled.groupBy("label").agg(F.count("*").alias("rows"), F.approx_count_distinct("address", 0.02).alias("different")).orderBy("label").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    below = {r["label"]: min(1.0, most / len(sizes) / r["different"]) for r in sizes}
    share = F.create_map(*[F.lit(x) for pair in below.items() for x in pair]) if below else F.lit(None)
    chosen = labelled.filter(F.pmod("address", F.lit(1 << 31)) < share[F.col("label")] * (1 << 31)) if below else labelled
    rows = chosen.dropDuplicates(["address"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches_of(batches, BATCH_MB):
            names = np.array(b.column(0).to_pylist(), object)
            letter, first = letters(b.column(1))
            for column, text_no in grams(letter, first):
                for name in set(names):
                    own = column[(names == name)[text_no]]
                    total[name] = total.get(name, 0) + np.bincount(own, minlength=1 << BITS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["label", "column", "n"])

    counts = rows.select("label", "text").mapInArrow(count, "label string, column int, n long").groupBy("label", "column").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    names = sorted(below)
    place = got.label.map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)
    matrix = np.ones((len(names), 1 << BITS))
    matrix[place, got.column] += got.n
    prior = np.array([r["rows"] for r in sorted(sizes, key=lambda r: r["label"])], float)
    return names, np.log(matrix / matrix.sum(1, keepdims=True)), np.log(prior / max(prior.sum(), 1.0))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with `lang` and `score`; columns of docs with these names are replaced."""
    names, matrix, prior = model
    sent = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(matrix, np.float32), prior))
    keep = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    carried = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, prior = sent.value
        for b in batches_of(batches, BATCH_MB, text):
            letter, first = letters(b.column(at))
            n = b.num_rows
            lettered = np.diff(np.concatenate([[0], np.cumsum(letter > 0)])[first]) > 0
            total, seen = np.zeros((n, len(names))), np.zeros(n)
            for column, text_no in grams(letter, first):
                size = np.bincount(text_no, minlength=n)
                seen += size
                has = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[has]
                for k in range(len(names)):
                    if len(has):
                        total[has, k] += np.add.reduceat(table[k][column], starts, dtype=np.float64)
            if names:
                total += prior
                best = total.argmax(1)
                odds = np.exp((total - total.max(1, keepdims=True)) * (TEMPERATURE / np.maximum(1.0, np.sqrt(seen)))[:, None])
                top = odds[np.arange(n), best] / odds.sum(1)
            ok = lettered & bool(names)
            lang_of = [names[best[i]] if ok[i] else "und" for i in range(n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang_of, pa.string()), pa.array(np.where(ok, top, 0.0) if names else np.zeros(n))], names=[*keep, lang, score])

    from pyspark.sql import types as T

    schema = T.StructType([*carried.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return carried.mapInArrow(ask, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def model_of(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    return train(docs.filter(~held_out(F.col("doc_id"))))


def op7_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text")
    found = predict(rows, model_of(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
