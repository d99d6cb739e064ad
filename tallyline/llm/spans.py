"""Substring dedup on sliding sentence spans.

A text is cut into sentences (ends: punctuation with a . ! or ? in it before white space, or a line break). From each sentence on, and up to
each, the shortest run of at least RUN sentences and MIN_WORDS words is a span; so is each shortest run of fewer sentences with
LONE_WORDS words, as a passage may be one long sentence. As passages begin and end inside sentences too, the LONE_WORDS words from the
start of each shorter sentence, and those up to its end, are spans for the complete sentences in them: of a passage of twice so
many words, one of the two lies in it for each of its complete sentences. A longer run repeats only where all shortest runs in it
do, which cover all of its sentences. Spans are hashed by their words (A-Z lowered, punctuation aside) and
joined over all texts. Every sentence that lies in a span which stood earlier, in a row before or earlier in the same row, is
removed; first occurrences stay.

Rows are in the order of doc_id, nulls last, and then of the text's address (60 bits of its MD5); by these two a row is told from
others, so that what is found in one never goes from another with the same id, or with none. The id may be of any type that has an
order.

Of the rows of a slice of texts (4 MB) that hold a span, only the first is dealt by the span's hash, and meets those of other
slices there, in order; the others are known to come later already. So a span that stands in a third of all texts costs its
task one row a slice. Spans that meet in one row at the end are those of one text.

Defined cases: a null text stays null with no sentences; a text without words has no spans and stays; rows with one id and other
texts are rows of their own; rows equal in id and text are one row, from each of which the same goes; spans that overlap inside one
run of equal sentences count as earlier for later ones; an empty table gives no rows; all columns of the input are kept, but that
n_sentences, n_removed and removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyline.llm import kernel
from tallyline.llm.common import batches_of, clash_free, table, text_of

RUN, MIN_WORDS, LONE_WORDS = 2, 20, 25
#: bytes of ASCII punctuation
MARK = np.zeros(256, bool)
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, first): byte starts of the sentences of all texts, each up to the next start, and sentences before each text."""
    line = data == 10
    stop = (data == 46) | (data == 33) | (data == 63)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    end = line.copy()
    # marks that follow a stop belong to it: up to white space, a byte before which only marks stand since a stop ends a sentence
    mark = MARK[data]
    alone = np.maximum.accumulate(np.where(mark, -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    last_stop = np.maximum.accumulate(np.where(stop, np.arange(len(data)), -1)) if len(data) else np.zeros(0, np.int64)
    end[:-1] |= (last_stop[:-1] > alone[:-1]) & space[1:]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = end
    # white space after an end belongs to the sentence before; a new one starts at the next other byte. White space before a text's
    # first sentence is part of it, but for line breaks
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    ends_before = np.concatenate([[0], np.cumsum(end)])
    text = np.searchsorted(offsets, starts, "right") - 1
    last = np.concatenate([[0], starts[:-1]]) if len(starts) else starts
    starts = starts[ends_before[starts] > ends_before[np.maximum(last, offsets[text])]]
    starts = np.union1d(starts, offsets[:-1][np.diff(offsets) > 0])
    return starts, np.searchsorted(starts, offsets)


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first sentence, sentence after, whether the text has had it) of all spans."""
    data, offsets = kernel.text_bytes(column)
    starts, first = sentences(data, offsets)
    ws, we, wfirst = kernel.words(data, offsets, kernel.ALNUM)
    h = kernel.hashes(data, ws, we, kernel.ALNUM)
    # words before each sentence; a sentence starts at no inner byte of a word
    before = np.searchsorted(ws, np.append(starts, len(data)))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(starts)
    full = np.flatnonzero(np.diff(before) > 0)  # sentences with words
    if not len(full):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e, e.astype(bool)
    w0, w1, t = before[full], before[full + 1], text[full]
    m = len(full)
    lo = np.searchsorted(t, t, "left")
    hi = np.searchsorted(t, t, "right")
    i = np.arange(m)
    got = []

    def forward(run: int, words: int) -> np.ndarray:
        return np.maximum(i + run, np.searchsorted(w1, w0 + words, "left") + 1)

    def backward(run: int, words: int) -> np.ndarray:
        return np.minimum(i + 1 - run, np.searchsorted(w0, w1 - words, "right") - 1)

    end = forward(RUN, MIN_WORDS)
    runs = [(i[end <= hi], end[end <= hi])]
    start = backward(RUN, MIN_WORDS)
    ok = start >= lo
    runs.append((start[ok], i[ok] + 1))
    for a, b in runs:  # longer runs go by the words from their start and those up to their end, but for sentences without words
        need = (w1[b - 1] - w0[a] < LONE_WORDS) | (full[b - 1] - full[a] > b - 1 - a)
        got.append((a[need], b[need]))
    end = forward(1, LONE_WORDS)
    ok = (end <= hi) & (end - i < RUN)
    got.append((i[ok], end[ok]))
    start = backward(1, LONE_WORDS)
    ok = (start >= lo) & (i + 1 - start < RUN)
    got.append((start[ok], i[ok] + 1))
    a, b = (np.concatenate(z) for z in zip(*got))
    short = i[w1 - w0 < LONE_WORDS]
    ahead = short[w0[short] + LONE_WORDS <= w1[hi[short] - 1]]
    back = short[w1[short] - LONE_WORDS >= w0[lo[short]]]
    x, y = np.concatenate([w0[a], w0[ahead], w1[back] - LONE_WORDS]), np.concatenate([w1[b - 1], w0[ahead] + LONE_WORDS, w1[back]])
    a = np.concatenate([a, ahead, np.searchsorted(w0, w1[back] - LONE_WORDS, "left")])
    b = np.concatenate([b, np.searchsorted(w1, w0[ahead] + LONE_WORDS, "right"), back + 1])
    one = np.unique(x * (len(h) + 1) + y, return_index=True)[1]  # equal words at one place cover equal sentences
    a, b, x, y = a[one], b[one], x[one], y[one]
    # polynomial over the mixed word hashes of the span
    power = np.full(len(h) + 1, kernel._BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(len(h) + 1, kernel._INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    hashed = kernel.mix((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64))
    own = t[a]
    order = np.lexsort((x, own, hashed))
    same = np.zeros(len(order), bool)
    same[1:] = (hashed[order][1:] == hashed[order][:-1]) & (own[order][1:] == own[order][:-1])
    again = np.zeros(len(order), bool)
    again[order] = same
    local = full - first[text[full]]
    return hashed, own, local[a], local[b - 1] + 1, again


def row_of(text: str = "text") -> Column:
    """60 bits of the text's MD5 as a number, null texts as empty ones."""
    return F.conv(F.substr(F.md5(text_of(text).cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def _dealt(rows: DataFrame) -> DataFrame:
    """(id, row, text) to (deal, later, id, row, start, end): spans; later: not the first of their kind, dealt by the row; others by the span's hash."""
    added = [("start", T.IntegerType()), ("end", T.IntegerType())]
    schema = T.StructType([T.StructField("deal", T.LongType()), T.StructField("later", T.BooleanType()), rows.schema["id"], rows.schema["row"], *[T.StructField(*a) for a in added]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            hashed, own, start, end, again = spans(b.column(2))
            rank = _ranks(b)[own]
            order = np.lexsort((again, rank, hashed))
            head = np.flatnonzero(np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])[: len(order)])
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(rank[order][head], np.diff(np.append(head, len(order))))
            later, sent = again | (rank > least), np.zeros(len(order), bool)
            sent[order[head]] = True  # of rows equal in id and text one is enough
            sent = np.flatnonzero(sent | later)
            at, later = pa.array(own[sent]), later[sent]
            row = b.column(1).take(at)
            deal = np.where(later, row.to_numpy(zero_copy_only=False), hashed.view(np.int64)[sent])
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(later), b.column(0).take(at), row, pa.array(start[sent].astype(np.int32)), pa.array(end[sent].astype(np.int32))], names=schema.names)

    return rows.mapInArrow(cut, schema)


def _ranks(b: pa.RecordBatch) -> np.ndarray:
    """Place of each row of (id, row, ...) in the order of both, the same for equal ones."""
    keys = pa.table({"id": b.column(0), "row": b.column(1)})
    order = pc.sort_indices(keys, [("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
    row, code = b.column(1).to_numpy(zero_copy_only=False), pc.fill_null(b.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    new = (row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(new)])[: len(order)]
    return out


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, start, end): sentence spans that aren't the first of their kind; row: row_of the text."""
    dealt = _dealt(docs.select(F.col(doc_id).alias("id"), row_of(text).alias("row"), text_of(text).alias("text")))
    rank = F.rank().over(W.partitionBy("deal", "later").orderBy(F.col("id").asc_nulls_last(), "row"))
    return dealt.withColumn("rank", rank).filter("later or rank > 1").select("id", "row", "start", "end")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text less repeated sentences, and n_sentences, n_removed and removed array<int> (their numbers)."""
    covered = repeated_spans(docs, doc_id, text).groupBy("id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    row, given = clash_free(docs.columns, "__row"), clash_free(docs.columns, "__spans")
    marked = docs.withColumn(row, row_of(text))
    joined = marked.join(covered, marked[doc_id].eqNullSafe(covered["id"]) & (marked[row] == covered["row"]), "left")
    added = [("n_sentences", T.IntegerType()), ("n_removed", T.IntegerType()), ("removed", T.ArrayType(T.IntegerType()))]
    keep = [c for c in docs.columns if c.lower() not in {a for a, _ in added}]
    joined = joined.select(*[marked[f"`{c}`"] for c in keep], covered["spans"].alias(given))
    at = keep.index(text)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, column=text):
            data, offsets = kernel.text_bytes(b.column(at))
            starts, first = sentences(data, offsets)
            bounds = np.append(starts, len(data))
            texts, gone = [], []
            for i, (own, there) in enumerate(zip(b.column(len(keep)).to_pylist(), b.column(at).is_valid().to_pylist())):
                lo, hi = int(first[i]), int(first[i + 1])
                out = np.zeros(hi - lo, bool)
                for s in own or []:
                    out[s["start"] : s["end"]] = True
                ends = np.append(bounds[lo + 1 : hi], offsets[i + 1])
                kept = b"".join(data[bounds[lo + k] : ends[k]].tobytes() for k in np.flatnonzero(~out)) if out.any() else data[offsets[i] : offsets[i + 1]].tobytes()
                texts.append(kept.decode() if there else None)
                gone.append(np.flatnonzero(out).astype(np.int32))
            cols = [*b.columns[: len(keep)]]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first).astype(np.int32)), pa.array([len(g) for g in gone], pa.int32()), pa.array(gone, pa.list_(pa.int32()))], names=[*keep, *[a for a, _ in added]])

    schema = T.StructType([*joined.schema.fields[: len(keep)], *[T.StructField(*a) for a in added]])
    return joined.mapInArrow(rebuild, schema)


def op9_sliding_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_sentences", "n_removed", "removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))
