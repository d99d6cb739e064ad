"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each segment (about 5 MB of text) is one row with the sorted term hashes of its texts
and, for each, the ordered positions where it stands. Building it needs no shuffle, and a segment answers a query alone. A
phrase is looked up from its rarest term in the segment: that list, shifted by the term's offset, is cut down by the lists of
the other terms, from rare to frequent; a phrase with a term that the segment lacks is dropped at once.

Terms are 64-bit hashes of A-Z-lowered words (see kernel.ALNUM). Positions of two texts are never adjacent.

Defined cases: a null or empty text has no words, is in the index and has no matches; an item without words has no windows;
an item shorter than the window is one window; repeated documents and items count each by itself, items by their item_id; a
null item_id counts as "" in the digest; an empty table of documents gives no rows, an empty benchmark no matches; of the
documents' columns only the id is carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyline.llm import kernel
from tallyline.llm.common import batches_of, table, text_of, written

WINDOW = 13
#: bytes of items' terms (8 a word) up to which they are sent to all executors; a larger benchmark is dealt to the segments that can hold it
QUERY_BYTES = 16_000_000
SEGMENT_MB = 5.0


def _varints(x: np.ndarray) -> bytes:
    """Seven bits a byte, low first, the high bit set on all but the last byte of a number."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 5):
        size += x >= np.uint64(1 << (7 * k))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        if not has.any():
            break
        part = (x[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = part.astype(np.uint8) | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    size = last - first + 1
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        has = size > k
        if not has.any():
            break
        out[has] |= (b[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _segment(column: pa.Array) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """(first position of each text and one more, terms, list lengths, positions) of a slice of texts."""
    data, offsets = kernel.text_bytes(column)
    s, e, first = kernel.words(data, offsets, kernel.ALNUM)
    h = kernel.hashes(data, s, e, kernel.ALNUM)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(h)) + doc  # one free position after each text
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    gaps = np.diff(place, prepend=0)
    gaps[new] = place[new]
    return first + np.arange(len(first)), h[new].tobytes(), _varints(np.diff(np.append(new, len(h)))), _varints(gaps)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments (segment, ids, firsts, terms, lengths, positions) of all texts, as a table in the shared folder."""
    id_type = docs.schema[doc_id].dataType
    kinds = [("segment", T.StringType()), ("ids", T.ArrayType(id_type)), ("firsts", T.BinaryType()), ("terms", T.BinaryType()), ("lengths", T.BinaryType()), ("positions", T.BinaryType())]
    schema = T.StructType([T.StructField(*k) for k in kinds])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, SEGMENT_MB, "__text"):
            firsts, terms, lengths, positions = _segment(b.column(1))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), ids, pa.array([_varints(np.diff(firsts, prepend=0))]), pa.array([terms]), pa.array([lengths]), pa.array([positions])], names=[k for k, _ in kinds])

    rows = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("__text"))
    return written(rows.mapInArrow(build, schema), "index")


@dataclass
class Phrases:
    """Windows of one length: term hashes of the items' words one after the other, and the start and the item of each window."""

    words: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    length: int


def phrases(terms: list[np.ndarray], window: int | None = WINDOW) -> list[Phrases]:
    """All windows of the items' terms, by length; without a window length, each item is one phrase. Items are numbered as given."""
    h = np.concatenate([np.zeros(0, np.uint64), *terms])
    size = np.array([len(t) for t in terms], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    length = np.minimum(size, window) if window else size
    out = []
    for k in np.unique(length[length > 0]).tolist():
        item = np.flatnonzero(length == k)
        n = size[item] - k + 1
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out.append(Phrases(h, np.repeat(first[item], n) + inside, np.repeat(item, n), k))
    return out


class Segment:
    """A segment in memory: lists by term, and one sorted array of (term, position) for lookups."""

    def __init__(self, firsts: bytes, terms: bytes, lengths: bytes, positions: bytes):
        self.firsts = np.cumsum(_numbers(firsts))
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = _numbers(lengths)
        self.starts = np.cumsum(self.counts) - self.counts
        gaps = _numbers(positions)
        total = np.cumsum(gaps)
        before = np.concatenate([[0], total])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.positions = total - np.repeat(before, self.counts)
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.positions

    def rank(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the terms in this segment, -1 where it lacks one."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (position >= 0) & (self.keys[at] == key)

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given terms, position) over their lists."""
        n = self.counts[term]
        which = np.repeat(np.arange(len(term)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return which, self.positions[self.starts[term][which] + inside]

    def find(self, p: Phrases, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every occurrence."""
        found, ranked = [], self.rank(p.words)  # each word of the items is looked up once
        for at in range(0, len(p.starts), block):
            terms = ranked[p.starts[at : at + block, None] + np.arange(p.length)]
            live = np.flatnonzero((terms >= 0).all(1))
            if not len(live):
                continue
            terms = terms[live]
            order = np.argsort(self.counts[terms], axis=1, kind="stable")
            which, position = self.lists(np.take_along_axis(terms, order[:, :1], 1)[:, 0])
            start = position - order[which, 0]
            for k in range(1, terms.shape[1]):
                offset = order[which, k]
                ok = self.has(terms[which, offset], start + offset)
                which, start = which[ok], start[ok]
            found.append((live[which] + at, start))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Anchors of the rarest of the terms for which every other term stands less than `within` words away in the same text."""
        terms = np.unique(self.rank(terms))
        if not len(terms) or terms[0] < 0:
            return np.zeros(0, np.int64)
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        anchor = self.lists(terms[:1])[1]
        for t in terms[1:]:
            own = self.positions[self.starts[t] : self.starts[t] + self.counts[t]]
            text = np.searchsorted(self.firsts, anchor, "right")
            low = np.maximum(anchor - within + 1, self.firsts[text - 1])
            high = np.minimum(anchor + within, self.firsts[text])
            anchor = anchor[np.searchsorted(own, high) > np.searchsorted(own, low)]
        return anchor


def _joined(seg: Segment, name: str, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, ...]:
    """Columns (segment, doc_no, item, start, end) of occurrences in a segment; spans of an item that meet in a text are one."""
    order = np.lexsort((start, item))
    item, start, end = item[order], start[order], end[order]
    doc = np.searchsorted(seg.firsts, start, "right") - 1
    # ends only grow within (item, text) as windows of an item have one length each, short phrases one
    top = end.copy()
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])])[: len(item)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(item))[: len(head)] - 1
    base = seg.firsts[doc[head]]
    return [name] * len(head), doc[head].astype(np.int32), item[head], start[head] - base, end[tail] - base


def _sent(index: DataFrame, items: DataFrame, find) -> DataFrame:
    """(segment, doc_no, item_no, start, end): all items, which are few, are sent to each task."""
    got = items.select("item_no", "terms").collect()
    sent = index.sparkSession.sparkContext.broadcast(([r["item_no"] for r in got], [np.frombuffer(r["terms"], np.uint64) for r in got]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, terms = sent.value
        query = None
        for b in batches:
            for name, *raw in zip(*[c.to_pylist() for c in b.columns]):
                seg = Segment(*raw)
                query = query or find(np.array(numbers, np.int64), terms)
                found = query(seg)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _joined(seg, name, *found)], names=_FOUND_NAMES)

    return index.select("segment", "firsts", "terms", "lengths", "positions").mapInArrow(ask, _FOUND)


def _anchors(terms: np.ndarray, n: np.ndarray, window: int | None) -> list[tuple[int, np.ndarray]]:
    """(rarest term, terms) of each stretch of windows with one rarest term, by the numbers n of segments that have each; no window with a term that none has."""
    k = min(window or len(terms), len(terms))
    if not k:
        return []
    view = np.lib.stride_tricks.sliding_window_view(n, k)
    at = np.arange(len(view)) + view.argmin(axis=1)
    live = np.flatnonzero(view.min(axis=1) > 0)
    cut = np.flatnonzero((np.diff(live) > 1) | (np.diff(at[live]) != 0)) + 1
    return [(int(terms[at[r[0]]]), terms[r[0] : r[-1] + k]) for r in np.split(live, cut) if len(r)]


def _dealt(index: DataFrame, items: DataFrame, find, window: int | None) -> DataFrame:
    """The same for items of any number, in one pass over the index and without bringing one to the driver.

    The index's terms are listed by segment, as far as items have them. Each stretch of an item's windows goes to the segments that have its
    rarest term, where it is looked up as before. A window with a term that no segment has goes nowhere.
    """

    def spread(name: str, kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    terms = np.frombuffer(raw, np.int64)
                    for at in range(0, len(terms), 1 << 16):
                        part = terms[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=[name, "at", "term"])

        return run, f"{name} {kind}, at long, term long"

    words = items.select("item_no", "terms").mapInArrow(*spread("item_no", "long"))
    listed = index.select("segment", "terms").mapInArrow(*spread("segment", "string")).select("term", "segment")
    listed = written(listed.join(words.select("term").distinct(), "term", "left_semi"), "listed")
    counts = listed.groupBy("term").agg(F.count("*").alias("n"))
    known = words.join(counts, "term").groupBy("item_no").agg(F.collect_list(F.struct("at", "n")).alias("known"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw, known in zip(*[c.to_pylist() for c in b.columns]):
                terms = np.frombuffer(raw, np.uint64)
                n = np.zeros(len(terms), np.int64)
                n[[x["at"] for x in known]] = [x["n"] for x in known]
                got = _anchors(terms, n, window)
                if got:
                    rarest = np.array([t for t, _ in got], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(rarest), pa.array([item] * len(got), pa.int64()), pa.array([t.tobytes() for _, t in got], pa.binary())], names=["term", "item_no", "asked"])

    asked = items.join(known, "item_no").select("item_no", "terms", "known").mapInArrow(stretches, "term long, item_no long, asked binary")
    routed = asked.join(listed, "term").select(F.col("segment").alias("to"), "item_no", "asked")

    def answer(asked: pa.Table, index: pa.Table) -> pa.Table:
        columns: tuple = ([], [], [], [], [])
        if asked.num_rows and index.num_rows:
            seg = Segment(*[index.column(c)[0].as_py() for c in ("firsts", "terms", "lengths", "positions")])
            found = find(asked.column("item_no").to_numpy(), [np.frombuffer(x, np.uint64) for x in asked.column("asked").to_pylist()])(seg)
            if len(found[0]):
                columns = _joined(seg, index.column("segment")[0].as_py(), *found)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)

    return routed.groupBy("to").cogroup(index.select("segment", "firsts", "terms", "lengths", "positions").groupBy("segment")).applyInArrow(answer, _FOUND)


_FOUND_NAMES = ["segment", "doc_no", "item_no", "start", "end"]
_FOUND = "segment string, doc_no int, item_no long, start long, end long"
_FOUND_ARROW = pa.schema([("segment", pa.string()), ("doc_no", pa.int32()), ("item_no", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _matches(index: DataFrame, items: DataFrame, item_id: str, text: str, limit: int, find, window: int | None) -> DataFrame:
    """Rows (segment, doc_no, item, start, end) that find(item numbers, terms of each)(segment) gives; spans of an item that meet are one.

    Items of up to `limit` bytes are broadcast, behind a sum of their sizes; more are dealt to the segments that can hold them.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1.0, "__text"):
            data, offsets = kernel.text_bytes(b.column(1))
            s, e, first = kernel.words(data, offsets, kernel.ALNUM)
            h = kernel.hashes(data, s, e, kernel.ALNUM)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[lo:hi].tobytes() for lo, hi in zip(first, first[1:])], pa.binary())], names=["item", "terms"])

    rows = items.select(F.col(item_id).alias("item"), text_of(text).alias("__text"))
    schema = T.StructType([T.StructField("item", items.schema[item_id].dataType), T.StructField("terms", T.BinaryType())])
    held = written(rows.mapInArrow(split, schema).filter(F.octet_length("terms") > 0).withColumn("item_no", F.monotonically_increasing_id()), "items")
    total = held.agg(F.sum(F.octet_length("terms") + 16)).first()[0] or 0
    found = _sent(index, held, find) if total <= limit else _dealt(index, held, find, window)
    # items with one id are one item in what is told of a text
    return found.join(held.select("item_no", "item"), "item_no").select("segment", "doc_no", "item", "start", "end")


def phrase_matches(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int | None = WINDOW, limit: int = QUERY_BYTES) -> DataFrame:
    """Word spans [start, end) of texts that are covered by exact occurrences of windows of an item."""

    def find(numbers: np.ndarray, terms: list[np.ndarray]):
        asked = phrases(terms, window)

        def query(seg: Segment):
            got = [(numbers[p.items[w]], s, s + p.length) for p in asked for w, s in [seg.find(p)]]
            return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(3))

        return query

    return _matches(index, items, item_id, text, limit, find, window)


def proximity_matches(index: DataFrame, items: DataFrame, within: int, item_id: str = "item_id", text: str = "text", limit: int = QUERY_BYTES) -> DataFrame:
    """Where the rarest term of an item has all its other terms less than `within` words away: the span of that one word."""

    def find(numbers: np.ndarray, terms: list[np.ndarray]):
        def query(seg: Segment):
            got = [(np.full(len(a), i), a) for i, t in zip(numbers, terms) if len(t) for a in [seg.near(t, within)]]
            item = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
            at = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
            return item, at, at + 1

        return query

    return _matches(index, items, item_id, text, limit, find, None)


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per indexed text: doc (segment, doc_no, id), words, words hit, items, spans and the verdict.

    A text is contaminated if at least a twentieth of its words stand in occurrences.
    """

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for segment, raw in zip(f.segment, f.firsts):
                firsts = np.cumsum(_numbers(raw))
                n = np.diff(firsts) - 1
                yield pd.DataFrame({"segment": segment, "doc_no": np.arange(len(n), dtype=np.int32), "n_words": n})

    n_words = index.select("segment", "firsts").mapInPandas(sizes, "segment string, doc_no int, n_words long")
    ids = index.select("segment", F.posexplode("ids").alias("doc_no", "id"))
    upto = W.partitionBy("segment", "doc_no").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(upto), F.lit(0))))
    hit = (
        matches.withColumn("fresh", fresh)
        .groupBy("segment", "doc_no")
        .agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("items"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    # ids and sizes meet the few texts that are hit; both are as many rows as documents, and none carries a text
    joined = ids.join(n_words, ["segment", "doc_no"]).join(hit, ["segment", "doc_no"], "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select("segment", "doc_no", "id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    index = build_index(docs, doc_id)
    return contamination(index, phrase_matches(index, benchmark))


def op8_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bk AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bk),
di AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM di),
m AS (SELECT r, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
mp AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM m),
mh AS (SELECT r, count(*) AS n FROM mp GROUP BY r),
mi AS (SELECT r, string_agg(s, ',' ORDER BY s) AS s, count(*) AS n FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(mh.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(mi.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(mi.s, '')) AS items_sha256, coalesce(mh.n, 0) > 0 AND 20 * coalesce(mh.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN mh ON d.r = mh.r LEFT JOIN mi ON d.r = mi.r
"""
