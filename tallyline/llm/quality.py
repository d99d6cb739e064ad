"""Quality rules: an isolation forest on rule statistics, with a threshold that labelled rows set.

Counts are taken from whole texts. Words are runs without ASCII white space. The forest sees ratios only (FEATURES), so that a
long text isn't odd for its length; repetition is left to the base rules, as a page frame that stands twice is no fault. It is grown on about SAMPLE rows (never over twice as many), chosen by a hash of id and
text among different rows that pass the base rules: TREES trees of PSI rows each, split at random between the extremes of a random feature. A text's score is
2 ** (-mean path length / expected path length): near 1 if random splits set it apart soon.

The threshold is the least score above which at most MAX_LOSS of the rows labelled good lie, and by which bad rows are caught;
it comes from counts by score bin over all labelled rows. Without labels of both kinds nothing is rejected by the forest.

Defined cases: a null or empty text has no words and fails the base rules; a text of one repeated word fails by repetition;
repeated rows are scored each and grown on once; null ids are
told apart by their texts; labels that repeat for an id count once, as bad if any is;
an empty table gives no rows; of the input's columns only the id is carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyline.llm import kernel
from tallyline.llm.common import batches_of, hash_share, table, text_of, written

SYMBOLS = b"#*$%&|<>"
TREES, PSI, SAMPLE, BINS, MAX_LOSS, SEED = 100, 256, 25_600, 1000, 0.005, 20240229
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marked", "n_lone"]
FEATURES = ["symbols", "upper", "length", "marked", "lone"]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text: lines with a word, upper-case and all ASCII letters, words that end in a mark other than . , and one-symbol words."""
    data, offsets = kernel.text_bytes(column)
    n = len(offsets) - 1
    ws, we, first = kernel.words(data, offsets, kernel.SPACE)
    doc = np.repeat(np.arange(n), np.diff(first))

    def per_text(at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(at, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    inside = kernel.SPACE[0][data]
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    out = {"n_words": np.diff(first), "word_chars": per_text(inside & ((data & 0xC0) != 0x80)), "n_symbols": per_text(symbol)}
    # lines
    brk = np.flatnonzero(data == 10)
    ls = np.union1d(np.concatenate([brk + 1, offsets[:-1]]), [])
    ls = ls[ls < len(data)].astype(np.int64)
    le = np.minimum(np.append(ls[1:], len(data)), np.append(brk, len(data))[np.searchsorted(brk, ls)])
    worded = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    ls, le = ls[worded], le[worded]
    line = kernel.hashes(data, ls, le, kernel.SPACE)
    owner = np.searchsorted(offsets, ls, "right") - 1
    order = np.lexsort((line, owner))
    same = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][same], minlength=n)
    # words in repeated windows of three
    h = kernel.hashes(data, ws, we, kernel.SPACE)
    hit = np.zeros(len(h) + 1, bool)
    if len(h) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        t, own = kernel.runs(h, first, 3)
        order = np.lexsort((t, own))
        t, own, at = t[order], own[order], at[order]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = (t[1:] == t[:-1]) & (own[1:] == own[:-1])
        twice = at[same[1:] | same[:-1]]
        for k in range(3):
            hit[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[hit[:-1]], minlength=n)
    out["n_lines"] = np.bincount(owner, minlength=n)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    out["n_upper"], out["n_letters"] = per_text(upper), per_text(upper | lower)
    last, size = data[we - 1] if len(we) else data[:0], we - ws
    mark = (last < 128) & ~((last >= 48) & (last <= 57)) & ~((last >= 65) & (last <= 90)) & ~((last >= 97) & (last <= 122)) & (last != 46) & (last != 44)
    out["n_marked"] = np.bincount(doc[mark & (size > 1)], minlength=n)
    out["n_lone"] = np.bincount(doc[mark & (size == 1)], minlength=n)
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of each text: ratios inside it, rounded down to steps, as a few marks in a text say nothing but differ from none."""
    step = lambda x, n: np.floor(x * n) / n
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    cols = [step(c["n_symbols"] / chars, 50), step(c["n_upper"] / np.maximum(c["n_letters"], 1), 20), step(chars / words, 2), step(c["n_marked"] / words, 20), step(c["n_lone"] / words, 20)]
    return np.stack(cols, 1).astype(np.float64)


@dataclass
class Forest:
    """Trees as arrays (trees x nodes): feature (-1 at a leaf), split, children, and the path length that a leaf stands for."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    psi: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while len(live):
                at = node[live]
                inner = self.feature[t][at] >= 0
                live, at = live[inner], at[inner]
                go = x[live, self.feature[t][at]] < self.split[t][at]
                node[live] = np.where(go, self.left[t][at], self.right[t][at])
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / max(_expected(self.psi), 1e-9))


def _expected(n: int) -> float:
    """Mean path length of a failed search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> Forest:
    rng = np.random.Generator(np.random.PCG64(seed))
    psi = min(psi, len(x))
    deepest = int(np.ceil(np.log2(max(psi, 2))))
    nodes = 2 ** (deepest + 1)
    f, s = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes))
    left, right, path = np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes))
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), psi, replace=False)], 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth < deepest else []
            if not len(spread):
                path[t, node] = depth + _expected(len(rows))
                continue
            k = int(rng.choice(spread))
            cut = rng.uniform(rows[:, k].min(), rows[:, k].max())
            go = rows[:, k] < cut
            f[t, node], s[t, node], left[t, node], right[t, node] = k, cut, used, used + 1
            todo += [(used, rows[go], depth + 1), (used + 1, rows[~go], depth + 1)]
            used += 2
    return Forest(f, s, left, right, path, psi)


def count(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, address, COUNTS, base_failed) of each row, as a table: no text goes further than this. address: a hash of id and text."""
    id_type = docs.schema[doc_id].dataType

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            c = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c[k].astype(np.int64)) for k in COUNTS]], names=["id", "address", *COUNTS])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("address", T.LongType()), *[T.StructField(k, T.LongType()) for k in COUNTS]])
    address = F.xxhash64(F.col(doc_id).cast("string"), text_of(text))
    got = docs.select(F.col(doc_id).alias("id"), address.alias("address"), text_of(text).alias("text")).mapInArrow(ask, schema)
    return written(got.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "counts")


def score(counted: DataFrame, forest: Forest | None) -> DataFrame:
    """counted with a score (0 without a forest)."""
    sent = counted.sparkSession.sparkContext.broadcast(forest)
    names = counted.columns
    kinds = [to_arrow_type(f.dataType) for f in counted.schema]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(names.index(k)).to_numpy(zero_copy_only=False) for k in COUNTS}
            s = sent.value.scores(features(c)) if sent.value is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*[c.cast(k) for c, k in zip(b.columns, kinds)], pa.array(s)], names=[*names, "score"])

    return counted.mapInArrow(ask, T.StructType([*counted.schema.fields, T.StructField("score", T.DoubleType())]))


def threshold(scored: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """The score bound, from counts by bin over all labelled rows that pass the base rules; 2 x BINS rows come to the driver."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = scored.filter(~F.col("base_failed")).join(known, F.col("id") == F.col("doc_id")).groupBy(F.floor(F.col("score") * BINS).alias("bin"), "quality").count().collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b in bins:
        (good if b["quality"] else bad)[min(BINS, int(b["bin"]))] += b["count"]
    if not good.sum() or not bad.sum():
        return 1.0
    above_good, above_bad = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    allowed = np.flatnonzero(above_good <= max_loss)
    gain = (above_bad - above_good)[allowed]
    return float(allowed[np.flatnonzero(gain == gain.max())[-1]] / BINS) if len(allowed) and gain.max() > 0 else 1.0


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, score, kept) of each row."""
    counted = count(docs, doc_id, text)
    # in order, so that the forest does not depend on the layout of the files
    sample = hash_share(counted.filter(~F.col("base_failed")), "address", SAMPLE).orderBy("address").limit(2 * SAMPLE).select(*COUNTS).toPandas()
    forest = grow(features({k: sample[k].to_numpy() for k in COUNTS})) if len(sample) else None
    scored = written(score(counted, forest), "scores")
    bound = threshold(scored, labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < bound)).drop("address").withColumnRenamed("id", doc_id)


def op1_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
