"""Groups spelling variants: words one edit apart, found by descending tries of all words level by level in joins.

A state (word, place, node, edits) says that the first letters of a word, with so many edits, lead to a trie node. States meet the edges of their
nodes in one join a level; an edge takes STRIDE letters, the last of which are part of the join's key, so that few states die after it. With no
edit so far, an edge with another first letter replaces the word's, or the word's letter is left out; with one edit the letters must agree. A
state that has used its word up at a word's end is a pair of neighbours; insertions are omissions seen from the other word. A word with no edit
stands at its own prefix, so the edit is looked for in the second half of the word only, below nodes that few words share; a second trie, of
the words reversed, covers the first half. Keys are 64-bit hashes, and each pair is compared letter by letter in the end.

Words of LONG letters and more would need as many levels. They are joined by the hashes of what remains when a letter is left out, found for
all places at once, and compared letter by letter.

Defined cases: a null text has no words and a null id counts as the empty text in the checksum that garbles; repeated rows count each; a word
with no near word has n_near 0; equal counts go to the smaller word in code-point order; an empty table gives no rows; only the id and the
text are read, so other columns can't clash. A long run is one word, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table, written
from tallyline.llm.kernel import mix

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters from which on words are compared by hashes instead of levels
LONG = 64
#: letters that an edge takes
STRIDE = 3


def garbled(run: Column, key: Column, every: int = 31) -> Column:
    """The run without one letter where `every` divides the checksum of key and run: that at checksum % length."""
    h = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, twice: int = 2, every: int | None = 31) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z as a-z, of `least` letters and more that occur `twice` or more."""
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    word = garbled(F.col("run"), F.col("key"), every) if every else F.col("run")
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= twice)


def _tries(words: DataFrame) -> DataFrame:
    """(o, size, low): each word forwards (after an F) and backwards (after a B), with end marks, and the place from which on it may be edited."""
    half, ends = (F.length("word") / 2).cast("int"), "." * (2 * STRIDE)
    both = F.array(
        F.struct(F.concat(F.lit("F"), "word", F.lit(ends)).alias("o"), (half + 2).alias("low")),
        F.struct(F.concat(F.lit("B"), F.reverse("word"), F.lit(ends)).alias("o"), (F.length("word") - half + 2).alias("low")),
    )
    return words.select(F.length("word").alias("size"), F.inline(both))


def _level(tries: DataFrame, frontier: DataFrame | None, depth: int) -> DataFrame:
    """(o, next, node): states with one edit that leave the nodes of `depth` to `depth` + STRIDE - 1 letters and the side's, `next` being their place in o.

    From states that arrive there with one edit and from words that stand there unedited. A key is the node and the letters after the next one.
    """
    o, at = F.col("o"), F.col("at")
    part = lambda text, start, n: F.substring(text, start if isinstance(start, Column) else F.lit(start), n if isinstance(n, Column) else F.lit(n))
    key = lambda node, start: F.xxhash64(node, part(o, start, STRIDE - 1)).alias("key")
    places = F.sequence(F.greatest("low", F.lit(depth + 1)), F.least(F.col("size") + 2, F.lit(depth + STRIDE)))
    here = tries.filter((F.col("low") <= depth + STRIDE) & (F.col("size") + 2 > depth)).select("o", "size", F.explode(places).alias("at"))
    node = part(o, 1, at - 1)
    edges = here.select(key(node, at + 1), part(o, 1, at + STRIDE - 1).alias("node")).distinct()
    letters = here.filter(at < F.col("size") + 2)
    states = letters.select(key(node, at + 1), "o", (at + STRIDE).alias("next"), F.lit(True).alias("replaced"))
    states = states.unionByName(letters.filter(part(o, at, 1) != part(o, at + 1, 1)).select(key(node, at + 2), "o", (at + STRIDE + 1).alias("next"), F.lit(False).alias("replaced")))
    if frontier is not None:
        on = frontier.filter(~F.endswith("node", F.lit("."))).withColumnRenamed("next", "at")
        states = states.unionByName(on.select(key(F.col("node"), at + 1), "o", (at + STRIDE).alias("next"), F.lit(False).alias("replaced")))
    same = part(o, F.col("next") - STRIDE, 1) == part(F.col("node"), -STRIDE, 1)
    return states.join(edges, "key").filter(same != F.col("replaced")).select("o", "next", "node")


def _remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, place, hash) of each word without one letter, and at place -1 of the word itself, from sums of letter numbers times powers."""
    base, inverse, one = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.ones(1, np.uint64)
    for b in batches:
        for key, word in zip(b.column("id").to_pylist(), b.column("word").to_pylist()):
            letters = mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64))
            n = len(letters)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * np.multiply.accumulate(np.concatenate([one, np.full(n - 1, base)])))])
            without = sums[:-1] + (sums[-1] - sums[1:]) * inverse
            for lo in range(-1, n, 1 << 16):
                place = np.arange(lo, min(n, lo + (1 << 16)))
                h = mix(np.where(place < 0, sums[-1], without[place]))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(place), pa.binary()), pa.array(place, pa.int64()), pa.array(h.view(np.int64), pa.int64())], ["id", "place", "hash"])


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, near) among words of LONG letters and more, both ways."""
    known = written(words.filter(F.length("word") >= LONG).select(F.unhex(F.sha2("word", 256)).alias("id"), "word"), "long-words")
    keys = written(known.mapInArrow(_remains, "id binary, place long, hash long"), "long-keys")
    cut = keys.filter("place >= 0")
    # one letter more: what is left of x is y; in a run of one letter it is left at many places
    whole = keys.filter("place < 0").select("hash", F.col("id").alias("y"))
    shorter = cut.groupBy("hash", F.col("id").alias("x")).agg(F.min("place").alias("place")).join(whole, "hash").filter("x <> y").select("x", "y", "place", F.lit(True).alias("less"))
    # another letter at one place
    other = cut.select("hash", "place", F.col("id").alias("x")).join(cut.select("hash", "place", F.col("id").alias("y")), ["hash", "place"]).filter("x < y").select("x", "y", "place", F.lit(False).alias("less"))
    found = shorter.union(other)
    texts = found.join(known.select(F.col("id").alias("x"), F.col("word")), "x").join(known.select(F.col("id").alias("y"), F.col("word").alias("near")), "y")
    rest = lambda c: F.concat(F.substring(c, F.lit(1), F.col("place").cast("int")), F.substring(c, F.col("place").cast("int") + 2, F.length(c)))
    near = texts.filter(rest("word") == F.when(F.col("less"), F.col("near")).otherwise(rest("near")))
    return near.select(F.inline(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words that one inserted, deleted or replaced code point turns into each other, both ways.

    `words` has distinct words. Its counts by length come to the driver, as one row.
    """
    short = words.filter(F.length("word") <= LONG)
    most, least, longest = words.agg(F.max(F.when(F.length("word") <= LONG, F.length("word"))), F.min(F.length("word")), F.max(F.length("word"))).first()
    found = [words.select("word", F.col("word").alias("near")).limit(0)]
    if most is not None:
        tries, frontier, levels = written(_tries(short), "tries"), None, []
        for depth in range(least // 2 + 1, most + 2, STRIDE):
            frontier = written(_level(tries, frontier, depth), f"frontier{depth}")
            levels.append(frontier)
        ended = reduce(DataFrame.unionByName, levels).filter(F.endswith("node", F.lit(".")))
        word = lambda c: (lambda x: F.when(F.startswith(c, F.lit("B")), F.reverse(x)).otherwise(x))(F.regexp_extract(c, "^.([^.]*)", 1))
        hit = ended.select(word("o").alias("word"), word("node").alias("near")).filter(F.levenshtein("word", "near", 1) == 1)
        shorter = F.length("near") < F.length("word")
        found.append(hit.select(F.inline(F.when(shorter, F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).otherwise(F.array(F.struct("word", "near"))))))
    if longest is not None and longest >= LONG:
        found.append(_long_pairs(words))
    return reduce(DataFrame.unionByName, found).distinct()


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct (word, n); `ratio` above 1.

    Each step from a word to its form multiplies the count by `ratio`, which bounds the rounds that double the steps.
    """
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    near = near_words(words).join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    big = -F.col("best.minus") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(big, F.col("best.near")).alias("form"), F.when(big, -F.col("best.minus")).alias("form_n"),
    )
    told = written(told, "forms")
    steps = told.filter("form is not null").select("word", F.col("form").alias("root"))
    most = told.agg(F.max("form_n")).first()[0] or 1
    for k in range(math.ceil(math.log2(1 + math.log(most, ratio)))):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = written(steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"root{k}")
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_trie_frontier_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return group(written(word_counts(table(spark, sf_dir, "documents")), "words"))


OP12_SQL = r"""
WITH RECURSIVE
bytes AS (SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
checked AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(hex(encode(key))) // 2 + 1), lambda i: CAST('0x' || substr(hex(encode(key)), 2 * i - 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) AS h
  FROM each, bytes),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM checked)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY w.n DESC, p.near) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.root FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON e.word = f.word
"""
