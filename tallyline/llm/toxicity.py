"""Toxicity by noisy-channel deobfuscation.

1. A character language model, trigram counts over all texts, is summed on the cluster (a table of 64**3 cells at most).
2. Each word that looks written to hide (leet characters, marks between its letters, a letter three times or more) is a lattice: a
   character stands for itself or for the letters it imitates, or for nothing at a cost that says how often it is punctuation where it
   stands, and a repeated one may be one or two. So is each run of short words, half of them single letters: a space between them is
   one or nothing. A word of digits may be a number, which is no word. Viterbi decoding finds the likeliest letters under the model;
   other words are only lower-cased and freed of marks around them. What a task decoded last it keeps at hand, RECENT words or
   twice so many.
3. The restored text is scored by logistic regression on the presence of words and of word beginnings (so that other endings
   of a word are found, and other words that begin like it too). The features are all that MIN_DOCS toxic rows or
   more have, the evidence that a weight needs, and that are twice as frequent in toxic rows as in all. They are chosen, and weights
   fitted, on about MAX_TRAIN labelled rows, chosen by a hash of their ids, which bounds what comes to the driver.

Whole texts are read. Defined cases: a null or empty text has no features and gets the base score; without labels of both kinds
every score is 0; repeated rows are scored each; labels that repeat for an id count once, as toxic if any is, and of rows with that id
the one with the least text is learned from; a word of any length is decoded whole, as the lattice is walked once; an empty table gives
no rows; columns of the input named score or predicted are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm import kernel, language
from tallyline.llm.common import Recent, batches_of, hash_share, table, text_of, written

MAX_TRAIN, MIN_DOCS, BEGINNINGS, BAR = 12_000, 4, (3, 4, 5, 6), 0.3
CLASSES = 64
#: decoded words that a task keeps at hand
RECENT = 100_000

# Letters that a character imitates.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
MARKS = set(".-_*~'`^,:;/\\#%&=")
THRICE = re.compile(r"(.)\1\1")


def _class(letter: np.ndarray) -> np.ndarray:
    """Letters to CLASSES classes: 0 a gap, 1-26 a-z, the rest by hash."""
    plain = (letter >= 97) & (letter <= 122)
    return np.where(letter == 0, 0, np.where(plain, letter - 96, 27 + letter % (CLASSES - 27))).astype(np.int64)


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cell, n): counts of trigrams of letter classes, word gaps included, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches_of(batches, language.BATCH_MB):
            letter, _ = language.letters(b.column(0))
            keep = np.ones(len(letter), bool)
            keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0)
            c = _class(letter[keep])
            if len(c) >= 3:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    return docs.select(text_of(text).alias("text")).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Channel:
    """Decodes hidden words under letter-trigram log-probabilities."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        n = np.zeros(CLASSES**3)
        n[cells] = counts
        n = n.reshape(CLASSES, CLASSES, CLASSES)
        pair = n.sum(0)
        low = (pair + 0.5) / (pair.sum(1, keepdims=True) + 0.5 * CLASSES)
        p = (n + 5.0 * low[None]) / (n.sum(2, keepdims=True) + 5.0)
        self.log = np.log(p)
        self._start()

    def _start(self) -> None:
        self.flat = self.log.ravel().tolist()
        self.known = Recent(RECENT)

    def __getstate__(self) -> dict:
        return {"log": self.log}

    def __setstate__(self, state: dict) -> None:
        self.log = state["log"]
        self._start()

    def choices(self, word: str) -> list[list[tuple[str, float]]] | None:
        """For each place of the lattice, (letters, cost) that may stand there; None if the word hides nothing."""
        out: list[list[tuple[str, float]]] = []
        hidden, i, n = False, 0, len(word)
        plain = [k for k, c in enumerate(word) if c.isalpha()]
        lo, hi = (plain[0], plain[-1]) if plain else (0, n)
        while i < n:
            c = word[i]
            run = 1
            while i + run < n and word[i + run] == c:
                run += 1
            if c.isalpha():
                if run >= 3:
                    hidden = True
                    out.append([(c, 0.0), (c * 2, 0.0)])
                else:
                    out.append([(c * run, 0.0)])
            elif c == " ":
                hidden = True
                out.append([(" ", 0.0), ("", 0.5)])
            elif c in LEET:
                hidden = True
                # nothing: dear between letters, cheap where marks end a word, free for a uniform run of marks there
                around, mark = not lo < i < hi, not c.isdigit()
                nothing, letter = (4.0, 0.7) if around else (8.0, 0.7)
                if around and mark and run >= 3:
                    nothing, letter = 0.0, 4.7
                elif around and c == "!":
                    nothing, letter = 0.5, 2.7
                own = [(x * k, letter + (1.5 if k < min(run, 2) and run < 3 else 0.0)) for x in LEET[c] for k in sorted({1, min(run, 2)})]
                out.append([*own, ("", nothing * min(run, 2))])
            else:
                hidden |= c in MARKS
                out.append([("", 0.2)] if c in MARKS else [("", 2.0)])
            i += run
        return out if hidden else None

    def best(self, places: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """(score, letters) of the likeliest way through a lattice: log-probability of the letters and a gap after them, less costs."""
        flat = self.flat
        # state: the last two letter classes; value: score and a chain of letters back to the start
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in places:
            after: dict[int, tuple[float, tuple | None]] = {}
            coded = [(letters, cost, [_code(x) for x in letters]) for letters, cost in options]
            for last, (score, chain) in states.items():
                for letters, cost, codes in coded:
                    s, at = score - cost, last
                    for code in codes:
                        s += flat[at * CLASSES + code]
                        at = at % CLASSES * CLASSES + code
                    held = after.get(at)
                    if held is None or held[0] < s:
                        after[at] = (s, (letters, chain) if letters else chain)
            states = after
        score, chain = max(((s + flat[at * CLASSES], chain) for at, (s, chain) in states.items()), key=lambda v: v[0])
        found = []
        while chain is not None:
            found.append(chain[0])
            chain = chain[1]
        return score, "".join(reversed(found))

    def decode(self, word: str) -> str:
        """The likeliest letters of a lower-case word; none where it is rather a number, two nats a digit."""
        places = self.choices(word)
        if places is None:
            return word
        score, found = self.best(places)
        return "" if not any(c.isalpha() for c in word) and score < -2.0 * len(word) else found

    def restore(self, token: str) -> str:
        """A token lower-cased, with marks around it cut off and what it hides decoded; a run of short words may give several."""
        word = token.lower()
        if not word.isalpha():
            lo, hi = 0, len(word)
            while hi > lo and not (word[hi - 1].isalnum() or word[hi - 1] in LEET):  # marks that imitate nothing are punctuation
                hi -= 1
            while lo < hi and not (word[lo].isalnum() or word[lo] in LEET):
                lo += 1
            word = word[lo:hi]
        if word.isalpha() and not THRICE.search(word):
            return word
        got = self.known.get(word)
        if got is None:
            got = self.decode(word)
            self.known.put(word, got)
        return got


def _code(x: str) -> int:
    n = ord(x)
    return 0 if x == " " else n - 96 if 97 <= n <= 122 else 27 + n % (CLASSES - 27)


def tokens(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different tokens, their numbers in the order of the texts, text of each); a run of short words makes one more token, spaces and all."""
    data, offsets = kernel.text_bytes(column)
    ws, we, first = kernel.words(data, offsets, kernel.SPACE)
    h = kernel.hashes(data, ws, we, kernel.SPACE)
    _, at, code = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    names = [raw[s:e].decode("utf-8", "replace") for s, e in zip(ws[at].tolist(), we[at].tolist())]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.array([len(x) if len(x) <= 2 and all(c.isalpha() or c in LEET for c in x) else 0 for x in names], np.int8)[code] if len(names) else np.zeros(0, np.int8)
    new = np.flatnonzero(np.concatenate([[True], ((size[1:] > 0) != (size[:-1] > 0)) | (text[1:] != text[:-1])])) if len(size) else np.zeros(0, np.int64)
    end, ones = np.append(new[1:], len(size)), np.concatenate([[0], np.cumsum(size == 1)])
    n, single = end - new, ones[end] - ones[new]
    more_code, more_text = [], []
    known = {x: i for i, x in enumerate(names)}
    for k in np.flatnonzero((size[new] > 0) & (n >= 3) & (single >= 2) & (2 * single >= n)).tolist() if len(new) else []:
        own = code[new[k] : end[k]].tolist()
        if len(set(own)) > 1:
            joined = " ".join([names[i] for i in own])
            if joined not in known:
                known[joined] = len(names)
                names.append(joined)
            more_code.append(known[joined])
            more_text.append(text[new[k]])
    return names, np.concatenate([code, np.array(more_code, np.int64)]), np.concatenate([text, np.array(more_text, np.int64)])


def word_features(words: str) -> list[str]:
    """Features of one restored token: each word, and its beginnings."""
    return [f for word in words.split() for f in ("=" + word, *[word[:k] for k in BEGINNINGS if len(word) > k])]


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of about `most` labelled ids, at most twice so many, which are broadcast; one row an id."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_share(known.withColumn("address", F.xxhash64(F.col("doc_id").cast("string"))), "address", most).orderBy("address").limit(2 * most).drop("address")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, channel: Channel, most: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """(weight by feature, intercept) from the labelled rows of docs."""
    spark = docs.sparkSession
    sample = written(_sample(docs, labels, most), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}, -np.inf
    sent = spark.sparkContext.broadcast(channel)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            names, code, text = tokens(b.column(1))
            toxic = np.array(b.column(2).to_pylist())
            pairs = np.unique(np.stack([code, text]), axis=1)
            by: dict[str, list] = {}
            order = np.argsort(pairs[0], kind="stable")
            split = np.split(pairs[1][order], np.flatnonzero(np.diff(pairs[0][order])) + 1)
            held: dict[str, list[np.ndarray]] = {}
            for k, own in zip(np.unique(pairs[0]).tolist(), split):
                for f in word_features(sent.value.restore(names[k])):
                    held.setdefault(f, []).append(own)
            for f, parts in held.items():
                own = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
                by[f] = [len(own), int(toxic[own].sum())]
            if by:
                n = np.array(list(by.values()))
                yield pa.RecordBatch.from_arrays([pa.array(list(by)), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["f", "n", "bad"])

    rate = bad / (bad + good)
    counted = sample.mapInArrow(present, "f string, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("bad") >= MIN_DOCS)
    gain = F.col("bad") * F.ln((F.col("bad") + 0.5) / (F.col("n") * rate + 0.5))
    top = [r["f"] for r in counted.filter(F.col("bad") > 2 * rate * F.col("n")).orderBy(gain.desc(), "f").select("f").collect()]
    if not top:
        return {}, float(np.log(rate / (1 - rate)))
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(top)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            got = _present(b.column(1), place.value, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(got, pa.list_(pa.int32()))], names=["toxic", "at"])

    known = sample.mapInArrow(rows, "toxic int, at array<int>").toPandas()
    w, b = _logistic([np.asarray(at, np.int64) for at in known["at"]], len(top), known["toxic"].to_numpy(np.float64))
    return {f: float(v) for f, v in zip(top, w)}, float(b)


def _logistic(at: list[np.ndarray], n_features: int, y: np.ndarray, ridge: float = 0.03, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of 0 or more (a feature is a sign of toxicity or nothing) and intercept, by accelerated projected gradient; `at`: the features of each row."""
    n, column = len(y), np.concatenate([np.zeros(0, np.int64), *at])
    row = np.repeat(np.arange(n), [len(a) for a in at])
    times = lambda v: np.bincount(row, v[column], n)
    back = lambda g: np.bincount(column, g[row], n_features)
    v = np.ones(n_features)
    for _ in range(30):  # the largest eigenvalue of x'x, a little over
        u = back(times(v))
        top = float(np.linalg.norm(u))
        v = u / max(top, 1e-300)
    rate = 1.0 / (0.25 * 1.05 * top / n + ridge / n + 0.25)
    w, b = np.zeros(n_features), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(vw) + vb, -30, 30)))
        g = (p - y) / n
        new_w, new_b = np.maximum(vw - rate * (back(g) + ridge / n * vw), 0), vb - rate * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return w, b


def _present(column: pa.Array, place: dict[str, int], channel: Channel) -> list[np.ndarray]:
    """Numbers of the features that each text has."""
    names, code, text = tokens(column)
    by = [[place[f] for f in word_features(channel.restore(x)) if f in place] for x in names]
    has = np.array([bool(f) for f in by], bool)
    out: list[set] = [set() for _ in range(len(column))]
    if len(has):
        live = np.flatnonzero(has[code])
        for c, t in zip(code[live].tolist(), text[live].tolist()):
            out[t].update(by[c])
    return [np.array(sorted(s), np.int32) for s in out]


def score(docs: DataFrame, channel: Channel, model: tuple[dict[str, float], float], text: str = "text") -> DataFrame:
    """docs with `score` and `predicted`; columns of docs with these names are replaced."""
    weights, base = model
    sent = docs.sparkSession.sparkContext.broadcast((channel, {f: i for i, f in enumerate(weights)}, np.array(list(weights.values())), base))
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at = keep.index(text)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, place, w, base = sent.value
        for b in batches_of(batches, column=text):
            z = np.array([w[i].sum() for i in _present(b.column(at), place, channel)]) + base
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= BAR).astype(np.int32))], names=[*keep, "score", "predicted"])

    carried = docs.select(*[F.col(f"`{c}`") for c in keep])
    return carried.mapInArrow(ask, T.StructType([*carried.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def channel_of(docs: DataFrame, text: str = "text") -> Channel:
    got = letter_counts(docs, text).toPandas()
    return Channel(got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.float64))


def op10_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.filter(~language.held_out(F.col("doc_id")))
    labels = table(spark, sf_dir, "labels").filter(~language.held_out(F.col("doc_id")))
    channel = channel_of(docs)
    model = fit(learn, labels, channel)
    return score(docs, channel, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
