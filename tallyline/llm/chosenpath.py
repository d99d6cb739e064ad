"""Chosen-path similarity join of documents on word shingles (Jaccard), and the classes that its links make.

Every different set of shingles is a node, with the number of its rows, so that copies cost nothing, nor do texts that differ in
case, marks or spaces only; sets too small to be linked with any but equal ones need no paths. In each run, a set keeps each of its tokens x with chance
1 / (similarity * size), decided by a hash of the run and x: two similar sets share a kept token with a good chance, others
hardly ever. A kept token is a path and names a bucket; a path is extended by further kept tokens in the same way. A bucket
with at most `limit` sets is compared by brute force; a larger one is split by the paths one token longer, and at the last
depth, or once it is no longer split, its sets are compared in blocks by many tasks. There a set is written as what it has not of
one set of the group, the pivot, and what it has besides, so that near copies are short; there are about as many pairs of
blocks as partitions, each with its own, so a group of any size is spread evenly, and each set is sent as often as its side has
blocks, which no longer grows once all partitions are in use, until a block is full (`BLOCK_TOKENS`). The number of runs follows from the
recall that is asked of a pair just at the threshold that meets only at the last depth (`runs_for`; small sets, which run out
of tokens to extend a path by, have more: `runs_by_size`).

Pairs are never rows: a comparison yields, for each set, how many others it is linked with and the least set of its part.
A pair that meets in several buckets counts in the least of them. Comparisons use all tokens and are exact.

Defined cases: null and empty texts, and texts without words, have no tokens: equal ones are one class, and they have no links
to others; a text of fewer than five words is one shingle; repeated rows are copies; the class of a document is the least
doc_id of its class (null if all are null); an empty table gives no rows; one_of_each() keeps all columns, join_documents() the id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import kernel
from tallyline.llm.common import batches_of, clash_free, released, table, text_of, written

_U = np.uint64
_LOST = _U(0xA5A5A5A5A5A5A5A5)
SHINGLE, SIMILARITY, DEPTH, RECALL = 5, Fraction(4, 5), 3, 0.99
#: sets in a bucket that is compared without a further split
LIMIT = 1000
#: tokens of the sets on one side of a comparison task, and sets below which a block is not cut
BLOCK_TOKENS, BLOCK_SETS = 1_000_000, 512


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold shares a path of that depth with the recall; its shared kept tokens are about Poisson(1)."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def runs_by_size(recall: float, depth: int, most: int = 256) -> np.ndarray:
    """Runs for a set of each size up to `most` and, last, of any larger size: enough for the worst pair at the threshold, or above, that a
    set of that size is in. 0 where it can be linked with equal sets only."""
    num, den = SIMILARITY.numerator, SIMILARITY.denominator
    out = np.zeros(most + 2, np.int64)
    for a in range(1, most + 1):
        for b in range(a, a * den // num + 1):
            both = max(-(-num * (a + b) // (num + den)), 1)
            if both > a or both == b:
                continue
            keep, alive = min(1.0, den / (num * b)), 1.0
            for left in range(both - depth + 1, both + 1):  # shared tokens that a path may still take, at the last depth first
                alive = 1 - (1 - keep * alive) ** max(left, 0)
            need = math.ceil(math.log(1 - recall) / math.log(1 - alive)) if alive < 1 else 1
            for size in (a, min(b, most + 1)):
                out[size] = max(out[size], need)
    out[-1] = max(out[-1], runs_for(recall, depth))
    return out


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): the sorted different k-word shingles of each text; a text of fewer words, but not none, is one shingle."""
    data, offsets = kernel.text_bytes(column)
    s, e, first = kernel.words(data, offsets, kernel.ALNUM)
    h = kernel.hashes(data, s, e, kernel.ALNUM)
    token, doc = kernel.runs(h, first, k)
    n = np.diff(first)
    for size in range(1, k):  # whole short texts
        short = np.flatnonzero(n == size)
        if len(short):
            own = np.concatenate([h[first[short] + i] for i in range(size)]).reshape(size, -1).T.ravel()
            t, _ = kernel.runs(own, np.arange(0, len(own) + 1, size), size)
            token, doc = np.concatenate([token, t]), np.concatenate([doc, short])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(n) + 1))


def paths(token: np.ndarray, first: np.ndarray, runs: int | np.ndarray, depth: int = DEPTH, similarity: float = float(SIMILARITY)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth: (doc, key, number of the parent among the paths one shorter), ordered by doc. runs: for all, or of each doc."""
    size = np.diff(first)
    limit = np.minimum(2.0**64 / (similarity * np.maximum(size, 1)), 2.0**64 - 2048).astype(_U)
    own_runs = np.broadcast_to(runs, len(size))
    roots = kernel.mix(np.arange(1, int(own_runs.max(initial=0)) + 1, dtype=_U) * _U(0xD1342543DE82EF95))
    at = np.flatnonzero(np.repeat(own_runs, size))
    doc = np.repeat(np.arange(len(size)), size)
    nothing = np.zeros(0, np.int64)
    kept = [(nothing, nothing.view(_U), nothing)]
    few = own_runs.min(initial=len(roots), where=own_runs > 0)
    for r, p in enumerate(roots):
        if r >= few:  # the sets that have more runs
            at = at[own_runs[doc[at]] > r]
        x = token if len(at) == len(token) else token[at]
        hit = at[((x ^ p) * (p | _U(1))) < limit[doc[at]]]
        kept.append((doc[hit], kernel.mix(token[hit] ^ (p + _U(1))), hit))
    d, key, at = (np.concatenate([x[i] for x in kept]) for i in range(3))
    order = np.argsort(d, kind="stable")
    d, key, used = d[order], key[order], [at[order]]
    out = [(d, key, np.zeros(len(d), np.int64))]
    for _ in range(1, depth):
        d, key, _ = out[-1]
        new, step = [], max(1, int(1_000_000 / max(1.0, float(size[d].mean()) if len(d) else 1.0)))
        for lo in range(0, len(d), step):
            own, k = d[lo : lo + step], key[lo : lo + step]
            n = size[own]
            which = np.repeat(np.arange(len(own)), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[own][which]
            p = k[which]
            pick = np.flatnonzero(((token[inside] ^ p) * (p | _U(1))) < limit[own][which])
            fresh = np.ones(len(pick), bool)  # a token extends a path once
            for u in used:
                fresh &= u[lo : lo + step][which[pick]] != inside[pick]
            pick = pick[fresh]
            w, i = which[pick], inside[pick]
            new.append((own[w], kernel.mix(token[i] ^ (k[w] + _U(1))), w + lo, i))
        if not new:
            out.append(tuple(np.zeros(0, t) for t in (np.int64, _U, np.int64)))
            used = [np.zeros(0, np.int64)] * (len(used) + 1)
            continue
        d, key, parent, i = (np.concatenate([x[j] for x in new]) for j in range(4))
        used = [u[parent] for u in used] + [i]
        out.append((d, key, parent))
    return out


def _signatures(docs: DataFrame, runs: np.ndarray) -> DataFrame:
    """(tid, id, sid, n, k1, k2, p2, k3, p3) of each row: paths by depth and, as numbers inside the row's own list, their parents.

    sid: MD5 of the tokens, or the tid of a text without tokens. runs: by size of the set, the last for all larger ones.
    """
    names = ["tid", "id", "sid", "n", "k1", *[f"{c}{d}" for d in range(2, DEPTH + 1) for c in "kp"]]
    id_type = docs.schema["id"].dataType

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            token, first = shingle_sets(b.column(2))
            size = np.diff(first)
            levels = paths(token, first, runs[np.minimum(size, len(runs) - 1)])
            sid = [hashlib.md5(token[first[i] : first[i + 1]].tobytes()).hexdigest() if size[i] else t for i, t in enumerate(b.column(0).to_pylist())]
            cols, before = [], None
            for level, (doc, key, parent) in enumerate(levels):
                starts = np.searchsorted(doc, np.arange(b.num_rows + 1))
                lists = lambda x, kind, s=starts: pa.ListArray.from_arrays(pa.array(s, pa.int32()), pa.array(x, kind))
                cols.append(lists(key.view(np.int64), pa.int64()))
                if level:
                    cols.append(lists((parent - before[doc]).astype(np.int32), pa.int32()))
                before = starts
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sid, pa.string()), pa.array(size), *cols], names=names)

    kinds = ", ".join(f"k{d} array<long>" + (f", p{d} array<int>" if d > 1 else "") for d in range(1, DEPTH + 1))
    return docs.select("tid", "id", "text").mapInArrow(sign, f"tid string, id {id_type.simpleString()}, sid string, n long, {kinds}")


def _buckets(rows: DataFrame) -> DataFrame:
    """Buckets of two sets or more: how many, with how many tokens, and a fingerprint of which."""
    return rows.groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"), F.bit_xor(F.xxhash64("tid")).alias("print")).filter("sets > 1")


def _groups(nodes: DataFrame, limit: int) -> DataFrame:
    """(tid, key, sets, tokens): which sets are to be compared, each group once, with the sets and tokens of the whole group."""
    rows = nodes.select("tid", "n", F.explode("k1").alias("key"))
    small, big, hot = [], [], None
    for depth in range(1, DEPTH + 1):
        if depth > 1:
            above = F.col(f"k{depth - 1}")
            up = F.arrays_zip(F.col(f"k{depth}").alias("key"), F.transform(f"p{depth}", lambda i: above[i]).alias("parent"))  # noqa: B023
            rows = nodes.select("tid", "n", F.explode(up).alias("x")).select("tid", "n", "x.key", "x.parent")
            rows = written(rows.join(hot.select(F.col("key").alias("parent")), "parent", "left_semi").select("tid", "n", "key"), f"paths{depth}")
        found = written(_buckets(rows), f"buckets{depth}")
        last = depth == DEPTH
        # two buckets with the same sets are one comparison
        once = found.filter(F.col("sets") <= limit).groupBy("sets", "tokens", "print").agg(F.min("key").alias("key")).select("key", "sets", "tokens")
        small.append(rows.join(once, "key").select("tid", "key", "sets", "tokens"))
        hot = found.filter(F.col("sets") > limit)
        if last:
            big.append(rows.join(hot.select("key"), "key", "left_semi"))
        if not hot.take(1):
            break
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    if big:
        # buckets that stay large hold much the same sets: those that share the least key of a set are joined
        held = written(big[0], "large")
        least = held.groupBy("tid").agg(F.min("key").alias("least"))
        label = written(held.join(least, "tid").groupBy("key").agg(F.min("least").alias("label")), "labels")
        member = written(held.join(label, "key").select("tid", "n", F.col("label").alias("key")).distinct(), "members")
        whole = member.groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
        out = out.unionByName(member.join(whole, "key").select("tid", "key", "sets", "tokens"))
    return out


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the parts of a[i] and b[i]; parent holds the least member of each one's part."""
    while len(a):
        ra, rb = parent[a], parent[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]


def _overlaps(rows: np.ndarray, column: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Of a 0-1 matrix given by (row, column), the number of columns that rows of left and right share."""
    out = np.zeros((len(left), len(right)))
    where = np.full(n, -1)
    where[right] = np.arange(len(right))
    r = where[rows]
    where[:] = -1
    where[left] = np.arange(len(left))
    le = where[rows]
    both = np.intersect1d(np.unique(column[r >= 0]), np.unique(column[le >= 0]))
    for lo in range(0, len(both), width):
        use = both[lo : lo + width]
        at = np.minimum(np.searchsorted(use, column), len(use) - 1)
        in_use = use[at] == column
        x, y = np.zeros((len(left), len(use)), np.float32), np.zeros((len(right), len(use)), np.float32)
        m = in_use & (le >= 0)
        x[le[m], at[m]] = 1
        m = in_use & (r >= 0)
        y[r[m], at[m]] = 1
        out += x @ y.T
    return out


def compare(
    key: int, tokens: list[np.ndarray], keys: list[list[int]], copies: np.ndarray, side: np.ndarray, size: np.ndarray | None = None, shift: np.ndarray | None = None,
    similarity: Fraction = SIMILARITY, tile: int = 1024,
) -> tuple[np.ndarray, np.ndarray]:
    """(linked rows, least member of each one's part) of the sets of one task.

    side: 0 for all against all; else rows of side 1 against rows of side 2. A link counts here if `key` is the least key
    that both sets have; it joins parts in any case. With size and shift, tokens are differences from a pivot (see against_pivot).
    """
    n, given = len(tokens), np.array([len(t) for t in tokens])
    size = given if size is None else size
    shift = np.zeros(n) if shift is None else shift
    rows, column = np.repeat(np.arange(n), given), np.unique(np.concatenate(tokens), return_inverse=True)[1]
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], column[shared]
    lower = [(i, k) for i, own in enumerate(keys) for k in own if k < key]
    low_row = np.array([i for i, _ in lower], np.int64)
    low_column = np.unique(np.array([k for _, k in lower], np.int64), return_inverse=True)[1] if lower else low_row
    num, den = similarity.numerator, similarity.denominator
    links, parent = np.zeros(n, np.int64), np.arange(n)
    cut = lambda x: [x[i : i + tile] for i in range(0, len(x), tile)]
    one, two = (np.arange(n),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    for i, left in enumerate(cut(one)):
        for j, right in enumerate(cut(two)):
            if not side.any() and j < i:
                continue
            both = _overlaps(rows, column, n, left, right) + (shift[left][:, None] + shift[right][None, :])
            # both / (a + b - both) >= num / den
            ok = (num + den) * both >= num * (size[left][:, None] + size[right][None, :])
            ok &= both > 0
            if not side.any() and i == j:
                ok &= left[:, None] < right[None, :]
            a, b = np.nonzero(ok)
            _unite(parent, left[a], right[b])
            if lower:
                ok &= _overlaps(low_row, low_column, n, left, right) == 0
            links[left] += ok @ copies[right]
            links[right] += copies[left] @ ok
    return links, parent


def against_pivot(token: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, float]:
    """(what the set has not of the pivot, marked, and what it has besides; half the pivot's size less the first).

    Two sets share |pivot| tokens, less those that either has not, and again those that both have not and those that both have
    besides: the tokens that their differences share and the sum of their shifts.
    """
    lost = pivot[~np.isin(pivot, token, assume_unique=True)]
    return np.concatenate([lost ^ _LOST, token[~np.isin(token, pivot, assume_unique=True)]]), len(pivot) / 2 - len(lost)


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tokens, pivot, n, shift, ...) with tokens as differences from the pivot."""
    for b in batches:
        got = [against_pivot(np.frombuffer(t.as_py(), _U), np.frombuffer(p.as_py(), _U)) for t, p in zip(b.column(0), b.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d, _ in got], pa.binary()), b.column(2), pa.array([x for _, x in got], pa.float64()), *b.columns[4:]], names=["tokens", *b.schema.names[2:]])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j) to (tid, root, links), one for each set that is linked."""

    def done(group: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        key, i, j = group
        held.sort(key=lambda r: r[0])
        side = np.zeros(len(held), np.int8) if i == j else np.array([1 if r[4] == i else 2 for r in held], np.int8)
        links, parent = compare(key, [np.frombuffer(r[3], _U) for r in held], [r[2] for r in held], np.array([r[1] for r in held], np.int64), side, np.array([r[5] for r in held]), np.array([r[6] for r in held]))
        at = np.flatnonzero((links > 0) | (parent != np.arange(len(held))))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in at]), pa.array([held[parent[k]][0] for k in at]), pa.array(links[at])], names=["tid", "root", "links"])

    group, held = None, []
    for b in batches:
        cols = [b.column(b.schema.names.index(c)) for c in ("key", "i", "j", "tid", "copies", "keys", "tokens", "block", "n", "shift")]
        for row in zip(*[c.to_pylist() if k != 6 else c for k, c in enumerate(cols)]):
            if row[:3] != group:
                if group is not None:
                    yield from done(group, held)
                group, held = row[:3], []
            held.append((row[3], row[4], row[5], row[6].as_py(), *row[7:]))
    if group is not None:
        yield from done(group, held)
    released()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, ...) with the sorted shingles of the text in its place."""
    for b in batches_of(batches):
        token, first = shingle_sets(b.column(0))
        raw = [token[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), *b.columns[1:]], names=["tokens", *b.schema.names[1:]])


def _comparisons(once: DataFrame, mine: DataFrame) -> DataFrame:
    """Rows (key, i, j, block, tid, copies, keys, tokens, n, shift) of all comparison tasks, dealt and sorted by (key, i, j).

    once: (tid, text); mine: (tid, copies, groups array<struct(key, blocks, big)>). Small groups are one task each; of big ones
    each pair of blocks (i <= j) is one.
    """
    parts = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sets_of(big: bool) -> DataFrame:
        own = mine.select("tid", "copies", F.col("groups.key").alias("keys"), F.filter("groups", lambda g: g["big"] == big).alias("groups")).filter(F.size("groups") > 0)
        sets = once.join(own, "tid").select("text", "tid", "copies", "keys", "groups")
        sets = sets.mapInArrow(_tokens, f"tokens binary, tid string, copies long, keys array<long>, groups {mine.schema['groups'].dataType.simpleString()}")
        return sets.withColumn("g", F.explode("groups")).select("tokens", "tid", "copies", "keys", "g.key", "g.blocks", F.expr("octet_length(tokens) div 8").cast("long").alias("n"))

    zero = F.lit(0)
    place = F.pmod(F.xxhash64("key"), F.lit(parts))
    columns = ["key", "i", "j", "block", "tid", "copies", "keys", "tokens", "n", "shift"]
    out = sets_of(False).select("*", zero.alias("i"), zero.alias("j"), zero.alias("block"), F.lit(0.0).alias("shift")).select(*columns, place.cast("int").alias("place"))
    if mine.filter(F.exists("groups", lambda g: g["big"])).take(1):
        big = sets_of(True).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
        # a copy of the pivot for each block, so that no task joins a whole group
        pivots = big.groupBy("key", "blocks").agg(F.min_by("tokens", "tid").alias("pivot")).select("key", "pivot", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
        rows = big.join(pivots, ["key", "block"]).select("tokens", "pivot", "n", F.lit(0.0).alias("shift"), "tid", "copies", "keys", "key", "block", "blocks")
        rows = rows.mapInArrow(_against, "tokens binary, n long, shift double, tid string, copies long, keys array<long>, key long, block int, blocks int")
        rows = rows.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        out = out.union(rows.select(*columns, F.pmod(place + F.expr("j * (j + 1) div 2 + i"), F.lit(parts)).cast("int").alias("place")))
    return out.repartitionById(parts, "place").drop("place").sortWithinPartitions("key", "i", "j")


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for all nodes of edges (u, v): root is the least node that is connected.

    First each node is hung on its least neighbour below it, and its other neighbours below are linked with that one instead,
    until every node has one parent; then parents are replaced by their parents until all are roots. Rounds are written tables,
    and only whether any row is left comes to the driver. Edges of one comparison are stars already, so rounds are few.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most):
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        other = written(now.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "other")
        if not other.take(1):
            break
        now = written(least.select("u", F.col("m").alias("v")).union(other).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    for _ in range(most):
        up = now.select(F.col("u").alias("v"), F.col("v").alias("top"))
        if not now.join(up, "v", "left_semi").take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        now = written(now.join(up, "v", "left").select("u", F.coalesce("top", "v").alias("v")), "edges")
    raise RuntimeError(f"components did not settle in {most} rounds")


def join_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL, limit: int = LIMIT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per different text: (tid, copies, rep, root, class_id, n_links), as a table.

    tid: MD5 of the text; rep: the least id of its copies; root: the least tid of its class; n_links: other documents, copies
    included, at the similarity or above. Texts with equal sets are joined as one, under the least tid of theirs.
    """
    rows = docs.select(F.md5(text_of(text).cast("binary")).alias("tid"), F.col(doc_id).alias("id"), text_of(text).alias("text"))
    paths_of = [c for d in range(1, DEPTH + 1) for c in ((f"k{d}", f"p{d}") if d > 1 else ("k1",))]
    signed = _signatures(rows, runs_by_size(recall, DEPTH))
    texts = written(signed.groupBy("tid").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("sid", "n", *paths_of)]), "texts")
    same = texts.groupBy("sid").agg(F.min("tid").alias("head"), F.sum("copies").alias("all"), F.min("rep").alias("least_rep"), (F.count("*") > 1).alias("more"))
    sets_of = written(same, "sets")
    twins = texts.select("sid", "tid").join(sets_of.filter("more"), "sid").filter("tid <> head").select("tid")
    nodes = texts.join(written(twins, "twins"), "tid", "left_anti")
    heads = sets_of.select(F.col("head").alias("tid"), F.col("all").alias("copies"), F.col("least_rep").alias("rep"))
    # about as many pairs of blocks as partitions, if blocks do not get small, and no block over BLOCK_TOKENS
    even = int((math.sqrt(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1) - 1) / 2)
    big = (F.col("sets") > limit) | (F.col("tokens") > BLOCK_TOKENS)
    blocks = F.when(big, F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.least(F.lit(even), F.ceil(F.col("sets") / block_sets)))).otherwise(1).cast("int")
    mine = _groups(nodes, limit).groupBy("tid").agg(F.collect_list(F.struct("key", blocks.alias("blocks"), big.alias("big"))).alias("groups"))
    mine = written(mine.join(heads.select("tid", "copies"), "tid"), "compared")
    once = rows.groupBy("tid").agg(F.first("text").alias("text"))
    linked = written(_comparisons(once, mine).mapInArrow(_verify, "tid string, root string, links long"), "linked")
    parts = components(linked.select(F.col("tid").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("tid").agg(F.sum("links").alias("links"))
    reps = parts.select(F.col("node").alias("tid"), "root").join(heads.select("tid", "rep"), "tid")
    named = reps.join(written(reps.groupBy("root").agg(F.min("rep").alias("class_id")), "classes"), "root").select(F.col("tid").alias("head"), "root", "class_id")
    links = links.withColumnRenamed("tid", "head")
    out = texts.select("tid", "copies", "rep", "sid").join(sets_of.drop("more"), "sid").join(named, "head", "left").join(links, "head", "left")
    return written(
        out.select(
            "tid", "copies", "rep", F.coalesce("root", "head").alias("root"), F.coalesce("class_id", "least_rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("all") - 1).alias("n_links")
        ),
        "classes",
    )


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_links) of every row; options: recall, limit and block_sets."""
    nodes = join_nodes(docs, doc_id, text, **options)
    return docs.select(F.col(doc_id), F.md5(text_of(text).cast("binary")).alias("tid")).join(nodes.select("tid", "class_id", "n_links"), "tid").drop("tid")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that stay when one row of each class does: that of the least id (and text address, if it repeats)."""
    nodes = join_nodes(docs, doc_id, text, **options)
    stays = written(nodes.filter(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("tid", "rep")).alias("s")).select("s.tid", "s.rep"), "stays")
    tid = clash_free(docs.columns, "__tid")
    marked = docs.withColumn(tid, F.md5(text_of(text).cast("binary")))
    kept = marked.join(stays, (marked[tid] == stays["tid"]) & marked[doc_id].eqNullSafe(stays["rep"]), "left_semi")
    return kept.dropDuplicates([tid]).drop(tid)


def op2_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: all pairs that share a shingle, compared exactly; the join finds the same links but for a chance of 1 - recall at the threshold
OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
i AS (SELECT doc_id, w, least({SHINGLE}, len(w)) AS k, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 9 * c >= 4 * (na.n + nb.n)
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.x = b.x AND a.doc_id < b.doc_id
),
e AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS class_id FROM r GROUP BY 1),
l AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(l.n, 0) AS n_links FROM d LEFT JOIN m ON m.node = doc_id LEFT JOIN l ON l.a = doc_id
"""
