"""Token ids in raw files, and a minimal perfect hash index from record keys to places in them.

Files. Records are dealt by ranges of their ids, encoded in order and packed into shards; a shard is one file: the ids of its records one after
the other, each as an unsigned little-endian number of 2 or 4 bytes, then a footer (an Arrow stream of keys and counts, its length as 8
bytes, and MAGIC). Spark's own text writer commits the files, with MAGIC as the end of a line, to any file system that it knows; binaryFile reads
them. Shards are numbered in the order of the records.

Index. A key is a record's id and its number among records with equal ids. Keys are dealt to buckets by a 64-bit hash. In a bucket each level has
a bitmap of twice as many places as there are keys left: keys alone at their place are settled there, the rest go to the next level. A
key's slot is the rank of its bit, so that n keys have the slots 0 to n - 1; a slot holds the key's fingerprint of 64 bits, shard, offset and
count. A look-up reads some bits and one slot, whatever the number of keys; a key that isn't there has another fingerprint (but for one in 2^64).

Encoding. A byte-level tokenizer makes pre-tokens by a pattern that never looks back, so a text can be cut where one ends for certain (cuts); what
lies between two cuts is encoded once by a worker while it is among the KNOWN to 2 * KNOWN seen last, and its ids are joined.

Defined cases: a null or empty text has the end id only; records with equal ids, a null id among them (first in order), stand side by side by
hash of text and keep one key each; an id asked for in vain gives a row with found = false; a text of any length is one record; an empty table
gives no files, an empty index and no rows; only id and text are read, so other columns can't clash. ids must be of a type that Spark can order.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm import kernel
from tallyline.llm.common import Recent, batches_of, released, table, text_of, written
from tallyline.llm.kernel import mix
from tallyline.operators.tables import shared_dir

MAGIC = "IDSHARD1"
#: a shard has so many bytes of ids, or one record more, and so many records at most
SHARD_BYTES, SHARD_RECORDS = 8_000_000, 50_000
#: parts of texts that a worker keeps at hand, about 50 MB
KNOWN = 250_000
#: keys of a bucket of the index, on average
BUCKET_KEYS = 4096
_U = np.uint64


def _tokenizer(raw: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(raw)


def width_of(raw: bytes, end: int) -> int:
    """Bytes of an id: 2 where all ids fit."""
    return 2 if max(_tokenizer(raw).get_vocab_size() - 1, end) < 1 << 16 else 4


def cuts_are_safe(raw: bytes) -> bool:
    """Whether texts can be cut before spaces: byte-level pre-tokens by the usual pattern, no normaliser, and no added token with white space."""
    t = json.loads(raw)
    pre = t.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not t.get("normalizer") and not t.get("truncation")
    return bool(plain and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in t.get("added_tokens", [])))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the parts of all texts: a text's start, a single space between two characters that are no white space, and an ASCII character
    that is no letter behind one that is. A pre-token ends at each, and none looks back. Of other characters only the Latin letters below U+0100 count
    as no white space; where in doubt, parts are longer."""
    ascii_, letter = data < 128, ((data | 32) >= 97) & ((data | 32) <= 122)
    solid = ascii_ & (data != 32) & ~((data >= 9) & (data <= 13)) & ~((data >= 28) & (data <= 31))
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[1:] >= 128) & (data[:-1] == 0xC3)
    start = np.zeros(len(data), bool)
    start[1:-1] = (data[1:-1] == 32) & (solid | latin)[:-2] & (solid | (data == 0xC3))[2:]
    start[1:] |= letter[:-1] & ascii_[1:] & ~letter[1:]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


class Encoder:
    """Texts to ids; parts of texts are encoded once while they are among those seen last."""

    def __init__(self, raw: bytes, end: int, known: int = KNOWN):
        self.tokenizer, self.safe, self.kind, self.end = _tokenizer(raw), cuts_are_safe(raw), np.dtype(f"<u{width_of(raw, end)}"), end
        n = self.tokenizer.get_vocab_size()
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)])  # a byte-level token has a letter a byte
        self.seen, self.added = Recent(known), [a["content"].encode() for a in json.loads(raw).get("added_tokens", [])]

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, words: list[str]) -> list[bytes]:
        """The ids of each part. Parts that begin with one space before, and end with, other characters are encoded in one text, which is cut at them anew."""
        joined = [i for i, w in enumerate(words) if w[0] == " " and not w[-1].isspace() and not w[1:2].isspace()]
        out = [b""] * len(words)
        if self.safe and joined:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([words[i] for i in joined])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum([len(words[i].encode()) for i in joined])
            place = np.searchsorted(np.cumsum(self.size[ids]), ends)
            raw, step = ids.tobytes(), self.kind.itemsize
            for i, lo, hi in zip(joined, np.concatenate([[0], place[:-1] + 1]).tolist(), (place + 1).tolist()):
                out[i] = raw[lo * step : hi * step]
        rest = [i for i, x in enumerate(out) if not x]
        for i, x in zip(rest, self.plain([words[i] for i in rest])):
            out[i] = x
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, `end` behind each; ids of each text)."""
        data, offsets = kernel.text_bytes(column)
        whole = not self.safe or any(t in data.tobytes() for t in self.added)  # a token may not be cut
        starts = offsets[:-1][np.diff(offsets) > 0] if whole else cuts(data, offsets)
        parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        code, words = parts.indices.to_numpy(), parts.dictionary.to_pylist()
        got = [self.seen.get(w) for w in words]
        new = [i for i, g in enumerate(got) if g is None]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for i, ids in zip(some, (self.plain if whole else self.parts)([words[i] for i in some])):
                got[i] = ids
                if len(words[i]) <= 64:  # a longer one is hardly seen again
                    self.seen.put(words[i], ids)
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        ids, before = np.frombuffer(b"".join(got), self.kind), np.cumsum(size) - size
        # an end id stands behind the last part of each text
        n = size[code]
        first = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(total[first]) + 1
        out = np.full(int(counts.sum()), self.end, self.kind)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        to = total[:-1] + text
        step = np.arange(int(n.sum())) - np.repeat(total[:-1], n)
        out[np.repeat(to, n) + step] = ids[np.repeat(before[code], n) + step]
        return out, counts


@lru_cache(maxsize=1)
def _encoder(raw: bytes, end: int) -> Encoder:
    """The encoder of a Python worker, which later tasks find with what it has seen."""
    return Encoder(raw, end)


def write_shards(docs: DataFrame, tokenizer_path: str, end: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_records: int = SHARD_RECORDS) -> tuple[str, int]:
    """(folder, width of an id): the ids of all texts, `end` behind each, in ascending order of doc_id; `folder` must not exist yet.

    The texts are shuffled once, by ranges, and encoded where they arrive. Records with equal ids are spread over ranges by the hash of their
    text and by their place, so that no task holds them all.
    """
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    width = width_of(raw, end)
    folder = folder or f"{shared_dir(docs.sparkSession)}/ids-{uuid4().hex}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(raw, end), TaskContext.get().partitionId() << 20
        ids, counts, payload, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            footer = pa.record_batch([pa.chunked_array(ids).combine_chunks(), pa.array(np.concatenate(counts))], names=["id", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, footer.schema) as stream:
                stream.write_batch(footer)
            tail = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b"".join([*payload, tail, len(tail).to_bytes(8, "little")])], pa.binary())], names=["shard", "value"])

        for b in batches_of(batches, 6.0):
            got, n = encoder(b.column(1))
            ends, at = np.concatenate([[0], np.cumsum(n)]), 0
            while at < b.num_rows:  # up to the record that fills the shard
                held = sum(map(len, counts))
                to = min(b.num_rows, at + shard_records - held, 1 + int(np.searchsorted(ends[1:], ends[at] + (shard_bytes - size) / width)))
                ids.append(b.column(0).slice(at, to - at))
                counts.append(n[at:to])
                payload.append(got[ends[at] : ends[to]].tobytes())
                size += len(payload[-1])
                if size >= shard_bytes or held + to - at >= shard_records:
                    yield shard()
                    number += 1
                    ids, counts, payload, size = [], [], [], 0
                at = to
            del got, b
        if ids:
            yield shard()
            ids, counts, payload = [], [], []
        released()

    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    order = ["id", "h", "place"]
    dealt = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place")).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = dealt.select(F.col("id").cast("string"), "text").mapInArrow(pack, "shard long, value binary")
    packed.select("shard", F.col("value").cast("string")).write.partitionBy("shard").option("lineSep", MAGIC).text(folder)
    return folder, width


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, content)."""
    return spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"/shard=(\d+)/[^/]*$", 1).cast("long").alias("shard"), "content")


def _footer(content: pa.BinaryScalar) -> pa.RecordBatch:
    raw = content.as_buffer()
    if raw.slice(raw.size - len(MAGIC)).to_pybytes() != MAGIC.encode():
        raise ValueError("not a file of ids, or cut off")
    at = raw.size - len(MAGIC) - 8
    size = int.from_bytes(raw.slice(at, 8).to_pybytes(), "little")
    return pa.ipc.open_stream(raw.slice(at - size, size)).read_next_batch()


def records(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(shard, id string, nth, n_first, offset, n, crc32) of each record, read from the files: its number among records of the shard with equal ids, how many
    of them there are where they are the shard's first (else 0), ids before it in the shard, ids, and the unsigned crc32 of the ids as 4 bytes each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0), b.column(1)):
                footer, data = _footer(content), memoryview(content.as_buffer())
                n, keys = footer.column(1).to_numpy(), footer.column(0)
                end = np.cumsum(n)
                codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
                head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                runs = np.diff(np.append(head, len(codes)))
                nth = np.arange(len(codes)) - np.repeat(head, runs)
                first = np.where(np.arange(len(codes)) < runs[0], runs[0], 0)
                ids = np.frombuffer(data, f"<u{width}", int(end[-1]))
                crc = [zlib.crc32(ids[e - k : e].astype("<u4")) for e, k in zip(end.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * len(n), pa.int64()), keys, pa.array(nth), pa.array(first.astype(np.int64)), pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["shard", "id", "nth", "n_first", "offset", "n", "crc32"],
                )
                del data, ids, footer, content
        released()

    return _files(spark, folder).mapInArrow(read, "shard long, id string, nth long, n_first long, offset long, n long, crc32 long")


def shard_starts(read: DataFrame) -> DataFrame:
    """(shard, start): the ids of all shards before. One row a shard, which is what a single task sums up: 12 million of 8 MB for 100 TB of ids."""
    each = read.groupBy("shard").agg(F.sum("n").alias("n"))
    return each.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def numbered(read: DataFrame) -> DataFrame:
    """The records with `k`, their number among all with equal ids.

    A shard's first id may have begun in earlier shards: as the last id of each of them, which is one row a shard.
    """
    last = F.max_by(F.struct("id", "nth"), "offset")
    ends = read.groupBy("shard").agg(F.min_by("id", "offset").alias("first"), last.alias("last"))
    tails = F.struct(F.col("last.id").alias("id"), (F.col("last.nth") + 1).alias("rows"), F.lit(False).alias("asks"))
    heads = F.struct(F.col("first").alias("id"), F.lit(0).cast("long").alias("rows"), F.lit(True).alias("asks"))
    runs = ends.select("shard", F.inline(F.array(heads, tails)))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("id").orderBy("shard").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = runs.withColumn("before", before).filter("asks").select("shard", F.lit(True).alias("is_first"), "before")
    own = read.withColumn("is_first", F.col("n_first") > 0)
    return own.join(carried, ["shard", "is_first"], "left").withColumn("k", F.col("nth") + F.coalesce("before", F.lit(0))).drop("is_first", "before")


def _hashes(key: Column, k: Column) -> tuple[Column, Column]:
    """(hash, fingerprint) of a key."""
    return F.xxhash64(F.coalesce(key, F.lit("\x00null")), k), F.xxhash64(k, F.lit(7), F.coalesce(key, F.lit("\x00null")))


def _place(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + mix(f + _U(level) * _U(0x9E3779B97F4A7C15))) % _U(size)).astype(np.int64)


def perfect(h: np.ndarray, f: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(words of each level, bitmap of all levels, slot of each key)."""
    left, sizes, maps, at, slot = np.arange(len(h)), [], [], 0, np.zeros(len(h), np.int64)
    while len(left):
        if len(sizes) == 64:
            raise ValueError("two keys have the same 128 bits of hash, or stand in the list twice")
        size = max(64, -(-2 * len(left) // 64) * 64)
        place = _place(h[left], f[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        settled = alone[place]
        slot[left[settled]] = at + place[settled]
        left, at = left[~settled], at + size
        sizes.append(size // 64)
        maps.append(np.packbits(alone, bitorder="little").view("<u8"))
    words = np.concatenate(maps) if maps else np.zeros(0, "<u8")
    return sizes, words, rank(words, slot)


def rank(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The number of ones before each bit."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    w = bit >> 6
    return before[w] + np.bitwise_count(words[w] & ((_U(1) << (bit & 63).astype(_U)) - _U(1)))


def slots_of(sizes: list[int], words: np.ndarray, h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has it."""
    bit, left, at = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, n in enumerate(sizes):
        place = at + _place(h[left], f[left], level, n * 64)
        on = (words[place >> 6] >> (place & 63).astype(_U)) & _U(1) == 1
        bit[left[on]] = place[on]
        left, at = left[~on], at + n * 64
    out = np.full(len(h), -1, np.int64)
    out[bit >= 0] = rank(words, bit[bit >= 0])
    return out


INDEX = "bucket int, n_buckets int, sizes array<int>, bits binary, prints binary, shards binary, offsets binary, counts binary"


def build_index(entries: DataFrame) -> DataFrame:
    """One row a bucket, from (id string, k, shard, offset, n) with distinct (id, k). The number of entries comes to the driver."""
    n = max(1, round(entries.count() / BUCKET_KEYS))
    h, f = _hashes(F.col("id"), F.col("k"))
    keyed = entries.select(h.alias("h"), f.alias("f"), "shard", "offset", "n").withColumn("bucket", F.pmod("h", F.lit(n)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        h, f = (t.column(c).to_numpy().view(_U) for c in ("h", "f"))
        sizes, words, slot = perfect(h, f)
        order = np.argsort(slot)
        held = [f[order].tobytes(), *[t.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("shard", "offset", "n")]]
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "n_buckets": pa.array([n], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())), **{k: pa.array([v], pa.binary()) for k, v in zip(("bits", "prints", "shards", "offsets", "counts"), (words.tobytes(), *held))}})

    return keyed.groupBy("bucket").applyInArrow(build, INDEX)


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, k, found, shard, offset, n) of each different (id string, k); the index says how many buckets it has."""
    n = index.select("n_buckets").first()
    n = n[0] if n else 1
    h, f = _hashes(F.col("id"), F.col("k"))
    asked = keys.select(F.col("id").cast("string"), F.col("k").cast("long")).distinct().select("id", "k", h.alias("h"), f.alias("f")).withColumn("bucket", F.pmod("h", F.lit(n)).cast("int"))
    schema = "id string, k long, found boolean, shard long, offset long, n long"

    def find(keys: pa.Table, index: pa.Table) -> pa.Table:
        h, f = (keys.column(c).to_numpy().view(_U) for c in ("h", "f"))
        places, hit = np.zeros((3, len(h)), np.int64), np.zeros(len(h), bool)
        if index.num_rows:
            row = {c: index.column(c)[0].as_py() for c in index.column_names}
            slot = slots_of(row["sizes"], np.frombuffer(row["bits"], "<u8"), h, f)
            hit = slot >= 0
            hit[hit] = np.frombuffer(row["prints"], "<u8")[slot[hit]] == f[hit]
            for out, c in zip(places, ("shards", "offsets", "counts")):
                out[hit] = np.frombuffer(row[c], "<i8")[slot[hit]]
        return pa.table([keys.column("id"), keys.column("k"), pa.array(hit), *[pa.array(p, pa.int64(), mask=~hit) for p in places]], names=["id", "k", "found", "shard", "offset", "n"])

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, schema)


def fetch(spark: SparkSession, folder: str, width: int, index: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, k, ids array<long>) of the keys that are found: only shards that hold one are read, and cut at the places in the index."""
    found = lookup(index, keys).filter("found").groupBy("shard").agg(F.collect_list(F.struct("id", "k", "offset", "n")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, asked in zip(b.column(0), b.column(1).to_pylist()):
                data = memoryview(content.as_buffer())
                for a in asked:
                    ids = np.frombuffer(data, f"<u{width}", a["n"], a["offset"] * width)
                    yield pa.RecordBatch.from_arrays([pa.array([a["id"]], pa.string()), pa.array([a["k"]], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["id", "k", "ids"])

    return _files(spark, folder).join(found, "shard").select("content", "asked").mapInArrow(cut, "id string, k long, ids array<long>")


def all_keys(docs: DataFrame, doc_id: str = "doc_id", many: int = 10_000) -> DataFrame:
    """(id of its own type, k) of all records: counts by id, unfolded in two steps, so that no task unfolds all records of an id."""
    counts = docs.groupBy(F.col(doc_id).alias("id")).agg(F.count("*").alias("n"))
    blocks = counts.select("id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / many))).alias("b")).repartition("id", "b")
    return blocks.select("id", F.explode(F.sequence(F.col("b") * many, F.least(F.col("n"), (F.col("b") + 1) * many) - 1)).alias("k"))


def op11_perfect_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all documents, each looked up by its key, with what the files hold at the place that the index names."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder, width = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    read = written(records(spark, folder, width), "records")
    index = written(build_index(numbered(read)), "index")
    keys = all_keys(docs)
    found = lookup(index, keys).filter("found")
    there = found.join(read.select("shard", "offset", "n", "crc32"), ["shard", "offset", "n"]).join(shard_starts(read), "shard")
    return there.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), (F.col("start") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
