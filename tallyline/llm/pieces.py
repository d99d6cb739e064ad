"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of a model crosses a whitespace marker, a text is its marked words (a run of markers and what follows up to the
next), and each can be segmented alone. So:

1. texts are taken in blocks of about BLOCK_MB; the different chunks of a block are dealt to buckets by a hash, and its texts
   become sequences of numbers of chunks, the frequent ones low;
2. the chunk lists, not the texts, are shuffled by bucket; a bucket's task holds a table of its distinct chunks, segments each
   and checks what it decodes to, and answers each block in the order that the block asked;
3. answers join back to blocks by name, and ids to places in the texts by number; texts are decoded from their pieces' bytes.

A frequent chunk is asked for once by a block, however often it stands there, so no key is hot. A task's table holds the KNOWN
chunks asked for last, or twice so many; a chunk that it has let go is segmented again, with the same result. The answers that
meet in one row are those of one block.

Defined cases: a null or empty text has no pieces (only the end id, where one is asked for); a text of spaces has marker
pieces only; repeated rows, and whole files of them, are encoded each; a very long word is a chunk like others; an empty table gives no rows; of
the input's columns only the id is carried, so others can't clash, unless the id has the name of a result (n_tokens, ids, ...).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyline.llm import kernel
from tallyline.llm.common import Recent, batches_of, released, table, text_of

MARK = "▁"
BLOCK_MB = 8.0
#: chunks that a task keeps at hand, about 60 MB
KNOWN = 200_000
#: words of a text that are joined at once
SLICE = 1 << 17


def model_bytes(path: str) -> bytes:
    """The model file, after a check that its chunks can be segmented alone."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(raw)
    n, t = m.normalizer_spec, m.trainer_spec
    crossing = [p.piece for p in m.pieces if MARK in p.piece.lstrip(MARK)]
    symbols = [p.piece for p in m.pieces if p.type == p.USER_DEFINED]
    if crossing or symbols or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or t.treat_whitespace_as_suffix or not n.escape_whitespaces:
        raise ValueError(f"{path}: pieces may cross whitespace markers, or the text is rewritten first")
    return raw


def _processor(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def _surfaces(sp) -> list[bytes]:
    """What each piece stands for, in bytes; the few that stand for something else in a text are told apart by decoding it."""
    raw = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
    return [raw(i) for i in range(sp.get_piece_size())]


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(marked words of all texts with spaces for markers, number of words in each text)."""
    texts = pc.replace_substring(texts.fill_null(""), MARK, " ")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
    data, offsets = kernel.text_bytes(marked)
    space = data == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    own = offsets[:-1][np.diff(offsets) > 0]
    head[own] = True
    starts = np.flatnonzero(head)
    n = np.diff(np.searchsorted(starts, offsets))
    return _strings(data, np.append(starts, len(data))), n


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _packed(words: pa.Array) -> bytes:
    """The words' lengths in bytes, and the words one after the other, compressed."""
    data, offsets = kernel.text_bytes(words)
    lengths = _small(np.diff(offsets))
    return len(lengths).to_bytes(8, "little") + lengths + len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), "zstd", asbytes=True)


def _words_of(raw: bytes) -> pa.Array:
    at = 8 + int.from_bytes(raw[:8], "little")
    data = pa.decompress(raw[at + 8 :], int.from_bytes(raw[at : at + 8], "little"), "zstd", asbytes=True)
    return _strings(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(_large(raw[8:at]))]))


def _small(numbers: np.ndarray) -> bytes:
    """Numbers of 0 or more, packed: in one, two or three planes of a byte, as many as the greatest needs, and compressed."""
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    raw = b"".join(((numbers >> np.array(8 * k).astype(numbers.dtype)) & np.array(255).astype(numbers.dtype)).astype(np.uint8).tobytes() for k in range(planes))
    return bytes([planes]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _large(raw: bytes) -> np.ndarray:
    planes, size = raw[0], int.from_bytes(raw[1:9], "little")
    data = np.frombuffer(pa.decompress(raw[9:], size, "zstd", asbytes=True), np.uint8).reshape(planes, -1)
    out = data[0].astype(np.int64)
    for k in range(1, planes):
        out |= data[k].astype(np.int64) << (8 * k)
    return out


def _buckets(words: pa.Array, n: int) -> np.ndarray:
    data, offsets = kernel.text_bytes(words)
    return (kernel.hashes(data, offsets[:-1], offsets[1:], kernel.SPACE) % np.uint64(n)).astype(np.int64)


def _name(block: pa.RecordBatch, number: int) -> str:
    """The block's place in the input, which both readings share, and its content, which they must share: blocks of equal rows have names of their own."""
    data, offsets = kernel.text_bytes(block.column(1))
    h = hashlib.blake2b(data, digest_size=16)
    h.update(offsets.tobytes())
    h.update(repr(block.column(0).to_pylist()).encode())
    return f"{TaskContext.get().partitionId()}-{number}-{h.hexdigest()}"


def _numbered(block: pa.RecordBatch, n_buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(different words, the frequent ones first, bucket of each, the number of each word in the texts, words of each text)."""
    words, counts = chunks(block.column(1))
    coded = words.dictionary_encode()
    code, different = coded.indices.to_numpy(), coded.dictionary
    del words, coded
    order = np.argsort(-np.bincount(code, minlength=len(different)), kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    different = different.take(pa.array(order))
    return different, _buckets(different, n_buckets), number[code], counts


def ask_chunks(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(block, bucket, words): the different words of each block, in the order of their numbers, by bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(batches_of(batches, BLOCK_MB)):
            different, bucket, _, _ = _numbered(b, n_buckets)
            used = np.unique(bucket)
            words = [_packed(different.take(pa.array(np.flatnonzero(bucket == k)))) for k in used]
            yield pa.RecordBatch.from_arrays([pa.array([_name(b, number)] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(words, pa.binary())], names=["block", "bucket", "words"])

    return docs.select("id", "text").mapInArrow(ask, "block string, bucket int, words binary")


def block_table(docs: DataFrame, n_buckets: int) -> DataFrame:
    """One row a block: (block, ids, counts, sequence, dealt).

    counts: words of each text; sequence: numbers of the words of all texts; dealt: the bucket of each number. A block is named by
    its place, ids and texts, so that its row can be made anew after a loss, and meets the same answers.
    """
    kind = to_arrow_type(docs.schema["id"].dataType)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(batches_of(batches, BLOCK_MB)):
            _, bucket, sequence, counts = _numbered(b, n_buckets)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0).cast(kind))
            yield pa.RecordBatch.from_arrays([pa.array([_name(b, number)]), ids, pa.array([_small(counts)]), pa.array([_small(sequence)]), pa.array([_small(bucket)])], names=["block", "ids", "counts", "sequence", "dealt"])

    fields = [("block", T.StringType()), ("ids", T.ArrayType(docs.schema["id"].dataType)), ("counts", T.BinaryType()), ("sequence", T.BinaryType()), ("dealt", T.BinaryType())]
    return docs.select("id", "text").mapInArrow(build, T.StructType([T.StructField(*f) for f in fields]))


def segment_chunks(asked: DataFrame, raw: bytes, known: int = KNOWN) -> DataFrame:
    """(block, bucket, words) to (block, bucket, sizes, pieces, odd, forms), in the order asked.

    odd: places of the words that don't decode to the bytes of their pieces; forms: what those decode to.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(raw)
        surface, marker = _surfaces(sp), [sp.piece_to_id(MARK)]
        table = Recent(known)
        for b in batches:
            for block, bucket, packed in zip(*[c.to_pylist() for c in b.columns]):
                words = _words_of(packed).to_pylist()
                got = [table.get(w) for w in words]
                new = [i for i, g in enumerate(got) if g is None]
                ids = sp.encode([words[i][1:] for i in new], num_threads=1) if new else []  # the encoder puts the first marker back
                ids = [p if len(words[i]) > 1 else marker for i, p in zip(new, ids)]
                back = sp.decode(ids, num_threads=1) if ids else []
                ends = np.fromiter(accumulate(map(len, ids), initial=0), np.int64, len(ids) + 1)
                flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1])).tobytes()
                for i, own, s, lo, hi in zip(new, ids, back, (ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist()):
                    form = b" " + s.encode()
                    got[i] = (flat[lo:hi], None if form == b"".join([surface[p] for p in own]) else form)
                    table.put(words[i], got[i])
                sizes = np.fromiter((len(g[0]) for g in got), np.int64, len(got)) // 4
                odd = [i for i, g in enumerate(got) if g[1] is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([_small(sizes)]), pa.array([_small(np.frombuffer(b"".join([g[0] for g in got]), np.uint32))])]
                    + [pa.array([odd], pa.list_(pa.int32())), pa.array([[got[i][1] for i in odd]], pa.list_(pa.binary()))],
                    names=["block", "bucket", "sizes", "pieces", "odd", "forms"],
                )

    return asked.mapInArrow(answer, "block string, bucket int, sizes binary, pieces binary, odd array<int>, forms array<binary>")


def _by_number(answers: list[dict], dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
    """(ids of all words one after the other, start and end of each word's, forms of the odd ones), by the words' numbers."""
    answers = sorted(answers, key=lambda a: a["bucket"])
    place = np.argsort(dealt, kind="stable")  # numbers of the words, bucket by bucket
    sizes = [_large(a["sizes"]) for a in answers]
    size, before = np.concatenate([np.zeros(0, np.int64), *sizes]), accumulate(map(len, sizes), initial=0)
    if len(size) != len(place):
        raise ValueError("a block of texts has other words than when it asked for them: the input differs between two readings")
    odd = {int(place[at + i]): form for a, at in zip(answers, before) for i, form in zip(a["odd"], a["forms"])}
    start, end = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    end[place] = np.cumsum(size)
    start[place] = end[place] - size
    return np.concatenate([np.zeros(0, np.int32), *[_large(a["pieces"]).astype(np.int32) for a in answers]]), start, end, odd


def _joined(forms: np.ndarray, own: np.ndarray, tail: bytes = b"") -> Iterator[bytes]:
    """The forms of a text's words and the tail, without the first byte, in slices."""
    skip = 1
    for at in range(0, len(own), SLICE):
        yield b"".join(forms[own[at : at + SLICE]].tolist())[skip:]
        skip = 0
    yield tail[skip:]


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _texts(row: dict, surface: list[bytes], end_ids: list[int], digest: bool) -> Iterator[tuple]:
    """The result columns of each text of a block: (n_tokens, ids_sha256, decoded_sha256), or (ids, decoded)."""
    ids, start, end, odd = _by_number(row["answers"], _large(row["dealt"]))
    sequence, counts = _large(row["sequence"]).astype(np.int32), _large(row["counts"])
    bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
    size, spans = end - start, list(zip(start.tolist(), end.tolist()))
    flat = ids.tolist()
    forms = _objects([b"".join([surface[p] for p in flat[a:b]]) for a, b in spans])
    for i, form in odd.items():
        forms[i] = form
    if digest:
        decimal = [b" %d" % i for i in range(len(surface))]
        plain = _objects([b"".join([decimal[p] for p in flat[a:b]]) for a, b in spans])
        last = b"".join([b" %d" % i for i in end_ids])
    del flat, spans
    for lo, hi in zip(bounds, bounds[1:]):
        own = sequence[lo:hi]
        if digest:
            of_ids, of_text = hashlib.sha256(), hashlib.sha256()
            for part in _joined(plain, own, last):
                of_ids.update(part)
            for part in _joined(forms, own):
                of_text.update(part)
            yield int(size[own].sum()) + len(end_ids), of_ids.hexdigest(), of_text.hexdigest()
        else:
            n = size[own]
            at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield np.concatenate([ids[at], np.array(end_ids, np.int32)]), b"".join(_joined(forms, own)).decode()


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", end: bool = True, digest: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of each row or, with digest, (doc_id, n_tokens, ids_sha256, decoded_sha256).

    docs is read twice and must give the same batches each time, as a scan of files does; write it to a table first where it
    comes from a shuffle. Blocks that differ between the readings end the job with an error, never with other rows.
    """
    raw = model_bytes(model_path)
    spark = docs.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    asked = ask_chunks(rows, n_buckets).repartition(n_buckets, "bucket")
    answers = segment_chunks(asked, raw).groupBy("block").agg(F.collect_list(F.struct("bucket", "sizes", "pieces", "odd", "forms")).alias("answers"))
    last = [_processor(raw).eos_id()] if end else []
    id_type = docs.schema[doc_id].dataType
    result = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digest else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    schema = T.StructType([T.StructField(doc_id, id_type), *[T.StructField(*f) for f in result]])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = _surfaces(_processor(raw))

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=schema.names)

        for b in batches:
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}
                held, words = [], 0
                for own, n, got in zip(row["ids"], _large(row["counts"]).tolist(), _texts(row, surface, last, digest)):
                    held.append((own, *got))
                    words += n
                    if words >= SLICE:
                        yield batch(held)
                        held, words = [], 0
                if held:
                    yield batch(held)
        released()

    # a text without any words still has its block's row; a block without words at all has no answers
    joined = block_table(rows, n_buckets).join(answers, "block", "left").select("ids", "counts", "sequence", "dealt", F.coalesce("answers", F.array().cast(answers.schema["answers"].dataType)).alias("answers"))
    return joined.mapInArrow(rebuild, schema)


def op3_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
