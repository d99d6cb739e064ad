"""Token files and their perfect hash index against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import idfiles
from tests.llm.conftest import words

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def run(spark, docs, **sizes):
    folder, width = idfiles.write_shards(docs, PATH, 2, **sizes)
    read = idfiles.written(idfiles.records(spark, folder, width), "records")
    index = idfiles.written(idfiles.build_index(idfiles.numbered(read)), "index")
    return folder, width, read, index


def test_every_record_against_the_tokenizer(spark, odd, odd_texts):
    """Odd texts, null and repeated ids, many shards: places, counts, checksums and fetched ids."""
    docs = odd.repartition(3)
    folder, width, read, index = run(spark, docs, shard_bytes=3000, shard_records=4)
    assert width == 2 and read.select("shard").distinct().count() > 3
    keys = idfiles.all_keys(docs)
    found = idfiles.lookup(index, keys)
    assert found.filter("not found").count() == 0 and found.count() == docs.count() == found.select("shard", "offset").distinct().count()
    start = {r.shard: r.start for r in idfiles.shard_starts(read).collect()}
    crc = {(r.shard, r.offset): (r.n, r.crc32) for r in read.collect()}
    got = sorted(((-1 if r.id is None else int(r.id)), start[r.shard] + r.offset, *crc[r.shard, r.offset]) for r in found.collect())
    rows = docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    want, at = [], 0
    for r, ids in zip(rows, plain([r.text for r in rows])):
        want.append((-1 if r.doc_id is None else r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    fetched = sorted((r.id or "", list(r.ids)) for r in idfiles.fetch(spark, folder, width, index, keys.withColumn("id", F.col("id").cast("string"))).collect())
    assert fetched == sorted(("" if r.doc_id is None else str(r.doc_id), ids) for r, ids in zip(rows, plain([r.text for r in rows])))


def test_one_id_over_many_shards(spark):
    """A third of the rows share one id, and a third have none: each keeps a key of its own, numbered without gaps."""
    docs = spark.range(600).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("same text "), (F.col("id") % 2).cast("string")).alias("text"))
    _, _, read, index = run(spark, docs, shard_records=17)
    got = idfiles.numbered(read)
    assert {r.id: (r.n, r.least, r.most) for r in got.groupBy("id").agg(F.countDistinct("k").alias("n"), F.min("k").alias("least"), F.max("k").alias("most")).collect() if r.id in (None, "7")} == {None: (200, 0, 199), "7": (200, 0, 199)}
    assert idfiles.lookup(index, idfiles.all_keys(docs, many=30)).filter("found").count() == 600


def test_keys_that_are_not_there(spark, odd):
    _, _, _, index = run(spark, odd)
    keys = spark.createDataFrame([("1", 0), ("1", 5), ("nobody", 0), ("1", 0)], "id string, k long")
    assert sorted((r.id, r.k, r.found, r.n is not None) for r in idfiles.lookup(index, keys).collect()) == [("1", 0, True, True), ("1", 5, False, False), ("nobody", 0, False, False)]


def test_no_rows(spark, none):
    folder, width, read, index = run(spark, none)
    assert read.count() == 0 and index.count() == 0 and idfiles.shard_starts(read).count() == 0
    keys = spark.createDataFrame([("1", 0)], "id string, k long")
    assert [r.found for r in idfiles.lookup(index, keys).collect()] == [False]
    assert idfiles.fetch(spark, folder, width, index, keys).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_slots_are_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    h, f = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 64, n, np.uint64)
    sizes, bits, slot = idfiles.perfect(h, f)
    assert sorted(slot.tolist()) == list(range(n)) and (idfiles.slots_of(sizes, bits, h, f) == slot).all()
    assert n < 5000 or len(bits) * 64 < 5 * n


def test_equal_keys_are_an_error():
    with pytest.raises(ValueError, match="128 bits"):
        idfiles.perfect(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_cuts_change_nothing():
    """Texts of white space of all kinds, marks, contractions, special tokens and several MB."""
    rng = random.Random(5)
    glue = [" ", "  ", "\n", "\t ", " \n", " ", "\x1c", "\x85", "  ", "'s ", "'ll", "<|endoftext|> ", " 　", "\r\n", ""]
    texts = ["".join(words(rng, 1) + rng.choice(glue) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "  a", "a  ", "é \U0001f600 日本 語", "don't, it's we'll x'y 'tis 12ab,34 a_b-c", "x" * 100_000, words(rng, 400_000, 5000)]
    with open(PATH, "rb") as f:
        encoder = idfiles.Encoder(f.read(), 2, 50)
    assert encoder.safe
    tame = [x for x in texts if "<|" not in (x or "")]
    for some in (tame, texts, [], [""], [None]):
        ids, n = encoder(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(some)] == plain(some)


@pytest.mark.parametrize("seed", range(4))
def test_any_characters(seed):
    """Strings of white space, letters, digits, marks and other scripts in any order."""
    rng = random.Random(seed)
    signs = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000", *"abZ'séÀ×ñß", *"09.,;'!?-_$|<", "日", "\U0001f600", "\u0301", "ſ", "Ω", "\x00", "\ufeff"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    with open(PATH, "rb") as f:
        ids, n = idfiles.Encoder(f.read(), 2)(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == plain(texts)


def test_a_cut_file_is_an_error(spark, odd, tmp_path):
    import glob

    folder = str(tmp_path / "ids")
    idfiles.write_shards(odd, PATH, 2, folder)
    one = glob.glob(f"{folder}/shard=*/part*")[0]
    with open(one, "rb") as f:
        raw = f.read()
    with open(one, "wb") as f:
        f.write(raw[:-3])
    for crc in glob.glob(f"{folder}/shard=*/.part*"):
        open(crc, "wb").close()
    with pytest.raises(Exception, match="cut off|hecksum"):
        idfiles.records(spark, folder, 2).collect()
