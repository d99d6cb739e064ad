"""Each operator against a plain version of itself, and on odd, repeated and empty inputs."""

import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import chosenpath, common, fixity, kernel, language, leakage, pieces, quality, secrets, sharding, spans, toxicity

from .conftest import words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def test_kernel_words(odd_texts):
    data, offsets = kernel.text_bytes(pa.array(odd_texts, pa.string()))
    s, e, first = kernel.words(data, offsets, kernel.ALNUM)
    h = kernel.hashes(data, s, e, kernel.ALNUM, piece=1 << 10).tolist()
    flat = [w for t in odd_texts for w in WORD.findall(lower(t))]
    assert len(flat) == len(h) and len(set(zip(flat, h))) == len(set(flat)) == len(set(h))
    assert np.diff(first).tolist() == [len(WORD.findall(lower(t))) for t in odd_texts]


# 1: quality


def test_quality_counts(odd_texts):
    texts = [*odd_texts, "x y z x y z x y z", "a b\na b\n\n\na b ", "# $ &\n# $ &"]
    got = quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[k][i]) for k in quality.COUNTS[:5]) == want, t[:50]


def test_quality_verdicts(spark, odd, none):
    rng = random.Random(1)
    rows = [(i, words(rng, 120) + "." if i % 8 else " ".join(f"w{rng.randrange(99)}$$$" for _ in range(120))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 8 > 0) for r in got)
    assert quality.judge(odd, labels.limit(0)).count() == odd.count()
    assert quality.judge(none, labels).count() == 0


def test_forest_against_plain_walks():
    rng = np.random.default_rng(20)
    x = rng.normal(size=(300, 3))
    forest = quality.grow(x, trees=7, psi=64)

    def expected(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def walk(t, row):
        node, depth = 0, 0
        while forest.feature[t][node] >= 0:
            node, depth = (forest.left if row[forest.feature[t][node]] < forest.split[t][node] else forest.right)[t][node], depth + 1
        assert forest.path[t][node] >= depth
        return forest.path[t][node]

    odd = np.concatenate([x[:50], [[9.0, 9.0, 9.0]]])
    want = [2.0 ** (-sum(walk(t, r) for t in range(7)) / 7 / expected(64)) for r in odd]
    got = forest.scores(odd)
    assert np.allclose(got, want) and got.argmax() == 50


def test_forest_is_the_same_for_any_layout(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randrange(50, 90)) + (" # $ %" * 9 if i % 9 == 0 else ""), int(i % 9 != 0)) for i in range(300)]
    kept = []
    for k, order in enumerate((rows, rows[::-1])):
        docs = spark.createDataFrame([r[:2] for r in order], "doc_id long, text string").repartition(3 + k)
        labels = spark.createDataFrame([(r[0], r[2]) for r in order], "doc_id long, quality int")
        kept.append({(r.doc_id, r.score, r.kept) for r in quality.judge(docs, labels).collect()})
    assert kept[0] == kept[1]


# 2: chosen path


def test_paths_recall_and_runs():
    assert chosenpath.runs_for(0.99, 3) == 10
    rng = random.Random(2)
    base = words(rng, 300, 9999).split()
    near = list(base)
    near[150] = "changed"
    token, first = chosenpath.shingle_sets(pa.array([" ".join(base), " ".join(near), words(rng, 300, 9999)]))
    levels = chosenpath.paths(token, first, 10)
    keys = [set(levels[0][1][levels[0][0] == k].tolist()) for k in range(3)]
    assert keys[0] & keys[1] and not keys[0] & keys[2]


@pytest.mark.parametrize("limit, block_sets", [(1000, 512), (2, 512), (2, 2)])
def test_join(spark, odd, none, limit, block_sets):
    rng = random.Random(4)
    texts = []
    for g in range(6):
        base = words(rng, rng.choice([6, 40, 120]), 9999).split()
        for k in range(g + 1):
            w = list(base)
            if k and len(w) > 30:
                w[rng.randrange(len(w))] = f"edit{k}"
            texts.append(" ".join(w))
    texts += ["", None, "!!!", "same five words stand here", "same five words stand here", "Same five, words stand here"]
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, parent = [0] * len(texts), list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            both = len(sets[a] & sets[b])
            if same or (both and 5 * both >= 4 * len(sets[a] | sets[b])):
                n[a] += 1
                n[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosenpath.join_documents(docs, limit=limit, block_sets=block_sets).collect()}
    assert got == {i: (top(i), n[i]) for i in range(len(texts))}
    if limit == block_sets:
        kept = chosenpath.one_of_each(docs).collect()
        assert sorted(r.doc_id for r in kept) == sorted({top(i) for i in range(len(texts))})
        assert chosenpath.join_documents(odd).count() == odd.count()
        assert chosenpath.one_of_each(odd).columns == odd.columns
        assert {r["__tid"] for r in chosenpath.one_of_each(docs.withColumn("__tid", F.lit("mine"))).collect()} == {"mine"}
        assert chosenpath.join_documents(none).count() == 0


def test_join_small_sets(spark):
    texts = [" ".join(["one"] * k) for k in range(6, 12)]  # one shingle
    texts += [" ".join((["two", "words"] * 9)[:k]) for k in range(8, 14)]  # two shingles
    texts += ["a b c d e f", "A b c d e f", "a, b c d e f", "a b c  d e f.", "a b c d e f g", "!!!", "???"]
    docs = spark.createDataFrame([*enumerate(texts), (99, texts[0])], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosenpath.join_documents(docs, limit=2).collect()}
    want = {i: (0, 6) for i in [*range(6), 99]} | {i: (6, 5) for i in range(6, 12)} | {i: (12, 3) for i in range(12, 16)} | {i: (i, 0) for i in (16, 17, 18)}
    assert got == want
    assert sorted(r.doc_id for r in chosenpath.one_of_each(docs, limit=2).collect()) == [0, 6, 12, 16, 17, 18]


def test_recall_near_the_threshold(spark):
    """Of pairs between 0.8 and 0.84, told by brute force, nearly all are linked, whether buckets are large or not."""
    rng, texts = random.Random(18), []
    while len(texts) < 800:
        base = words(rng, rng.randrange(40, 160), 9999).split()
        near = list(base)
        for k in rng.sample(range(len(near)), max(1, round(len(near) * rng.uniform(0.018, 0.026)))):
            near[k] = f"edit{rng.randrange(9999)}"
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, near))
        if 0.8 <= len(one & two) / len(one | two) <= 0.84:
            texts += [" ".join(base), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosenpath.join_documents(docs).collect()}
    found = sum(got[i] == got[i + 1] == (i, 1) for i in range(0, len(texts), 2))
    assert found >= 0.97 * len(texts) / 2


def test_differences_from_a_pivot():
    rng = np.random.default_rng(19)
    base = np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(60) < p], rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)])) for p in rng.choice([0.0, 0.5, 0.93, 1.0], 50)]
    copies, keys, side = np.ones(50, np.int64), [[5]] * 50, np.zeros(50, np.int8)
    plain = chosenpath.compare(5, sets, keys, copies, side)
    for pivot in (sets[0], sets[7], base, np.zeros(0, np.uint64)):
        short = [chosenpath.against_pivot(x, pivot) for x in sets]
        got = chosenpath.compare(5, [d for d, _ in short], keys, copies, side, np.array([len(x) for x in sets]), np.array([x for _, x in short]), tile=9)
        assert (got[0] == plain[0]).all() and (got[1] == plain[1]).all() and plain[0].any()


@pytest.mark.parametrize("a, b", [(4, 5), (8, 10), (16, 20)])
def test_recall_of_small_sets(a, b):
    n, runs = 3000, chosenpath.runs_by_size(0.99, 3)
    assert runs[:4].tolist() == [0] * 4 and runs[-1] == 10
    token = np.sort(np.random.default_rng(8).integers(0, 1 << 63, (n, b)).astype(np.uint64), axis=1)
    both = np.concatenate([np.concatenate([x, x[:a]]) for x in token])
    size = np.tile([b, a], n)
    doc, key, _ = chosenpath.paths(both, np.concatenate([[0], np.cumsum(size)]), runs[size])[2]
    met = {(d // 2, k) for d, k in zip(doc.tolist(), key.tolist()) if d % 2} & {(d // 2, k) for d, k in zip(doc.tolist(), key.tolist()) if not d % 2}
    assert len({d for d, _ in met}) >= 0.985 * n


def test_compare_blocks():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.95], rng.integers(0, 1 << 63, 2).astype(np.uint64)])) for _ in range(30)]
    copies = rng.integers(1, 4, 30)
    keys = [[5]] * 30
    links, parent = chosenpath.compare(5, sets, keys, copies, np.zeros(30, np.int8), tile=7)
    want = [sum(int(copies[j]) for j in range(30) if j != i and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))) for i in range(30)]
    assert links.tolist() == want
    side = np.array([1] * 12 + [2] * 18, np.int8)
    cross, _ = chosenpath.compare(5, sets, keys, copies, side, tile=5)
    inner = [chosenpath.compare(5, [sets[i] for i in ids], [[5]] * len(ids), copies[ids], np.zeros(len(ids), np.int8))[0] for ids in (np.arange(12), np.arange(12, 30))]
    assert (cross + np.concatenate(inner)).tolist() == want
    lower_key, _ = chosenpath.compare(5, sets, [[3, 5]] * 30, copies, np.zeros(30, np.int8))
    assert not lower_key.any()  # those pairs count in bucket 3


def test_components(spark):
    rng = random.Random(6)
    edges = [(f"{rng.randrange(60):03d}", f"{rng.randrange(60):03d}") for _ in range(45)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(12)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in chosenpath.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


# 3: pieces


def test_pieces(spark, odd, none, odd_texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*odd_texts, "  two  ", "▁x▁▁y", "<s> </s> <0x41>", "é́ ﬁ １２", "tab\tx", " " * 40 + "z", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode(docs, path).collect():
        ids = sp.encode(texts[r.doc_id] or "") + [2]
        assert r.ids == ids and r.decoded == sp.decode(ids)
    for r in pieces.encode(docs, path, digest=True).collect():
        ids = sp.encode(texts[r.doc_id] or "") + [2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert pieces.encode(odd, path, end=False).count() == odd.count()
    assert pieces.encode(none, path).count() == 0


def test_pieces_let_go(spark):
    """A task that keeps two chunks at hand answers as one that keeps all, and the tables stay bounded."""
    import public_tokenizers

    raw = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, words(rng, 50, 30)) for i in range(20)], "id long, text string").repartition(4)
    asked = pieces.ask_chunks(docs, 3).cache()
    key = lambda df: sorted((r.block, r.bucket, bytes(r.sizes), bytes(r.pieces)) for r in df.collect())
    assert key(pieces.segment_chunks(asked.coalesce(1), raw, 2)) == key(pieces.segment_chunks(asked.coalesce(1), raw))
    table = common.Recent(3)
    for k in range(20):
        table.put(str(k), (k,))
        assert table.get(str(k)) == (k,) and len(table.new) <= 3 and len(table.old) <= 3
    assert table.get("0") is None


def test_pieces_of_a_changed_block(spark):
    with pytest.raises(ValueError, match="differs between two readings"):
        pieces._by_number([{"bucket": 0, "sizes": pieces._small(np.array([1])), "pieces": pieces._small(np.array([5])), "odd": [], "forms": []}], np.array([0, 0]))


# 4: secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _spans(x):
    x = x or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


SECRETS = [
    "é token = abcdefgh1", "TOKEN=short token=token=abcdefghij", "AKIAABCDEFGHIJKL AKIAAKIA AKIA", "a" * 31, "b" * 32 + " " + "0" * 40, "api_key: 'x' apikey:\"ABCDEFGH\" secret   =   'passwd=12345678'",
    "\U0001f600 password=12345678", "tokentokentoken:========", None, "", "token = " + "f" * 40,
]


def test_secrets(spark, odd, none):
    docs = spark.createDataFrame([*enumerate(SECRETS), (99, SECRETS[0])], "doc_id long, text string")
    entries, back = secrets.scan_versions(docs)
    assert {r.doc_id: r.d for r in back.select("doc_id", secrets.digest(F.col("spans")).alias("d")).collect()} == {**{i: _spans(x) for i, x in enumerate(SECRETS)}, 99: _spans(SECRETS[0])}
    assert entries.count() == len(set(x or "" for x in SECRETS))
    # the second scan finds all blobs but one in the ledger, and tells the old findings of paths that hold them
    more = spark.createDataFrame([(1, SECRETS[0]), (2, "new secret = zyxwvuts9")], "doc_id long, text string")
    added, again = secrets.scan_versions(more, ledger=entries)
    assert added.count() == 1
    assert {r.doc_id: r.d for r in again.select("doc_id", secrets.digest(F.col("spans")).alias("d")).collect()} == {1: _spans(SECRETS[0]), 2: _spans("new secret = zyxwvuts9")}
    other = entries.withColumn("rules_version", F.lit("older"))
    assert secrets.scan_versions(more, ledger=other)[0].count() == 2
    for r in secrets.mask(docs).collect():
        plain = dict([*enumerate(SECRETS), (99, SECRETS[0])])[r.doc_id]
        want = list(plain or "")
        for s in filter(None, _spans(plain).split(",")):
            _, a, b = s.rsplit(":", 2)
            want[int(a) : int(b)] = "*" * (int(b) - int(a))
        assert (r.text or "") == "".join(want) and (r.text is None) == (plain is None)
    assert secrets.mask(odd).columns == odd.columns and secrets.mask(odd).count() == odd.count()
    assert secrets.scan_versions(none)[1].count() == 0
    clash = docs.withColumn("spans", F.lit(1)).withColumn("BLOB", F.lit(2)).withColumn("__blob", F.lit(3))
    assert secrets.scan_versions(clash)[1].columns == ["doc_id", "__blob", "blob", "spans"]
    assert secrets.mask(clash).columns == clash.columns and {r["__blob"] for r in secrets.mask(clash).collect()} == {3}


def test_secrets_beyond_the_base_kinds(spark):
    made = {
        "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-123456789012-abc", "google": "AIza" + "x-_4Y" * 7, "jwt": "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl",
        "private": "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc+/=\nxyz\n", "login": "postgres://me:hidden@",
    }
    docs = spark.createDataFrame([(k, f"\U0001f600 {v} token = abcdefgh") for k, v in made.items()], "doc_id string, text string")
    for r in secrets.scan_versions(docs)[1].collect():
        n = len(made[r.doc_id])
        assert [(s.kind, s.start, s.end) for s in r.spans] == [(r.doc_id, 2, 2 + n), ("assign", 3 + n, 3 + n + 16)]
    assert {k.kind for k in secrets.MORE} == set(made)
    long = spark.createDataFrame([(1, "eyJ" * 50_000 + " https://" + "a:" * 400_000)], "doc_id long, text string")
    assert secrets.scan_versions(long)[1].first().spans == []


def test_secret_ledger_of_the_query(spark, tmp_path):
    """The later commit scans only blobs that the earlier one lacks, and its copies get the earlier findings."""
    rows = [(i, f"token = abcdefgh{i % 7} AKIAABCDEFGHIJK{i % 3}") for i in range(40)] + [(None, "token = abcdefgh0 AKIAABCDEFGHIJK0"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = secrets.entries(docs.filter("doc_id <= 19")).cache()
    assert first.count() == 20 and secrets.entries(docs.filter("doc_id > 19"), ledger=first).count() == 1
    got = {(r.doc_id, r.spans, r.base_sha256) for r in secrets.op4_blob_ledger_secrets(spark, str(tmp_path)).collect()}
    assert got == {(i, _spans(x), hashlib.sha256(_spans(x).encode()).hexdigest()) for i, x in rows}


# 5: sharding


def test_sharding(spark, odd, none):
    xxhash = pytest.importorskip("xxhash")
    docs = spark.range(3000).withColumn("text", F.lit("x"))
    got = sharding.slots(sharding.place(docs, "id", [1.0] * 24, 1.0), "shard", ["id"], 24, parts=8).collect()

    def draw(key, s):
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(str(key).encode(), seed=42))
        return -np.log(((h >> 11) + 0.5) * 2.0**-53)

    for r in got[:300]:
        costs = [draw(r.id, s) for s in range(25)]
        assert r.shard == int(np.argmin(costs[:24])) and r.grown_shard == int(np.argmin(costs))
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    heavy = collections.Counter(r.shard for r in sharding.place(docs, "id", [3.0, 1.0, 0.0]).collect())
    assert 2 < heavy[0] / heavy[1] < 4 and 2 not in heavy
    placed = sharding.place(odd, "doc_id", [1.0] * 4)
    assert placed.count() == odd.count() and placed.filter("shard is null").count() == 0
    whole = sharding.slots(placed, "shard", ["doc_id"], 4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("k"))
    assert all(r.n == r.k == r.m + 1 for r in whole.collect())
    assert sharding.place(none, "doc_id", [1.0]).count() == 0


def test_sharding_keeps_columns(spark):
    docs = spark.range(50).select(F.col("id"), F.lit("mine").alias("__row"), F.lit("mine").alias("__part"), F.lit("mine").alias("__start"), F.lit("mine").alias("__best"), F.lit(7).alias("Slot"))
    got = sharding.slots(sharding.place(docs, "id", [1.0] * 3, 1.0), "shard", ["id"], 3)
    assert got.columns == ["id", "__row", "__part", "__start", "__best", "shard", "grown_shard", "slot"]
    assert {(r["__row"], r["__part"], r["__start"], r["__best"]) for r in got.collect()} == {("mine",) * 4}


def test_native_plans(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"token = abcdefgh{i}") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for q in (secrets.op4_blob_ledger_secrets, sharding.op5_rendezvous_sharding):
        plan = q(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# 6: fixity


def test_fixity(spark):
    rows = [("f", i, 10 + i % 7, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)] + [("g", i, 5, "aa") for i in range(3)]
    one = spark.createDataFrame(rows, "file string, position long, length long, digest string")
    damaged = [r for r in rows if r[:2] != ("f", 299)]
    damaged = [(f, p, n, "bad" if (f, p) in (("f", 17), ("f", 255)) else d) for f, p, n, d in damaged] + [("g", 3, 5, "aa"), ("h", 0, 1, "zz")]
    two = spark.createDataFrame(damaged, one.schema)
    assert {tuple(r) for r in fixity.audit(fixity.tree(one), fixity.tree(two)).collect()} == {("f", 17, "changed"), ("f", 255, "changed"), ("f", 299, "missing"), ("g", 3, "extra"), ("h", 0, "extra")}
    assert fixity.audit(fixity.tree(one), fixity.tree(one)).count() == 0
    small = one.filter("file = 'g'")
    assert {(r.file, r.status) for r in fixity.audit(fixity.tree(one), fixity.tree(small)).collect()} == {("f", "missing")}
    assert fixity.audit(fixity.tree(one.limit(0)), fixity.tree(one.limit(0))).count() == 0


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ü", "<p>é</p>"), (2, None, None), (3, "http://b", "x\r\n\r\ny")], "page_id long, url string, html string")
    raw = [r.t.encode() for r in pages.orderBy("page_id").select(fixity.record_text(F.col("url"), F.col("html")).alias("t")).collect()]
    (tmp_path / "one.warc").write_bytes(b"".join(raw))
    got = fixity.read_warc(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.offset, r.length, r.digest) for r in got] == [(sum(map(len, raw[:i])), len(x), hashlib.sha256(x).hexdigest()) for i, x in enumerate(raw)]
    assert [bytes(r.body).decode() for r in got] == ["<p>é</p>", "", "x\r\n\r\ny"]
    with pytest.raises(ValueError):
        list(fixity.parse_records(raw[0][:-2]))
    assert fixity.page_records(pages.withColumn("page_id", F.lit(None).cast("long"))).filter(f"file >= 0 or file < {-fixity.NULL_FILES}").count() == 0


def test_warc_of_gzip_members(spark, tmp_path):
    made = [f"WARC/1.1\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate([b"one", b"", random.Random(1).randbytes(300_000)])]
    packed = [gzip.compress(r) for r in made]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(packed))
    got = fixity.read_warc(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.url, r.length, r.digest) for r in got] == [(f"u{i}", len(p), hashlib.sha256(r).hexdigest()) for i, (r, p) in enumerate(zip(made, packed))]
    assert [r.offset for r in got] == [0, len(packed[0]), len(packed[0]) + len(packed[1])]
    with pytest.raises(ValueError, match="torn"):
        list(fixity.stored_records(b"".join(packed)[:-1]))
    with pytest.raises(ValueError, match="no gzip member"):
        list(fixity.stored_records(packed[0] + b"xx"))


def test_fixity_of_odd_pages(spark, tmp_path):
    rows = [(None, "u", "<a>"), (None, "u", "<a>"), (None, None, None), (5, "u", "<b>"), (5, "u", "<b>"), (5, "u", ""), (7, "v", "x" * 3_000_000), (8, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = fixity.op6_merkle_fixity(spark, str(tmp_path)).collect()
    assert collections.Counter((r.page_id, r.status) for r in got) == {(None, "ok"): 3, (5, "changed"): 3, (7, "missing"): 1, (8, "ok"): 1}
    assert all(r.file < 0 for r in got if r.page_id is None)


# 7: language


def test_language(spark, odd, none):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["der", "und", "straße", "nicht"] if i % 2 else ["the", "and", "street", "not"]) for _ in range(30)), "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.model_of(docs)
    got = language.predict(docs, model).collect()
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got)
    out = language.predict(odd, model)
    assert out.count() == odd.count() and out.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    for r in out.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.predict(none, model).count() == 0
    blank = language.predict(docs, language.train(docs.filter("lang is null")))
    assert {r.lang_pred for r in blank.collect()} == {"und"}
    held = {r.doc_id for r in docs.filter(language.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_sums():
    texts = pa.array(["Ab  c!", "", "ÄÖ x", None])
    letter, first = language.letters(texts)
    names = ["a", "b"]
    per = collections.defaultdict(list)
    for column, text in language.grams(letter, first):
        for t in range(4):
            per[t].append(int((text == t).sum()))
    assert per[0] == [3, 5, 4] and per[2][0] == 3 and per[1][0] == 0 and len(names) == 2


def test_language_posteriors_against_plain(spark):
    """Scores are those of multinomial naive Bayes with priors, added up n-gram by n-gram from the same hashed columns."""
    rng = random.Random(22)
    rows = [(i, words(rng, rng.randrange(1, 12), 60) + rng.choice(["", " ñandú", " \U00010400\U00010428"]), rng.choice(["aa", "bb", "bb", "bb", "cc"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    counts, n_texts = collections.defaultdict(collections.Counter), collections.Counter(r[2] for r in rows)
    columns = lambda x: [c for column, _ in language.grams(*language.letters(pa.array([x]))) for c in column.tolist()]
    for _, x, lang in rows:
        counts[lang].update(columns(x))
    for r in language.predict(docs, model).collect():
        own = columns(r.text)
        log = {}
        for lang, c in counts.items():
            total = sum(c.values()) + (1 << language.BITS)
            log[lang] = np.log(n_texts[lang] / len(rows)) + sum(np.log((c[g] + 1) / total) for g in own)
        odds = {k: np.exp((v - max(log.values())) * language.TEMPERATURE / np.sqrt(len(own))) for k, v in log.items()}
        assert r.lang_pred == max(sorted(log), key=log.get) and abs(r.score - max(odds.values()) / sum(odds.values())) < 1e-4
    assert language.letters(pa.array(["\U00010400"]))[0].tolist() == [0, 0x10428, 0]
    with pytest.raises(ValueError, match="languages"):
        language.train(spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang")))


# 8: decontamination


def _contaminated(texts, items):
    bench = [(k, WORD.findall(lower(t))) for k, t in items]
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for k, b in bench:
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    found.add(str(k))
                    hit |= set(range(i, i + n))
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [leakage.QUERY_BYTES, 200])
def test_decontamination(spark, odd, none, odd_texts, limit):
    rng = random.Random(8)
    items = [(10, words(rng, 40)), (9, words(rng, 14)), (2, "Two Words"), (3, None), (4, "..."), (5, words(rng, 13)), (9, "two words")]
    texts = [words(rng, 30) + " " + items[0][1][:90] + " " + words(rng, 5), items[1][1].upper(), "x two, WORDS two words", words(rng, 400) + " " + items[5][1], items[0][1] + items[0][1], *odd_texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = leakage.build_index(docs)
    got = leakage.contamination(index, leakage.phrase_matches(index, bench, limit=limit)).collect()
    want = _contaminated(texts, items)
    assert {r.id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got} == dict(enumerate(want))
    if limit == 200:
        assert leakage.decontaminate(odd, bench).count() == odd.count()
        assert leakage.decontaminate(none, bench).count() == 0
        assert leakage.decontaminate(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha x x x x beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta"), (5, "gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    index = leakage.build_index(docs)
    got = leakage.proximity_matches(index, items, within=5).join(index.select("segment", F.posexplode("ids").alias("doc_no", "id")), ["segment", "doc_no"])
    assert {r.id for r in got.collect()} == {1, 3}


# 9: spans


def test_spans(spark, odd, none):
    rng = random.Random(9)
    sentence = lambda n: " ".join(words(rng, n, 9999).split()).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(5))
    one = sentence(60)
    texts = [f"{sentence(9)} {passage} {sentence(8)}", f"{sentence(5)}\n{passage}\n{sentence(5)}", sentence(9) + " " + one, one + " " + sentence(4), passage + " " + sentence(6) + " " + passage, "Of. The. And. Of. The. And.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in spans.without_repeats(docs).collect()}
    assert [got[i].n_removed for i in range(8)] == [0, 5, 0, 1, 10, 0, 0, 0]
    assert passage not in got[1].text and got[1].text.count(".") == 2
    assert got[6].text is None and got[5].text == texts[5]
    out = spans.without_repeats(odd)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "n_sentences", "n_removed", "removed"]
    assert spans.without_repeats(none).count() == 0


def test_spans_inside_sentences(spark):
    rng = random.Random(12)
    cut = words(rng, 22, 9999) + ". Nine words stand here in a sentence of theirs. " + words(rng, 22, 9999)
    lone = words(rng, 12, 9999) + ". " + " ".join(words(rng, 18, 9999).split()) + ". " + words(rng, 24, 9999)
    at_end = words(rng, 42, 9999) + ". Two sentences end here now. And this is the last."
    fill = lambda n: words(rng, n, 9999)
    texts = [f"{fill(30)} {x} {fill(30)}." for x in (cut, lone, at_end, cut, lone, at_end)] + [f"{fill(30)}. Nine words stand here in a sentence of theirs. {fill(30)}."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.removed for r in spans.without_repeats(docs).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [1], 4: [1], 5: [1, 2], 6: []}


def test_spans_of_every_long_passage():
    rng = random.Random(13)
    for _ in range(300):
        passage = [f"{words(rng, rng.randrange(1, 30), 9999)}{rng.choice(['.', '. ***.', chr(10)])}" for _ in range(rng.randrange(1, 6))]
        passage = words(rng, rng.randrange(1, 24), 9999) + ". " + " ".join(passage) + " " + words(rng, rng.randrange(1, 24), 9999)
        if len(passage.replace("***.", "").split()) < 50:
            continue
        both = pa.array([f"{words(rng, 5, 9999)} {passage} {words(rng, 5, 9999)}" for _ in range(2)])
        hashed, own, start, end, _ = spans.spans(both)
        seen, data = set(hashed[own == 0].tolist()), kernel.text_bytes(both)
        gone = {k for x, o, s, e in zip(hashed.tolist(), own, start, end) if o == 1 and x in seen for k in range(s, e)}
        starts, first = spans.sentences(*data)
        ends = np.append(starts, len(data[0]))
        full = [k for k in range(1, first[2] - first[1] - 1) if b"***" not in data[0][ends[first[1] + k] : ends[first[1] + k + 1]].tobytes()]
        assert gone >= set(full) and not gone & {0, first[2] - first[1] - 1}



def _plain_spans(texts, ids):
    """A plain version of the rule on a list of rows: numbers of the sentences that go from each."""
    mark = re.escape("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
    cut = re.compile(rf"(?s).*?(?:[.!?][{mark}]*[\t-\r ]|\n)[\t-\r ]*|.+")
    rows = []
    for i, (key, x) in enumerate(zip(ids, texts)):
        said = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), s)) for s in cut.findall(x or "")]
        full = [(k, w) for k, w in enumerate(said) if w]
        found = set()
        flat = [w for _, own in full for w in own]
        at = np.cumsum([0, *[len(w) for _, w in full]]).tolist()
        place = [k for n, (_, w) in enumerate(full) for k in [n] * len(w)]
        n = len(full)
        for a in range(n):
            for least, words_ in ((spans.RUN, spans.MIN_WORDS), (1, spans.LONE_WORDS)):
                ends = [b for b in range(a + least, n + 1) if at[b] - at[a] >= words_][:1]
                heads = [b for b in range(a + 1 - least, -1, -1) if at[a + 1] - at[b] >= words_][:1]
                runs = [(a, b) for b in ends] + [(b, a + 1) for b in heads]
                found |= {(at[x], at[y]) for x, y in runs if least > 1 or y - x < spans.RUN}
            if at[a + 1] - at[a] < spans.LONE_WORDS:
                found |= {(at[a], at[a] + spans.LONE_WORDS)} if at[a] + spans.LONE_WORDS <= at[n] else set()
                found |= {(at[a + 1] - spans.LONE_WORDS, at[a + 1])} if at[a + 1] >= spans.LONE_WORDS else set()
        where = (key is None, key if key is not None else 0, int(hashlib.md5((x or "").encode()).hexdigest()[:15], 16))
        for lo, hi in sorted(found):
            inside = [k for k in range(n) if at[k] >= lo and at[k + 1] <= hi]
            if inside:
                rows.append((tuple(flat[lo:hi]), where, lo, i, full[inside[0]][0], full[inside[-1]][0] + 1))
    gone = [set() for _ in texts]
    first = {}
    for words_, where, lo, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        first.setdefault(words_, (where, lo))
    for words_, where, lo, i, a, b in rows:
        if first[words_] != (where, lo):
            gone[i] |= set(range(a, b))
    return [sorted(g) for g in gone]


@pytest.mark.parametrize("kind", ["long", "string", "null", "repeated"])
def test_spans_against_plain(spark, kind):
    rng = random.Random(15)
    stock = [" ".join(words(rng, rng.randrange(1, 40), 9999).split()) + rng.choice([". ", "! ", ".) ", "\n", " ... ", "\n\n", ". \n"]) for _ in range(40)]
    texts = ["".join(rng.choice(["", "", " ", "\n", "-- "]) + (rng.choice(stock) if rng.random() < 0.5 else words(rng, rng.randrange(1, 15), 9999) + ". ") for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    texts += [texts[3], texts[5], texts[5] + "X", None, "", "\n", "...", stock[0] * 3]
    ids = {"long": list(range(len(texts))), "string": [f"id{i % 100:03}é" for i in range(len(texts))], "null": [None] * len(texts), "repeated": [i % 3 or None for i in range(len(texts))]}[kind]
    docs = spark.createDataFrame([(i, n, x) for n, (i, x) in enumerate(zip(ids, texts))], f"doc_id {'string' if kind == 'string' else 'long'}, __row int, text string").repartition(3)
    want = _plain_spans(texts, ids)
    got = {r["__row"]: r for r in spans.without_repeats(docs).collect()}
    assert len(got) == len(texts)
    assert [got[n].removed for n in range(len(texts))] == want
    assert any(want) and [got[n].n_removed for n in range(len(texts))] == [len(w) for w in want]


def test_spans_leave_unique_text_of_a_shared_id(spark):
    rng = random.Random(16)
    text = lambda: " ".join(words(rng, 12, 9999) + "." for _ in range(5))
    passage, alone = text(), [text() for _ in range(3)]
    rows = [(5, passage), (5, alone[0]), (None, passage), (None, alone[1]), (9, passage), (9, alone[2])]
    got = {(r.doc_id, r.text) for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, passage), (5, alone[0]), (None, alone[1]), (9, alone[2]), (None, ""), (9, "")}


# 10: toxicity


@pytest.fixture(scope="module")
def channel():
    text = " ".join(["the idiot and a stupid clown are pathetic trash said the loser to the moron"] * 50 + [words(random.Random(1), 200)])
    letter, _ = language.letters(pa.array([text]))
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0)
    c = toxicity._class(letter[keep])
    cells, n = np.unique((c[:-2] * 64 + c[1:-1]) * 64 + c[2:], return_counts=True)
    return toxicity.Channel(cells, n)


@pytest.mark.parametrize("hidden, plain", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("st-up-id", "stupid"), ("p@thetic", "pathetic"), ("l0ser!!", "loser"), ("TRASH###", "trash"), ("moroooon", "moron"), ("cl0wn", "clown"), ("Stupid,", "stupid"), ("12345", ""), ("", ""), ("|", ""), ("tr@$h", "trash"), ("tra5h", "trash"), ("id10+", "idiot"), ("idio+", "idiot"), ("i d io t", "idiot"), ("s t u p i d c l o w n", "stupid clown"), ("cl0wn!", "clown"), ("trash$$$", "trash")])
def test_channel(channel, hidden, plain):
    assert channel.restore(hidden) == plain


def test_spaced_words():
    names, code, text = toxicity.tokens(pa.array(["you i d i o t here", "a a a a", None, "x y"]))
    assert "i d i o t" in [names[c] for c, t in zip(code, text) if t == 0]
    assert {names[c] for c, t in zip(code, text) if t == 1} == {"a"}
    names, code, text = toxicity.tokens(pa.array(["you i d io t", "st u p id c", "of to in a", "x y"]))
    assert [names[c] for c, t in zip(code, text) if " " in names[c]] == ["i d io t", "st u p id c"]


def test_channel_against_all_ways(channel):
    """Viterbi's best way has the best score of all ways through the lattice, each scored letter by letter."""
    rng = random.Random(17)
    words_ = ["cra$$", "a55", "a$$", "b1+", "1337", "i d io t", "@@@x", "wow!!", "(l0wn", "mooo.n", "5!", "x$$$", "é1é"]
    words_ += ["".join(rng.choice("idotscl01345$!+@(.-* ") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    checked = 0
    for w in words_:
        places = channel.choices(w)
        if places is None:
            continue
        by = {}
        for way in itertools.product(*places):
            found, s, a, b = "".join(x for x, _ in way), -sum(c for _, c in way), 0, 0
            for x in [*found, " "]:
                n = ord(x)
                c = 0 if x == " " else n - 96 if "a" <= x <= "z" else 27 + n % 37
                s, a, b = s + channel.log[a, b, c], b, c
            by[found] = max(s, by.get(found, -np.inf))
        score, found = channel.best(places)
        assert abs(score - max(by.values())) < 1e-9 and abs(by[found] - score) < 1e-9
        checked += 1
    assert checked > 200


def test_channel_reads_leet_at_the_end():
    text = " ".join(["crass ass bit the glass and a bit of crass mass is in a pass to it"] * 80)
    letter, _ = language.letters(pa.array([text]))
    c = toxicity._class(letter)
    cells, n = np.unique((c[:-2] * 64 + c[1:-1]) * 64 + c[2:], return_counts=True)
    channel = toxicity.Channel(cells, n)
    assert [channel.restore(x) for x in ("cra$$", "a55", "a$$", "b1+", "A$$$", "a.", "mass,")] == ["crass", "ass", "ass", "bit", "a", "a", "mass"]


def test_toxicity(spark, odd, none):
    rng = random.Random(10)
    bad = ["idiot", "clown", "trash"]
    rows = [(i, words(rng, 60) + (" " + rng.choice(bad) + " " + words(rng, 20) if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    ch = toxicity.channel_of(docs)
    learn = lambda d: d.filter(~language.held_out(F.col("doc_id")))
    model = toxicity.fit(learn(docs), learn(labels), ch)
    got = toxicity.score(docs, ch, model).collect()
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in got) >= 590
    hidden = spark.createDataFrame([(1, words(rng, 60) + " 1d1ot " + words(rng, 9)), (2, words(rng, 70)), (3, "i d i o t")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(hidden, ch, model).collect()} == {1: 1, 2: 0, 3: 1}
    out = toxicity.score(odd, ch, model)
    assert out.count() == odd.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.score(none, ch, model).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 0"), ch)[0] == {}
    assert {r.score for r in toxicity.score(hidden, ch, toxicity.fit(docs, labels.limit(0), ch)).collect()} == {0.0}
