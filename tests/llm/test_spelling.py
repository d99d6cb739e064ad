"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyline.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_words(rows):
    counts, low = Counter(), str.maketrans(spelling.UPPER, spelling.LOWER)
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def groups(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_groups_of_texts(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 11))) for _ in range(40)]
    rows = [(None if i % 5 == 0 else i, " ".join(rng.choice(stems).title() if rng.random() < 0.3 else rng.choice(stems) for _ in range(60))) for i in range(120)]
    rows += [(1, None), (2, ""), (3, "..."), rows[7], rows[7]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    want = brute_groups(brute_words(rows))
    assert groups(spelling.group(spelling.word_counts(df))) == want and any(x[1] for x in want) and sum(x[4] for x in want) > 30


@pytest.mark.parametrize("alphabet", ["ab", "aé"])
def test_all_words_of_few_letters(spark, alphabet):
    """Every word of two letters and seven or eight places: each has near words at each place, and runs of a letter at both ends."""
    n, rng = {}, random.Random(1)
    for size in (7, 8):
        for k in range(1 << size):
            if rng.random() < 0.6:
                n["".join(alphabet[k >> i & 1] for i in range(size))] = rng.choice([2, 2, 3, 30, 400])
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert groups(spelling.group(df)) == brute_groups(n)


def test_long_words(spark):
    """Around LONG letters, of 5,000, and a chain of forms over several steps."""
    rng = random.Random(4)
    n = {}
    for size in (62, 63, 64, 65, 66, 5000):
        w = "".join(rng.choice("xyz") for _ in range(size))
        for k, v in enumerate([w, w[1:], w[:-1], w[:30] + "q" + w[31:], w[:30] + "r" + w[31:], w[:50] + "q" + w[50:], "q" + w, w + "q", "qq" + w]):
            n[v] = 10 ** (k % 4 + 1)
    for k in range(8):
        n["chained" + "abcdefgh"[:k]] = 2 * 10**k
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert groups(spelling.group(df)) == brute_groups(n)


def test_words_that_share_all_but_a_letter(spark):
    """One node with many words below, and one word left by each omission."""
    letters = [chr(c) for c in range(0xE0, 0xF7)] + list("abcdefghijklmnopqrstuvwxyz")
    n = {f"prefixe{a}{b}": 2 + (ord(a) * ord(b)) % 50 for a in letters[::2] for b in letters}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert groups(spelling.group(df)) == brute_groups(n)


def test_long_run_in_a_text(spark):
    """A run of 200,000 letters, twice, and without a letter in between."""
    w = "".join(random.Random(2).choice("abcdef") for _ in range(200_000))
    rows = [(i, t) for i, t in enumerate([w, w, w[:777] + w[778:], w[:777] + w[778:], "word"])]
    got = groups(spelling.group(spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == brute_groups(brute_words(rows)) and {x[4] for x in got} >= {1}


def test_no_words(spark, none):
    assert spelling.group(spelling.word_counts(none)).count() == 0
    few = spark.createDataFrame([(1, "short few"), (2, None)], "doc_id long, text string")
    assert spelling.group(spelling.word_counts(few)).count() == 0
