"""The banded index and greedy dedup against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import hamming as B

SIGNED = 1 << 63


def far(a, b):
    return ((a ^ b) & (2 * SIGNED - 1)).bit_count()


def brute(rows, most):
    """Kept (i) of rows (i, group, order, fingerprint)."""
    kept = {}
    out = set()
    firsts = {}
    for i, g, o, f in rows:
        if f is not None:
            firsts[g, f] = min(firsts.get((g, f), o), o)
    for (g, f), o in sorted(firsts.items(), key=lambda x: (x[1], x[0][1])):
        if all(far(f, k) > most for k in kept.setdefault(g, [])):
            kept[g].append(f)
    for i, g, o, f in rows:
        if f is None or (f in kept[g] and firsts[g, f] == o):
            out.add(i)
    return out


def fingerprints(rng, n, groups, centres):
    middle = [rng.randrange(2 * SIGNED) for _ in range(centres)]
    out = []
    for i in range(n):
        f = rng.choice(middle)
        for b in rng.sample(range(64), rng.randrange(9)):
            f ^= 1 << b
        out.append((i, rng.choice(groups), rng.randrange(n), f - 2 * SIGNED if f >= SIGNED else f))
    return out


@pytest.mark.parametrize("most, first, fold", [(5, 4096, 200_000), (5, 16, 0), (12, 16, 10), (0, 16, 0)])
def test_against_a_loop(spark, monkeypatch, most, first, fold):
    """One task, rounds, and several phases; null groups and fingerprints, repeated rows and ties."""
    monkeypatch.setattr(B, "FIRST", first)
    monkeypatch.setattr(B, "FOLD", fold)
    rng = random.Random(most + first)
    rows = fingerprints(rng, 200, ["a", None], 6)
    rows += [(200 + k, *rows[k][1:]) for k in range(20)] + [(300, "a", 1, None), (301, None, 2, None), (302, "a", 0, -1), (303, "a", 0, 0)]
    df = spark.createDataFrame(rows, "i long, label string, o long, h long")
    assert {r.i for r in B.greedy(df, "label", "o", "h", most).filter("kept").collect()} == brute(rows, most)
    assert B.greedy(df, "label", "o", "h", most).columns == [*df.columns, "kept"]


def test_a_chain_over_many_rounds(spark, monkeypatch):
    """Each fingerprint is near the one before and after it only: every other stays."""
    monkeypatch.setattr(B, "FOLD", 0)
    h = [0]
    for k in range(12):
        h.append(h[-1] | (0b11111 << 5 * k))
    df = spark.createDataFrame([(k, "g", k, x) for k, x in enumerate(h)], "i long, label string, o long, h long")
    assert sorted(r.i for r in B.greedy(df, "label", "o", "h", 5).filter("kept").collect()) == list(range(0, 13, 2))


@pytest.mark.parametrize("most, n", [(0, 10), (5, 10), (5, 10**9), (12, 10**6), (20, 10**5)])
def test_bands_find_every_near_pair(spark, most, n):
    m, differ = B.bands(most, n)
    assert m * (differ + 1) > most and sum(w for _, w in B._cuts(m)) == 64
    rng = random.Random(n)
    rows = fingerprints(rng, 60, ["g"], 4)
    df = spark.createDataFrame([("g", k, r[3]) for k, r in enumerate(rows)], "__g string, __at long, __fp long")
    got = {(r.of, r.at) for r in B.near(df, df, most, m, differ).collect()}
    assert got == {(i, j) for j in range(60) for i in range(j) if far(rows[i][3], rows[j][3]) <= most}


def test_no_rows(spark):
    df = spark.createDataFrame([], "label string, o long, h long")
    assert B.greedy(df, "label", "o", "h").count() == 0
    assert spark.createDataFrame([("a", 1, None)], df.schema).transform(lambda d: B.greedy(d, "label", "o", "h")).select(F.col("kept")).first().kept
