"""A banded bit index for fingerprints of 64 bits, and greedy dedup in order on top of it.

Pairs. Cut into m bands, two fingerprints at most d bits apart agree in one band but for d // m bits (pigeonhole). One side is filed under its bands as
they are, the other asks with every change of so many bits, and what meets is compared in full. The number of bands is chosen by the cost that the
largest group lets expect.

Greedy. A row goes if one kept before it is near. Rows are numbered in their group and taken in phases, each as large as all before: what is near a row
kept in an earlier phase goes by one join; of the rest, rounds keep every row without an undecided near row before it and drop the rows near
those. A dense cluster is so thinned out by its first rows before most of it is looked at. Where few near pairs are left, at most FOLD, one task
settles them in order. No task holds a group.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.tables import written

BITS = 64
#: rows of a group in the first phase, and near pairs that one task settles
FIRST, FOLD = 4096, 200_000
_NODE = "__g string, __at long, __fp long"


def bands(most: int, n: int) -> tuple[int, int]:
    """(bands, bits of a band that may differ) for groups of n rows: least keys and expected comparisons."""

    def cost(m: int) -> float:
        asked = m * sum(math.comb(-(-BITS // m), k) for k in range(most // m + 1))
        return asked + asked * n / 2.0 ** (BITS // m) if asked <= 20_000 else math.inf

    m = min(range(1, most + 2), key=cost)
    return m, most // m


def _cuts(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m bands that share the bits as evenly as can be."""
    edges = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keys(fp: Column, m: int, differ: int) -> Column:
    """array<struct(band, key)>: the fingerprint's bands, each with every change of up to `differ` bits."""

    def band(k: int, shift: int, width: int) -> Column:
        own = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))
        changes = [sum(1 << b for b in bits) for n in range(differ + 1) for bits in combinations(range(width), n)]
        masks = F.array(*[F.lit(c if c < 1 << 63 else c - (1 << 64)).cast("long") for c in changes])
        return F.transform(masks, lambda x: F.struct(F.lit(k).alias("band"), own.bitwiseXOR(x).alias("key")))

    out = [band(k, *cut) for k, cut in enumerate(_cuts(m))]
    return F.concat(*out) if len(out) > 1 else out[0]


def near(asking: DataFrame, filed: DataFrame, most: int, m: int, differ: int) -> DataFrame:
    """(g, at, of): pairs of (__g, __at, __fp) rows of a group at most `most` bits apart, the filed one (of) before the asking one (at), each once."""
    a = asking.select("__g", "__at", "__fp", F.inline(_keys(F.col("__fp"), m, differ)))
    b = filed.select(F.col("__g").alias("__h"), F.col("__at").alias("of"), F.col("__fp").alias("__other"), F.inline(_keys(F.col("__fp"), m, 0)).alias("__band", "__key"))
    same = (F.col("__g") == F.col("__h")) & (F.col("band") == F.col("__band")) & (F.col("key") == F.col("__key"))
    close = F.bit_count(F.col("__fp").bitwiseXOR(F.col("__other"))) <= most
    return a.join(b, same & close & (F.col("of") < F.col("__at"))).select(F.col("__g").alias("g"), F.col("__at").alias("at"), "of").distinct()


def _settled(pairs: DataFrame, n: int) -> DataFrame:
    """(g, at) of the rows of pairs (g, at, of) that go."""
    if n <= FOLD:

        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            gone: set[tuple] = set()
            for g, at, of in rows.sort_values(["g", "at"])[["g", "at", "of"]].itertuples(index=False):
                if (g, of) not in gone:
                    gone.add((g, at))
            return pd.DataFrame(sorted(gone), columns=["g", "at"])

        return pairs.groupBy(F.lit("all")).applyInPandas(fold, "g string, at long")
    gone, k = [], 0
    while n:
        blocked = pairs.select("g", F.col("at").alias("of")).distinct()
        kept = pairs.select("g", "of").distinct().join(blocked, ["g", "of"], "left_anti")
        out = written(pairs.join(kept, ["g", "of"], "left_semi").select("g", "at").distinct(), f"gone{k}")
        gone.append(out)
        left = pairs.join(out, ["g", "at"], "left_anti").join(out.withColumnRenamed("at", "of"), ["g", "of"], "left_anti")
        pairs = written(left.select("g", "at", "of"), f"pairs{k}")
        n, k = pairs.count(), k + 1
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out


def dropped(nodes: DataFrame, most: int) -> DataFrame:
    """(g, at) of the rows (__g, __at, __fp) that greedy dedup drops; __at numbers a group's rows from 1, in order. A table of its own.

    The size of the largest group comes to the driver, and a count a phase.
    """
    phase = F.when(F.col("__at") <= FIRST, 0).otherwise(1 + F.floor(F.log2((F.col("__at") - 1) / FIRST))).cast("int")
    rows = written(nodes.select("__g", "__at", "__fp", phase.alias("__phase")), "fingerprints")
    largest = rows.agg(F.max("__at")).first()[0] or 0
    m, differ = bands(most, largest)
    kept, gone = None, []
    for p in range(1 + (0 if largest <= FIRST else 1 + int(math.log2((largest - 1) / FIRST)))):
        part = rows.filter(F.col("__phase") == p).drop("__phase")
        if kept is not None:
            late = written(near(part, kept, most, m, differ).select("g", "at").distinct(), f"late{p}")
            gone.append(late)
            part = written(part.join(late, (part["__g"] == late["g"]) & (part["__at"] == late["at"]), "left_anti"), f"part{p}")
        pairs = written(near(part, part, most, m, differ), f"near{p}")
        out = written(_settled(pairs, pairs.count()), f"out{p}")
        gone.append(out)
        stay = part.join(out, (part["__g"] == out["g"]) & (part["__at"] == out["at"]), "left_anti")
        kept = written(stay, f"kept{p}") if kept is None else kept.unionByName(written(stay, f"kept{p}"))
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out


def greedy(df: DataFrame, group: str, order: str, fingerprint: str, most: int = 5) -> DataFrame:
    """df with kept: a row goes if its fingerprint is within `most` bits of one kept before it in its group.

    A fingerprint that repeats is settled before: only its first row can stay, and copies, however many, are combined in the partial aggregation. A
    null group is a group; rows with a null fingerprint are kept; equal orders go by the fingerprint, and of equal rows each that is first stays.
    """
    from tallyline.operators.curate import numbered

    named = df.withColumn("__g", F.to_json(F.struct(F.col(group).alias("g")))).withColumn("__fp", F.col(fingerprint).cast("long"))
    first = named.filter("__fp is not null").groupBy("__g", "__fp").agg(F.min(order).alias("__first"))
    nodes = written(numbered(first, ["__g"], [F.col("__first"), F.col("__fp")]).select("__g", "__at", "__fp", "__first"), "nodes")
    gone = dropped(nodes.select("__g", "__at", "__fp"), most).select(F.col("g").alias("__g"), F.col("at").alias("__at"), F.lit(True).alias("__gone"))
    judged = nodes.join(gone, ["__g", "__at"], "left").select("__g", "__fp", "__first", F.coalesce("__gone", F.lit(False)).alias("__gone"))
    kept = F.col("__fp").isNull() | (~F.col("__gone") & (F.col(order) == F.col("__first")))
    return named.join(judged, ["__g", "__fp"], "left").select(*df.columns, F.coalesce(kept, F.lit(False)).alias("kept"))
