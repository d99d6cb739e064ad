"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions only.

Each shard draws a number from (key, shard); a record goes to the shard with the least -ln(u) / weight.
A shard that is added draws for itself alone, so that it takes records but none move between the others.

Defined cases: a null key is the key "\\x00null" (all such rows share a shard); equal keys share a shard;
a null text counts no bytes and has the checksum of the empty text; repeated rows each get a slot of their own;
an empty table gives no rows; columns of the input are kept, but that those named like what is added (shard and grown shard, slot) are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.common import clash_free, table, text_of

NULL_KEY = "\x00null"


def record_key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NULL_KEY))


def cost(key: Column, shard: int, weight: float) -> Column:
    """The exponential draw of one shard for a key: a 53-bit uniform number inside (0, 1) from xxhash64(key, shard)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("int")), 11).cast("double")
    return -F.ln((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """struct(cost, shard) of the shard that gets the key; equal costs go to the lower shard. A weight of 0 takes nothing."""
    live = [(s, w) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    draws = [F.struct(cost(key, s, w).alias("cost"), F.lit(s).cast("int").alias("shard")) for s, w in live]
    return F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0]


def place(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with `shard` (int) and, with a weight for one more shard, `grown` (int): where the key would be then."""
    k, n = record_key(F.col(key)), len(weights)
    best = clash_free(df.columns, "__best")
    out = df.withColumn(best, choose(k, weights))
    cols = [F.col(f"{best}.shard").alias(shard)]
    if grown_weight is not None:
        cols.append(F.when(cost(k, n, grown_weight) < F.col(f"{best}.cost"), F.lit(n)).otherwise(F.col(f"{best}.shard")).cast("int").alias(grown))
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (shard.lower(), grown.lower())]
    return out.select(*keep, *cols)


def slots(df: DataFrame, shard: str, spread: Sequence[str], n_shards: int, parts: int = 256, slot: str = "slot") -> DataFrame:
    """df with gapless numbers from 0 inside each shard.

    A shard is cut into `parts` by a hash of the `spread` columns; parts are counted (n_shards * parts rows at most, which is
    the bound of what is broadcast), numbered inside, and shifted by the rows of the parts before. No task holds a whole shard.
    """
    part, row, start = (clash_free(df.columns, x) for x in ("__part", "__row", "__start"))
    marked = df.withColumn(part, F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in spread], F.lit(7919)), F.lit(parts)).cast("int"))
    before = W.partitionBy(shard).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = marked.groupBy(shard, part).agg(F.count("*").alias("n")).select(shard, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    inside = W.partitionBy(shard, part).orderBy(*spread)
    numbered = marked.withColumn(row, F.row_number().over(inside)).join(F.broadcast(starts), [shard, part])
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != slot.lower()]
    return numbered.select(*kept, (F.col(start) + F.col(row) - 1).cast("long").alias(slot))


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 24 shards of equal weight by doc_id."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(docs, "doc_id", [1.0] * 24, 1.0)
    return slots(placed, "shard", ["doc_id", "size", "text_crc32"], 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
