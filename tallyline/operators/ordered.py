"""Operators on ordered rows of a session: sampling, runs, edges, sliding evidence, latches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def every_nth(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Rows n, 2n, ... of each session: counting starts at 1 before the test."""
    at = F.row_number().over(W.partitionBy(key).orderBy(order))
    return df.withColumn("__n", at).filter(F.pmod("__n", F.lit(n)) == 0).drop("__n")


def run_length(df: DataFrame, key: str, order: str, ok: Column, name: str = "run") -> DataFrame:
    """df with the number of rows in a row that are ok, up to each; a row that isn't restarts it at 0."""
    w = W.partitionBy(key).orderBy(order)
    marked = df.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("__island", F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(w))
    inside = W.partitionBy(key, "__island").orderBy(order)
    return marked.withColumn(name, F.sum(F.when(F.col("__ok"), 1).otherwise(0)).over(inside).cast("int")).drop("__ok", "__island")


def gate_state(df: DataFrame, key: str, order: str, target: Column, persist: int) -> DataFrame:
    """df with run and state: IDLE without a target, TRACKING below `persist` rows in a row, READY_TO_DECIDE from there."""
    return run_length(df, key, order, target).withColumn("state", F.when(F.col("run") == 0, "IDLE").when(F.col("run") < persist, "TRACKING").otherwise("READY_TO_DECIDE"))


def rising_edges(df: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """Rows at which the condition holds and didn't on the row before."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("__s", F.coalesce(state, F.lit(False))).withColumn("__b", F.coalesce(F.lag("__s").over(w), F.lit(False))).filter("__s and not __b").drop("__s", "__b")


def sliding_evidence(df: DataFrame, key: str, order: str, columns: list[str], size: int, name: str = "evidence") -> DataFrame:
    """df with the last `size` rows as an array of structs, blanks included."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-(size - 1), 0)
    return df.withColumn(name, F.collect_list(F.struct(*columns)).over(w))


def sliding_stats(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """df with n, low and high of `value` over the last `size` rows."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-(size - 1), 0)
    return df.select("*", F.count(value).over(w).alias("n"), F.min(value).over(w).alias("low"), F.max(value).over(w).alias("high"))


def latch(df: DataFrame, key: str, order: str, when: Column, value: str, name: str) -> DataFrame:
    """df with the value at the first row where the condition held, from there on."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.first(F.when(when, F.col(value)), ignorenulls=True).over(w))


def changed(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Rows whose value differs from that of the row before: A, B, A counts A twice."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("__b", F.lag(column).over(w)).withColumn("__f", F.row_number().over(w)).filter((F.col("__f") == 1) | ~F.col(column).eqNullSafe(F.col("__b"))).drop("__b", "__f")


def at_fraction(df: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """The one row of each session at int(n * share), held inside the session."""
    w = W.partitionBy(key)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn("__n", n).withColumn("__at", at).filter(F.col("__at") == F.greatest(F.lit(0), F.least(F.col("__n") - 1, F.floor(F.col("__n") * share)))).drop("__n", "__at")


def newest(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, combined before the shuffle: what load shedding keeps."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def pages_of(df: DataFrame, order: list[Column], per_page: int) -> DataFrame:
    """df with its place in a total order as page and cell. Counts by range part shift the numbers, so that no task holds all rows."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    from tallyline.operators.tables import written

    fixed = written(ranged, "ordered")
    starts = fixed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    at = F.col("__start") + F.col("__row")
    return fixed.withColumn("__row", own).join(starts, "__part").select(*df.columns, F.floor(at / per_page).cast("int").alias("page"), F.pmod(at, F.lit(per_page)).cast("int").alias("cell"))
