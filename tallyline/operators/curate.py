"""Curation: best and capped rows of groups, splits, dedup, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.operators.tables import written


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. Each task keeps n rows of a group before the shuffle."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], at: str = "__at", total: str = "__n") -> DataFrame:
    """df with each row's place in its group by the (ascending) order, from 1, and the group's size.

    Rows are dealt by ranges of keys and order, counted by group and range, and numbered inside: a group of any size, a third of all
    rows say, is spread over many tasks. What is summed has a row for each group and range.
    """
    names = [f"__o{i}" for i in range(len(order))]
    ranges = df.select("*", *[c.alias(n) for c, n in zip(order, names)]).repartitionByRange(*keys, *names)
    held = written(ranges.withColumn("__p", F.spark_partition_id()), "ranges")
    group = W.partitionBy(*keys)
    counts = held.groupBy(*keys, "__p").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(group.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), before.alias("__s"), F.sum("__c").over(group).alias(total))
    on = held["__p"] == starts["__q"]
    for i, k in enumerate(keys):
        on = on & held[k].eqNullSafe(starts[f"__k{i}"])
    inside = F.row_number().over(W.partitionBy(*keys, "__p").orderBy(*names))
    return held.withColumn("__r", inside).join(starts, on).select(*df.columns, (F.col("__s") + F.col("__r")).alias(at), total)


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with a running sum for each (name: column) of sums, over all rows in a total order, up to each row.

    Rows are dealt by ranges of the order and summed inside; one row of sums for each range shifts them. No task holds all rows.
    """
    names = [f"__o{i}" for i in range(len(order))]
    held = written(df.select("*", *[c.alias(n) for c, n in zip(order, names)]).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    upto = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = held.groupBy("__p").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = parts.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"__s{i}") for i, n in enumerate(sums)])
    inside = W.partitionBy("__p").orderBy(*names).rowsBetween(W.unboundedPreceding, 0)
    summed = held.select("*", *[F.sum(c).over(inside).alias(f"__r{i}") for i, c in enumerate(sums.values())])
    return summed.join(starts, F.col("__p") == F.col("__q")).select(*df.columns, *[(F.col(f"__s{i}") + F.col(f"__r{i}")).alias(n) for i, n in enumerate(sums)])


def cap(df: DataFrame, keys: list[str], order: list[Column], target: int) -> tuple[DataFrame, DataFrame]:
    """(first `target` rows of each group by the ascending order, the overflow)."""
    ranked = numbered(df, keys, order)
    return ranked.filter(F.col("__at") <= target).drop("__at", "__n"), ranked.filter(F.col("__at") > target).drop("__at", "__n")


def priority(name: Column, prefixes: list[str]) -> Column:
    """Place of the first prefix that the name begins with, else the number of prefixes."""
    out = None
    for i, p in enumerate(prefixes):
        out = F.when(name.startswith(p), i) if out is None else out.when(name.startswith(p), i)
    return F.lit(0) if out is None else out.otherwise(len(prefixes))


def diverse(df: DataFrame, label: str, source: str, item: str, conf: str, most: int = 3, place: tuple[str, ...] = ()) -> DataFrame:
    """At most `most` rows of each label: the best of each source first, by confidence and source, then the rest; an (item, source) once.

    Of a source only `most` rows can count, so each task keeps no more. Copies of an item that are equal so far go by `place`, the columns
    that say where an item comes, and then by their other columns, so that the same rows give the same result in any layout.
    """
    order = [F.col(conf).desc(), F.col(source), F.col(item)]
    rest = [c for c in sorted(df.columns) if c not in (label, source, item, conf, *place)]
    once = top_per_group(df, [label, source, item], [*order, *[F.col(c) for c in (*place, *rest)]])
    rank = F.row_number().over(W.partitionBy(label, source).orderBy(*order))
    ranked = once.withColumn("__s", rank).filter(F.col("__s") <= most)
    return top_per_group(ranked, [label], [(F.col("__s") > 1).cast("int"), *order], most).drop("__s")


def best_not_reserved(df: DataFrame, group: str, order: list[Column], reserved: DataFrame, key: str, n: int) -> DataFrame:
    """The best row of each group, less those with a reserved key (which leave no other in their place), the first n of all."""
    return top_per_group(df, [group], order).join(reserved.select(key).distinct(), key, "left_anti").orderBy(*order, group).limit(n)


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that any engine can repeat: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def grouped_split(df: DataFrame, group: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """df with a split; all rows of a group share it. Groups are in hash order and cut at the rounded shares of their number.

    Distinct groups are numbered by range parts of their hash; no task holds all of them.
    """
    total = sum(ratios)
    groups = df.select(F.col(group).alias("__g")).distinct().withColumn("__h", hash_order(F.col("__g"), seed))
    placed = written(groups.repartitionByRange("__h").withColumn("__p", F.spark_partition_id()), "groups")
    starts = placed.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    n = placed.count()
    at = F.col("__s") + F.row_number().over(W.partitionBy("__p").orderBy("__h", "__g"))
    a, b = round(n * ratios[0] / total), round(n * ratios[0] / total) + round(n * ratios[1] / total)
    named = placed.join(starts, "__p").select("__g", at.alias("__at")).select("__g", F.when(F.col("__at") <= a, "train").when(F.col("__at") <= b, "val").otherwise("test").alias("split"))
    return df.join(named, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def class_split(df: DataFrame, label: str, key: str, seed: int = 42, rule: str = "stratified") -> DataFrame:
    """df with a split inside each class, in hash order.

    stratified: at least one and 70 % (down) to train, at least one and 15 % (down) to val, the rest to test; task: 15 % (half to
    even) to test, then to val, the rest to train; holdout: at least one and 20 % (down) to val, the rest to train.
    """
    ranked = numbered(df, [label], [hash_order(F.col(key), seed), F.col(key)])
    share = lambda x: F.greatest(F.lit(1), F.floor(F.col("__n") * x))
    if rule == "stratified":
        split = F.when(F.col("__at") <= share(0.70), "train").when(F.col("__at") <= share(0.70) + share(0.15), "val").otherwise("test")
    elif rule == "task":
        k = F.bround(F.col("__n") * 0.15)
        split = F.when(F.col("__at") <= k, "test").when(F.col("__at") <= 2 * k, "val").otherwise("train")
    else:
        split = F.when(F.col("__at") <= share(0.2), "val").otherwise("train")
    return ranked.withColumn("split", split).drop("__n", "__at")


def sample_per_band(df: DataFrame, band: str, key: str, n: int = 30, seed: int = 42) -> DataFrame:
    """All rows of a band of n or fewer, else the n first in hash order."""
    return top_per_group(df, [band], [hash_order(F.col(key), seed), F.col(key)], n)


def round_robin(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n trials, one class after the other; a class that runs out starts again in another order (round counts them).

    The order of a round is that of a hash of seed, round and key, so that it needs no state. Only the rows that a class can give are kept.
    """
    if n <= 0:
        return df.limit(0).select(F.lit(0).alias("turn"), F.lit(0).alias("round"), *df.columns)
    size = df.groupBy(label).agg(F.count("*").alias("__size"))
    classes = size.withColumn("__c", F.row_number().over(W.orderBy(label)) - 1).withColumn("__k", F.count("*").over(W.partitionBy()))
    turns = classes.filter(F.col("__c") < n).withColumn("turn", F.explode(F.sequence(F.col("__c"), F.lit(n - 1), F.col("__k").cast("int"))))
    turns = turns.withColumn("__i", F.floor(F.col("turn") / F.col("__k"))).select(label, "turn", F.pmod("__i", F.col("__size")).alias("__at"), F.floor(F.col("__i") / F.col("__size")).cast("int").alias("round"))
    asked = turns.groupBy(label, "round").agg(F.max("__at").alias("__last"))
    order = [F.sha2(F.concat(F.lit(str(seed)), F.when(F.col("round") > 0, F.concat(F.lit("."), F.col("round").cast("string"))).otherwise(""), F.lit(":"), F.col(key).cast("string")).cast("binary"), 256), F.col(key)]
    # a round of a class takes its first rows: a class of more than n rows has one round
    own = top_per_group(df.join(asked, label), [label, "round"], order, n).withColumn("__at", F.row_number().over(W.partitionBy(label, "round").orderBy(*order)) - 1)
    return turns.join(own.filter("__at <= __last"), [label, "round", "__at"]).select("turn", "round", *df.columns)


def exact_dedup(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by order; copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def funnel(df: DataFrame, reasons: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """df with the first reason that applies, in order, else `kept`."""
    out = None
    for r, hit in reasons:
        hit = F.coalesce(hit, F.lit(False))
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return df.withColumn(name, F.lit("kept") if out is None else out.otherwise("kept"))


def consolidate(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """The union of tables, names prefixed by where they come from; equal names of one table once."""
    out = None
    for prefix, df in parts.items():
        named = df.withColumn(name, F.concat(F.lit(f"{prefix}_"), F.col(name))).withColumn("origin", F.lit(prefix))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out.dropDuplicates([name])


def merge_new(target: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """target and those of new whose name it lacks."""
    return target.unionByName(new.join(target.select(name), name, "left_anti").select(*target.columns))
