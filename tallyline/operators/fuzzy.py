"""Edit-distance joins by deletion neighbourhoods, clusters, and reserved-label filters.

Two texts are at most one edit apart only if they share a text that is one of them, or one of them less one character. Those
neighbourhoods are joined by equality, so no pair of unrelated texts is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import text as X
from tallyline.operators.tables import written


def neighbourhood(x: Column) -> Column:
    """The text, and all texts with one character less, each once."""
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))
    return F.array_distinct(F.array_append(less, x))


def near_pairs(df: DataFrame, column: str, distance: int = 1) -> DataFrame:
    """(a, b), a < b: different values of the column at most one edit apart; each pair once. Nulls and blanks have none."""
    if distance != 1:
        raise ValueError("neighbourhoods are those of one edit")
    values = df.filter(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("v")).distinct()
    keys = values.select("v", F.explode(neighbourhood(F.col("v"))).alias("k"))
    a, b = keys.withColumnRenamed("v", "a"), keys.withColumnRenamed("v", "b")
    return a.join(b, "k").filter((F.col("a") < F.col("b")) & F.levenshtein("a", "b", 1).between(0, 1)).select("a", "b").distinct()


def components(pairs: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of all nodes of pairs (a, b): the least node that is connected. Labels spread to neighbours and then jump, in written rounds."""
    ways = written(pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a")), "ways")
    label = written(ways.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "roots")
    for _ in range(most):
        seen = ways.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = label.join(seen, "node").select("node", F.least("root", "near").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.col("far").alias("root"))
        new = written(jump, "roots")
        if not new.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").take(1):
            return new
        label = new
    raise RuntimeError(f"labels did not settle in {most} rounds")


def near_clusters(df: DataFrame, column: str) -> DataFrame:
    """(value, cluster, n): single-link clusters of the column's values, named by the least, with rows of each value."""
    counted = df.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    named = components(near_pairs(df, column))
    return counted.join(named.withColumnRenamed("node", "value"), "value", "left").select("value", F.coalesce("root", "value").alias("cluster"), "n")


def representatives(df: DataFrame, column: str, conf: str, clusters: DataFrame) -> DataFrame:
    """(cluster, representative, count, conf_sum): of each cluster the value with most rows at most one edit away, then conf sum, rows, text."""
    own = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.col(conf), F.lit(0.0))).alias("conf"))
    stats = clusters.select("value", "cluster").join(own, "value")
    pairs = near_pairs(df, column)
    both = pairs.select(F.col("a").alias("value"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    around = both.join(own.select(F.col("value").alias("other"), F.col("rows").alias("near")), "other").groupBy("value").agg(F.sum("near").alias("near"))
    scored = stats.join(around, "value", "left").withColumn("support", F.col("rows") + F.coalesce("near", F.lit(0)))
    return scored.groupBy("cluster").agg(F.max(F.struct("support", "conf", "rows", "value"))["value"].alias("representative"), F.sum("rows").alias("count"), F.sum("conf").alias("conf_sum"))


def near_reserved(drafts: DataFrame, reserved: DataFrame, column: str = "draft", label: str = "label", guard: int | None = 5) -> DataFrame:
    """drafts with `reason`: reserved-label for an equal label; near-reserved-label where one begins the other (the shorter of `guard` characters or more; with None of any length) or they are one edit apart; else null.

    Prefixes are joined through the beginnings of the longer text, edits through neighbourhoods. Drafts are read twice: once for their
    different texts, and once to be joined with the texts found, which are written: Spark knows their size when it plans, and sends a
    few to the drafts as they lie. If they are many, blank drafts are spread over the tasks.
    """
    norm = X.plate_text
    d = drafts.withColumn("__d", norm(F.col(column)))
    r = written(reserved.select(norm(F.col(label)).alias("__r")).filter("__r <> ''").distinct(), "reserved")
    values = written(d.select("__d").distinct(), "texts").filter("__d <> ''")
    least = F.lit(guard or 1)
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, F.lit(1), i)))
    exact = values.join(r, values["__d"] == r["__r"]).select("__d", F.lit(0).alias("k"))
    shorter_r = values.select("__d", starts(F.col("__d")).alias("__p")).join(r, F.col("__p") == r["__r"]).filter(F.length("__r") >= least).select("__d", F.lit(1).alias("k"))
    shorter_d = r.select("__r", starts(F.col("__r")).alias("__p")).join(values, F.col("__p") == values["__d"]).filter(F.length("__d") >= least).select("__d", F.lit(1).alias("k"))
    dk, rk = values.select("__d", F.explode(neighbourhood(F.col("__d"))).alias("__n")), r.select("__r", F.explode(neighbourhood(F.col("__r"))).alias("__n"))
    edit = dk.join(rk, "__n").filter(F.levenshtein("__d", "__r", 1).between(0, 1)).select("__d", F.lit(1).alias("k"))
    worst = exact.union(shorter_r).union(shorter_d).union(edit).groupBy("__d").agg(F.min("k").alias("__k"))
    reason = F.when(F.col("__k") == 0, "reserved-label").when(F.col("__k") == 1, "near-reserved-label")
    spread = d.withColumn("__d", F.when(F.col("__d") != "", F.col("__d")).otherwise(F.concat(F.lit(" "), F.spark_partition_id())))
    return spread.join(written(worst, "near"), "__d", "left").withColumn("reason", reason).drop("__d", "__k")


def edit_rates(df: DataFrame, truth: str, guess: str, keys: list[str] | None = None) -> DataFrame:
    """(n, exact, cer_micro, cer_macro): edits over characters, and the mean of edits by text; 0 without characters."""
    d, n = F.levenshtein(F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(guess), F.lit(""))), F.length(F.coalesce(F.col(truth), F.lit("")))
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.count_if(d == 0).alias("exact"), F.coalesce(F.sum(d) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)).alias("cer_micro"), F.coalesce(F.avg(d / F.greatest(F.lit(1), n)), F.lit(0.0)).alias("cer_macro")
    )
