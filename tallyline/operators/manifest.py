"""Manifest constraints, and isolation of reserved identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyline.functions import text as X
from tallyline.operators.tables import written
from tallyline.params import PLATE, SOURCE_TYPES, SPLITS
from tallyline.sources import snapshots

# Columns that a manifest must have, and those of its checksums.
CORE = ("image_path", "label", "source_type", "group_id", "split", "verified")
HASHES = ("source_sha256", "crop_sha256")


def missing_columns(df: DataFrame) -> list[str]:
    """C1: required columns that aren't there."""
    return [c for c in CORE if c not in df.columns]


def row_rules(df: DataFrame, label_ok: Column | None = None) -> list[tuple[str, Column]]:
    """(rule, whether a row breaks it) of the rules that a row alone can break; hashes only where the columns are there."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    ok = F.coalesce(X.plate_text(F.col("label")).rlike(PLATE), F.lit(False)) if label_ok is None else label_ok
    real = (F.col("source_type") == "real") & F.coalesce(X.verified(F.col("verified")), F.lit(False))
    rules = [
        ("C2", F.coalesce(F.col("image_path").startswith("/") | F.col("image_path").rlike(r"(^|/)\.\.(/|$)"), F.lit(True))),
        ("C5", ~F.coalesce(ok, F.lit(False))),
        ("C6", ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False))),
        ("C7", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))),
        ("C8", X.verified(F.col("verified")).isNull()),
        ("C9", blank("group_id")),
        ("C15", F.col("split").isin("val", "test") & ~F.coalesce(real, F.lit(False))),
    ]
    return rules + [("C13", ~blank(h) & ~F.lower(F.trim(F.col(h))).rlike(r"^[0-9a-f]{64}\z")) for h in HASHES if h in df.columns]


def violations(df: DataFrame, files: DataFrame | None = None, label_ok: Column | None = None) -> DataFrame:
    """(rule, key, rows): each rule that is broken, by what. Row rules are counted by row number; the others by the value that repeats or crosses.

    files: image_path of the files that exist (C4). Counts combine before the shuffle.
    """
    row = F.array_compact(F.array(*[F.when(hit, F.lit(r)) for r, hit in row_rules(df, label_ok)]))
    out = df.select(F.explode(F.array_distinct(row)).alias("rule"), F.col("row_number").cast("string").alias("key")).groupBy("rule", "key").agg(F.count("*").alias("rows"))
    add = lambda rule, key, rows: rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col("rows").cast("long").alias("rows"))
    out = out.union(add("C3", "image_path", df.groupBy("image_path").agg(F.count("*").alias("rows")).filter("rows > 1")))
    if files is not None:
        out = out.union(add("C4", "image_path", df.join(files, "image_path", "left_anti").groupBy("image_path").agg(F.count("*").alias("rows"))))
    for rule, c in (("C10", F.col("group_id")), ("C11", X.plate_text(F.col("label")) if label_ok is None else F.col("label"))):
        crossing = df.groupBy(c.alias("k")).agg(F.count_distinct("split").alias("s"), F.count("*").alias("rows")).filter("s > 1 and k <> ''")
        out = out.union(add(rule, "k", crossing))
    real = df.filter((F.col("source_type") == "real") & F.coalesce(X.verified(F.col("verified")), F.lit(False)))
    one = real.groupBy(F.col("label").alias("k")).agg(F.count_distinct("group_id").alias("g"), F.count("*").alias("rows")).filter("g > 1")
    out = out.union(add("C12", "k", one))
    hashes = [h for h in HASHES if h in df.columns]
    if hashes:
        named = df.select("split", F.explode(F.array_compact(F.array(*[F.lower(F.trim(F.col(h))) for h in hashes]))).alias("k")).filter("k <> ''")
        out = out.union(add("C14", "k", named.groupBy("k").agg(F.count_distinct("split").alias("s"), F.count("*").alias("rows")).filter("s > 1")))
    return out


def check(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """df, if no rule is broken; ValueError with the first violations otherwise."""
    lacking = missing_columns(df)
    if lacking:
        raise ValueError(f"C1: columns {lacking} are missing")
    found = violations(df, files).orderBy("rule", "key").limit(10).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} ({r['rows']} rows)" for r in found))
    return df


def identities(df: DataFrame, label: str = "label", hashes: tuple[str, ...] = HASHES, group: str | None = "group_id") -> DataFrame:
    """(kind, value) of all rows, each once: labels, groups, and hashes of both columns in one namespace, lower-cased; blanks have none."""
    parts = [F.struct(F.lit("label").alias("kind"), X.plate_text(F.col(label)).alias("value"))]
    parts += [F.struct(F.lit("hash").alias("kind"), F.lower(F.trim(F.col(h))).alias("value")) for h in hashes if h in df.columns]
    parts += [F.struct(F.lit("group").alias("kind"), F.trim(F.col(group)).alias("value"))] if group and group in df.columns else []
    return df.select(F.explode(F.array(*parts)).alias("x")).select("x.kind", "x.value").filter("value is not null and value <> ''").distinct()


def leaks(df: DataFrame, reserved: DataFrame) -> DataFrame:
    """(kind, shared): how many identities of df are reserved, for each kind."""
    return identities(df).join(identities(reserved), ["kind", "value"], "left_semi").groupBy("kind").agg(F.count("*").alias("shared"))


def isolated(df: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """Rows of df none of whose hashes, nor its label, is reserved. key tells rows apart."""
    mine = df.select(key, F.explode(F.array(F.struct(F.lit("label").alias("kind"), X.plate_text(F.col("label")).alias("value")), *[F.struct(F.lit("hash").alias("kind"), F.lower(F.trim(F.col(h))).alias("value")) for h in HASHES if h in df.columns])).alias("x"))
    hit = mine.select(key, "x.*").join(identities(reserved), ["kind", "value"], "left_semi").select(key).distinct()
    return df.join(hit, key, "left_anti")


def marked(parts: list[DataFrame], reserved: DataFrame) -> DataFrame:
    """The union of manifests with `reserved` and `crossing`: whether an identity of the row is reserved, or stands in two splits.

    Rows are told apart by a number of their own, in a written table, so that repeated rows are rows. An identity's splits combine before the shuffle.
    """
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    whole = written(whole.withColumn("__row", F.monotonically_increasing_id()), "composed")
    found = [F.struct(F.lit("label").alias("kind"), X.plate_text(F.col("label")).alias("value")), F.struct(F.lit("group").alias("kind"), F.trim("group_id").alias("value"))]
    found += [F.struct(F.lit("hash").alias("kind"), F.lower(F.trim(F.col(h))).alias("value")) for h in HASHES if h in whole.columns]
    own = whole.select("__row", "split", F.inline(F.array(*found))).filter("value is not null and value <> ''")
    splits = own.groupBy("kind", "value").agg((F.min("split") < F.max("split")).alias("crosses"))
    bad = splits.join(identities(reserved).withColumn("taken", F.lit(True)), ["kind", "value"], "left").filter("crosses or taken")
    hit = own.join(bad, ["kind", "value"]).groupBy("__row").agg(F.bool_or(F.coalesce("taken", F.lit(False))).alias("reserved"), F.bool_or("crosses").alias("crossing"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return whole.join(hit, "__row", "left").select(*[c for c in whole.columns if c != "__row"], flag("reserved"), flag("crossing"))


def compose(parts: list[DataFrame], reserved: DataFrame, path: str) -> dict[str, int]:
    """Commits the union of manifests as the next version of `path` and gives its counts; ValueError, and no version, if an identity is reserved or stands
    in two splits. The constraints are metrics of the one pass that writes the rows, which are looked at before the version is published."""
    rows = marked(parts, reserved)
    seen = Observation("compose")
    watched = rows.observe(seen, F.count("*").alias("rows"), F.count_if("reserved").alias("reserved"), F.count_if("crossing").alias("crossing"))

    def write(df: DataFrame, folder: str) -> None:
        df.drop("reserved", "crossing").write.parquet(folder)
        if seen.get["reserved"] or seen.get["crossing"]:
            raise ValueError(f"{seen.get['reserved']} rows with a reserved identity, {seen.get['crossing']} with one in two splits")

    snapshots.commit(watched, path, snapshots.current(rows.sparkSession, path)[0], write)
    return dict(seen.get)


def summary(df: DataFrame) -> DataFrame:
    """(rows, labels, groups, real_test): all, distinct, and verified real rows of the test split."""
    real = (F.col("source_type") == "real") & F.coalesce(X.verified(F.col("verified")), F.lit(False)) & (F.col("split") == "test")
    return df.agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels"), F.count_distinct("group_id").alias("groups"), F.count_if(real).alias("real_test"))


def provenance(df: DataFrame, files: DataFrame, path: str = "image_path", want: str = "source_sha256") -> DataFrame:
    """df with provenance: verified, mismatch, or unavailable. files: path and content."""
    have = files.select(F.col(path), F.sha2("content", 256).alias("__have"))
    return df.join(have, path, "left").withColumn("provenance", F.when(F.col("__have").isNull(), "unavailable").when(F.col("__have") == F.lower(F.col(want)), "verified").otherwise("mismatch")).drop("__have")
