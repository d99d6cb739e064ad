"""The registry: first row by key, verification of readings against it, and its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.functions import text as X
from tallyline.params import DEFAULTS, Params


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the least order. Null and blank keys go.

    min_by over the row combines before the shuffle, so that a key with very many rows costs one row a task.
    """
    rest = [c for c in df.columns if c != key]
    best = df.filter(F.trim(F.col(key)) != "").groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def verdict(found: Column, detected: Column, registered: Column, conf: Column, p: Params = DEFAULTS) -> Column:
    """struct(status, action, color_warning): not found; same colour or both neutral; too unsure of the colour; else a warning. A null confidence is trusted."""
    same = F.coalesce(X.colors_equivalent(detected, registered, p.neutral), F.lit(False))
    unsure = conf.isNotNull() & (conf < p.color_warn_conf)
    status = F.when(found, "AUTHORIZED").otherwise("UNREGISTERED")
    action = F.when(~found, "DENY_ALERT").when(same | unsure, "ALLOW").otherwise("ALLOW_WARN")
    return F.struct(status.alias("status"), action.alias("action"), (action == "ALLOW_WARN").alias("color_warning"))


def message(found: Column, plate: Column, color: Column, registered: Column, conf: Column, detected: Column, p: Params = DEFAULTS) -> Column:
    """The sentence that goes with a verdict; it has the values as detected, and the colour as registered."""
    same = F.coalesce(X.colors_equivalent(detected, registered, p.neutral), F.lit(False))
    head = F.concat(F.lit("Vehicle "), plate, F.lit(" authorized"))
    differs = F.concat(head, F.lit(" by plate; colour differs (detected "), color, F.lit(", registered "), registered, F.lit(")"))
    low = F.concat(differs, F.format_string(f" but colour confidence (%.2f) is below the warning threshold ({p.color_warn_conf:.2f}), so not flagged.", conf))
    return (
        F.when(~found, F.concat(F.lit("Plate "), plate, F.lit(" is not registered in the system.")))
        .when(same, F.concat(head, F.lit(": plate and colour match.")))
        .when(conf.isNotNull() & (conf < p.color_warn_conf), low)
        .otherwise(F.concat(differs, F.lit(".")))
    )


def verify(readings: DataFrame, registry: DataFrame, p: Params = DEFAULTS, plate: str = "plate_text", color: str = "color", conf: str = "color_conf") -> DataFrame:
    """readings with status, action, color_warning and message. registry: license_plate, car_color, row_ord.

    No broadcast is asked for: Spark takes one where the registry's measured size allows, and else a sort-merge join whose hot
    keys it splits.
    """
    keyed = registry.select(X.registry_key(F.col("license_plate")).alias("__key"), X.color_key(F.col("car_color")).alias("__registered"), "row_ord")
    known = first_by_key(keyed, "__key", "row_ord").select("__key", "__registered")
    marked = readings.withColumn("__key", X.detected_key(F.col(plate))).withColumn("__color", X.color_key(F.col(color)))
    joined = marked.join(known.withColumn("__found", F.lit(True)), "__key", "left")
    found = F.coalesce(F.col("__found"), F.lit(False))
    out = joined.withColumn("__v", verdict(found, F.col("__color"), F.col("__registered"), F.col(conf), p)).withColumn(
        "message", message(found, F.col(plate), F.col(color), F.col("__registered"), F.col(conf), F.col("__color"), p)
    )
    return out.select("*", "__v.status", "__v.action", "__v.color_warning").drop("__v", "__key", "__color", "__registered", "__found")


def registered(readings: DataFrame, registry: DataFrame, plate: str = "plate_text", inside: bool = True) -> DataFrame:
    """Readings whose plate is (or isn't) in the registry."""
    keys = registry.select(X.registry_key(F.col("license_plate")).alias("__key")).distinct()
    return readings.withColumn("__key", X.detected_key(F.col(plate))).join(keys, "__key", "left_semi" if inside else "left_anti").drop("__key")


def add(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with the new rows, rows refused): a blank key is refused, and one that the registry or an earlier new row has."""
    key = X.registry_key(F.col("license_plate"))
    keyed = new.withColumn("__key", key)
    have = registry.select(key.alias("__key")).distinct()
    rank = F.row_number().over(W.partitionBy("__key").orderBy("row_ord"))
    ok = keyed.filter(F.coalesce(F.col("__key"), F.lit("")) != "").withColumn("__n", rank).filter("__n = 1").drop("__n").join(have, "__key", "left_anti")
    refused = keyed.join(ok.select("row_ord"), "row_ord", "left_anti").drop("__key")
    stored = ok.drop("__key").withColumn("license_plate", F.trim("license_plate"))
    return registry.unionByName(stored.select(*registry.columns)), refused.select(*new.columns)


def delete(registry: DataFrame, plate: str) -> tuple[DataFrame, bool]:
    """(registry without any row of that key, whether one went)."""
    key = X.registry_key(F.lit(plate))
    same = X.registry_key(F.col("license_plate")) == key
    return registry.filter(~F.coalesce(same, F.lit(False))), bool(registry.filter(same).take(1))
