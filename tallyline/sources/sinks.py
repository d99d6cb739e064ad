"""Sinks: registry and manifest CSV, create-only tables, review sheets, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources import files, snapshots

# The fields of the manifest, in the order of the file.
MANIFEST_FIELDS = ("image_path", "label", "source_type", "group_id", "split", "verified", "source_sha256", "crop_sha256")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _registry_csv(df: DataFrame, folder: str) -> None:
    df.select("license_plate", "car_brand", "car_color").coalesce(1).write.mode("errorifexists").csv(folder, header=True)


def replace_registry(df: DataFrame, path: str, base: int | None = None) -> int:
    """A full rewrite with header as the next version of the registry at `path`, which it gives; files.read_registry reads the newest.

    base: the version that df was made from (snapshots.Conflict if there is a newer one); None for the newest.
    """
    return snapshots.commit(df, path, snapshots.current(df.sparkSession, path)[0] if base is None else base, _registry_csv)


def change_registry(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Commits change(registry), anew where another change came first."""
    return snapshots.change(spark, path, lambda data: files.read_registry(spark, data or path), change, _registry_csv)


def write_manifest(df: DataFrame, path: str, fields: tuple[str, ...] = MANIFEST_FIELDS) -> None:
    """The manifest's fields in order; absent columns and nulls are empty, other columns are left out."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields]
    df.select(*cols).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def write_new(df: DataFrame, path: str) -> None:
    """Refuses a path that exists."""
    df.write.mode("errorifexists").parquet(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """In the order of confidence (greatest first), label and name, with fixed decimals."""
    ordered = df.orderBy(F.desc("ocr_confidence"), "label", "crop_name")
    fixed = ordered.withColumn("ocr_confidence", F.format_string("%.8f", "ocr_confidence")).withColumn("aspect_ratio", F.format_string("%.4f", "aspect_ratio"))
    flat = fixed.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns])
    flat.write.mode("overwrite").csv(path, header=True)


def report(df: DataFrame, most: int = 10_000) -> str:
    """A JSON list of the rows, keys in order. For reports: ValueError over `most` rows."""
    rows = [json.loads(r) for r in df.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return json.dumps(rows, sort_keys=True, indent=2)


def markdown(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
