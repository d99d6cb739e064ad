"""File sources: registry and manifest CSV, label lines, COCO annotations, image trees.

Paths may be of any store that Spark reads; whether one is there is asked of Spark's file system, not of the local disk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyline.functions import text as X
from tallyline.functions.text import registry_key
from tallyline.operators.tables import written
from tallyline.sources import snapshots

REGISTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("license_plate", "car_brand", "car_color")])
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
#: files up to this size are read as one value, larger ones in pieces
WHOLE_BYTES, PIECE_BYTES = 64_000_000, 8_000_000


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_in_order(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a CSV with row_ord, from 0: the order of file names, and in a file that of its rows.

    Spark packs splits into tasks by their size, so that a task's number says nothing; rows are numbered inside each split, and shifted
    by the rows of the splits before, of which there is one count each.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.csv(path, header=True)
    file, block, at = (F.col(f"_metadata.{c}") if c else F.monotonically_increasing_id() for c in ("file_path", "file_block_start", ""))
    held = written(rows.select(*[F.col(f"`{c}`") for c in rows.columns], file.alias("__file"), block.alias("__block"), at.alias("__at")), "rows")
    splits = held.groupBy("__file", "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__file", "__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("__file", "__block").orderBy("__at"))
    numbered = held.withColumn("__k", inside).join(splits.select("__file", "__block", before.alias("__s")), ["__file", "__block"])
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__s") + F.col("__k") - 1).alias("row_ord"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry as verification needs it; FileNotFoundError where there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_registry(spark, path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(license_plate, car_brand, car_color, row_ord): trimmed, without blank rows, of a CSV or of the newest version at `path`; no rows where there is no file."""
    path = snapshots.current(spark, path)[1] or path
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*REGISTRY.fields, T.StructField("row_ord", T.LongType())]))
    rows = read_in_order(spark, path, REGISTRY)
    clean = rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in REGISTRY.names], "row_ord")
    return clean.filter(F.concat_ws("", "license_plate", "car_brand", "car_color") != "")


def list_vehicles(registry: DataFrame, photos: DataFrame) -> DataFrame:
    """registry with plate_key and the path of its photo, null without one. photos: path, whose stem is the key."""
    keyed = registry.withColumn("plate_key", registry_key(F.col("license_plate"))).filter("plate_key <> ''")
    stems = photos.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("plate_key"), F.col("path").alias("photo"))
    return keyed.join(stems.groupBy("plate_key").agg(F.min("photo").alias("photo")), "plate_key", "left")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Core columns, row_number from 2 on, and all other columns in `metadata`."""
    from tallyline.operators.manifest import CORE, HASHES

    rows = read_in_order(spark, path)
    lacking = [c for c in CORE if c not in rows.columns]
    if lacking:
        raise ValueError(f"C1: columns {lacking} are missing")
    extra = [c for c in rows.columns if c not in (*CORE, *HASHES, "row_ord")]
    meta = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.coalesce(c, F.lit("")) for c in extra])) if extra else F.create_map().cast("map<string,string>")
    kept = [*CORE, *[h for h in HASHES if h in rows.columns]]
    return rows.select(*kept, meta.alias("metadata"), (F.col("row_ord") + 2).alias("row_number"))


def files_of(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, content: bool = False) -> DataFrame:
    """(path, stem, extension, parent[, content]) of files with these extensions, case aside."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = found.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("parent"), *(["content"] if content else []))
    return named.filter(F.col("extension").isin(*extensions))


def checksums(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, sha256) of files of any size but empty ones, which Spark doesn't list.

    Files of up to WHOLE_BYTES are values of the file scan; what is larger, up to beyond the 2 GB that a value can hold, is listed without its content,
    dealt one by one, and read in pieces by the tasks through Arrow's file systems.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = found.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    whole = kept.filter(F.col("length") <= WHOLE_BYTES).select("path", F.sha2("content", 256).alias("sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", p))
                digest = hashlib.sha256()
                with fs.open_input_stream(at) as f:
                    while piece := f.read(PIECE_BYTES):
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([digest.hexdigest()])], names=["path", "sha256"])

    large = kept.filter(F.col("length") > WHOLE_BYTES).select("path").repartition(F.col("path"))
    return whole.unionByName(large.mapInArrow(stream, "path string, sha256 string"))


def class_tree(spark: SparkSession, path: str, names: dict[str, str] | None = None, most: int | None = None) -> DataFrame:
    """(path, label) of an image tree whose folders are classes; folders that names lacks are left out; at most `most` of a class, by path."""
    rows = files_of(spark, path).withColumn("folder", F.regexp_extract("parent", r"([^/]+)$", 1))
    rows = rows.withColumn("label", X.mapped(F.col("folder"), names) if names else F.col("folder")).filter("label is not null")
    if most is not None:
        from tallyline.operators.curate import top_per_group

        rows = top_per_group(rows, ["label"], [F.col("path")], most)
    return rows.select("path", "label")


def yolo_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, cls, cx, cy, w, h) of label lines of five numbers or more; others are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("t"))
    num = lambda k: F.get("t", F.lit(k)).try_cast("double")
    return lines.filter(F.size("t") >= 5).select("file", F.get("t", F.lit(0)).try_cast("int").alias("cls"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"))


def yolo_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, image): label files in .../labels with the image of their stem in .../images; of several, jpg, then jpeg, then png."""
    side = lambda df, folder: df.filter(F.col("parent").endswith("/" + folder)).withColumn("root", F.regexp_replace("parent", f"/{folder}$", ""))
    rank = F.array_position(F.array(*[F.lit(e) for e in IMAGE_EXTENSIONS]), F.col("extension"))
    best = side(images, "images").groupBy("root", "stem").agg(F.min_by("path", F.struct(rank, "path")).alias("image"))
    return side(labels, "labels").select("root", "stem", F.col("path").alias("label")).join(best, ["root", "stem"]).select("label", "image")


def sibling_pairs(files: DataFrame, prefix: str = "", image: str = "jpg", label: str = "txt") -> DataFrame:
    """(image, label): images whose name begins so, with the label file of their stem in the same folder; those without one are left out. For an order, sort by image."""
    own = lambda e: files.filter((F.col("extension") == e) & F.col("stem").startswith(prefix)).select("parent", "stem", F.col("path"))
    return own(image).withColumnRenamed("path", "image").join(own(label).withColumnRenamed("path", "label"), ["parent", "stem"]).select("image", "label")


def coco_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, width, height, boxes array<struct(x, y, w, h)>): all images, those without a box with none; boxes of unknown images are dropped."""
    schema = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<image_id:long,bbox:array<double>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", F.struct(*[F.get("a.bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")]).alias("b"))
    grouped = boxes.groupBy("image_id").agg(F.collect_list("b").alias("boxes"))
    return images.join(grouped, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(grouped.schema["boxes"].dataType)))


def every_nth_frame(frames: DataFrame, fps: float, rate: float, index: str = "frame_idx") -> DataFrame:
    """Frames i with i % int(fps / rate) = 0; all where that is 0."""
    return frames.filter(F.pmod(F.col(index), F.lit(max(1, int(fps / rate)))) == 0)


def layout(spark: SparkSession, path: str) -> str:
    """How an image tree is laid out: `split` (train/, val/ or test/ above the classes) or `flat` (classes right below)."""
    top = F.regexp_extract(F.regexp_replace("parent", r"/+", "/"), r"([^/]+)/[^/]+$", 1)
    return "split" if files_of(spark, path).filter(F.lower(top).isin("train", "val", "valid", "test")).take(1) else "flat"


def class_samples(spark: SparkSession, path: str, names: dict[str, str] | None = None, most: int | None = None, seed: int = 42) -> DataFrame:
    """(path, label, split) of an image tree in either layout; split is null in a flat one.

    With `most`, the splits of a class are pooled first, and so many of it are taken in an order by a hash of seed and path. ValueError if a class of `names`
    has no image.
    """
    from tallyline.operators.curate import hash_order, top_per_group

    rows = class_tree(spark, path, names)
    if names:
        lacking = set(names.values()) - {r[0] for r in rows.select("label").distinct().collect()}  # of the few classes that names has
        if lacking:
            raise ValueError(f"no image of {sorted(lacking)}")
    if most is not None:
        rows = top_per_group(rows, ["label"], [hash_order(F.col("path"), seed), F.col("path")], most)
    top = F.lower(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1))
    split = F.when(top.isin("train", "val", "test"), top).when(top == "valid", "val") if layout(spark, path) == "split" else F.lit(None).cast("string")
    return rows.withColumn("split", split)
