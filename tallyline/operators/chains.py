"""Chains of the operators: pseudo-labels and their audit, review exports, review candidates, curation.

A box is a row: image (file name), rel_path, source_sha256, width and height (null where the image can't be read), box_index, the box
as centre and size (cx, cy, bw, bh) or in pixels (box), parts (what a reader found: array<struct(text, conf, y)>, null or empty where
it found nothing) and crop_sha256. Reserved rows have label, source_sha256 and crop_sha256, of which any may be null or blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.functions import decode as D
from tallyline.functions import geometry as G
from tallyline.functions import text as X
from tallyline.operators import curate as C
from tallyline.operators import hamming as B
from tallyline.operators.fuzzy import near_reserved
from tallyline.operators.ordered import pages_of
from tallyline.operators.tables import written
from tallyline.params import BANDS, PLATE

# Limits and patterns of the reports.
EXCLUDED = ("*Gen*",)
MIN_HEIGHT, MOST_CROPS, CANDIDATES = 24, 3, 400
AUDIT_SEED, AUDIT_ROWS_A_BAND, AUDIT_LEAST, AUDIT_CELLS = 20260713, 30, 10, 30


def _hashes(column: Column, reserved: DataFrame) -> DataFrame:
    """(hash) of a reserved column, or of an array of them, trimmed and in lower case, each once; blanks go.

    It is written, so that Spark knows its size when it plans: a small table goes to the boxes, and not they to it.
    """
    return written(reserved.select(F.explode(column).alias("hash")).select(F.lower(F.trim("hash")).alias("hash")).filter("hash <> ''").distinct(), "hashes")


def _marked(df: DataFrame, column: str, hashes: DataFrame, mark: str) -> DataFrame:
    """df with whether its hash, in any case, is one of (hash) hashes."""
    own = hashes.select(F.col("hash").alias("__hash"), F.lit(True).alias(mark))
    return df.join(own, F.lower(F.trim(column)) == F.col("__hash"), "left").drop("__hash").withColumn(mark, F.coalesce(mark, F.lit(False)))


def _read(boxes: DataFrame) -> DataFrame:
    """boxes with label and ocr_confidence, what the reader's parts come to, and whether it found nothing."""
    if "__nothing" in boxes.columns:
        return boxes
    read = boxes.withColumn("__read", D.merged_observation(F.col("parts"), PLATE)).withColumn("__nothing", F.col("parts").isNull() | (F.size("parts") == 0))
    return read.withColumn("label", F.col("__read.text")).withColumn("ocr_confidence", F.col("__read.conf")).drop("__read")


def _pixels(boxes: DataFrame) -> DataFrame:
    if "box" in boxes.columns:
        return boxes
    return boxes.withColumn("box", G.yolo_box(*[F.col(c).cast("double") for c in ("cx", "cy", "bw", "bh")], F.col("width"), F.col("height")))


def judge(boxes: DataFrame, reserved: DataFrame, shape: tuple[str, Column], guard: int | None, excluded: tuple[str, ...] = EXCLUDED, detector: bool = False) -> DataFrame:
    """boxes with box, label, ocr_confidence and reason: the first that a box fails, else `kept`.

    shape: the reason and the condition (on box) of a box that is too small or of a wrong form; guard as in near_reserved. With
    detector, no file name is excluded and boxes of images that can't be read have the shape's reason, as a detector's boxes do.
    """
    held = near_reserved(_read(_pixels(boxes)), reserved, "label", guard=guard).withColumnRenamed("reason", "__near")
    for column, mark in (("source_sha256", "__source"), ("crop_sha256", "__crop")):
        held = _marked(held, column, _hashes(F.array(column), reserved), mark)
    wrong = F.col("box").isNull() | F.coalesce(shape[1], F.lit(True))
    image = [] if detector else [("unreadable", F.col("width").isNull() | F.col("height").isNull())]
    names = [] if detector else [("excluded-source", X.glob_any(F.col("image"), list(excluded)))]
    reasons = [
        *names, ("reserved-source-hash", F.col("__source")), *image, (shape[0], wrong), ("unreadable", F.col("__nothing")), ("invalid-format", F.col("label").isNull()),
        ("reserved-label", F.col("__near") == "reserved-label"), ("near-reserved-label", F.col("__near").isNotNull()), ("reserved-crop-hash", F.col("__crop")),
    ]
    return C.funnel(held, reasons).drop("__source", "__crop", "__near", "__nothing")


def pseudo_labels(boxes: DataFrame, reserved: DataFrame, excluded: tuple[str, ...] = EXCLUDED, least: int = MIN_HEIGHT) -> DataFrame:
    """boxes judged for pseudo-labels: a box of fewer than `least` rows is too small; a label near a reserved one, of any length, is reserved."""
    small = ("too-small", F.col("box.y2") - F.col("box.y1") < least)
    out = judge(boxes, reserved, small, None, excluded)
    return out.withColumn("reason", F.when(F.col("reason") == "near-reserved-label", "reserved-label").otherwise(F.col("reason")))


def pseudo_manifest(judged: DataFrame) -> DataFrame:
    """The manifest of the kept boxes: training rows, not verified, grouped by the source before augmentation."""
    kept = judged.filter("reason = 'kept'")
    stem = F.regexp_replace("image", r"\.[^.]*\z", "")
    name = X.crop_name("pseudo", F.col("source_sha256"), F.col("rel_path"), F.col("box_index"))
    return kept.select(
        F.concat(F.lit("images/"), name).alias("image_path"), "label", F.lit("pseudo").alias("source_type"), X.source_group(stem).alias("group_id"), F.lit("train").alias("split"), F.lit("false").alias("verified"),
        F.col("rel_path").alias("source_ref"), "source_sha256", "crop_sha256", "ocr_confidence",
    )


def audit(manifest: DataFrame, n: int = AUDIT_ROWS_A_BAND, least: int = AUDIT_LEAST, seed: int = AUDIT_SEED, cells: int = AUDIT_CELLS) -> DataFrame:
    """(sheet, cell, image_path, ocr_confidence, band): up to n rows of each confidence band, small bands joined, on sheets in the order of band, confidence and path.

    The bands are eleven; their joined names are broadcast.
    """
    conf = F.coalesce("ocr_confidence", F.lit(0.0))
    rows = manifest.select("image_path", conf.alias("ocr_confidence")).withColumn("__band", X.confidence_band(F.col("ocr_confidence")))
    counts = rows.groupBy("__band").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("__band", "n"))).alias("m"))
    every = F.array(*[F.struct(F.lit(b).alias("band"), F.coalesce(F.try_element_at("m", F.lit(b)), F.lit(0).cast("long")).alias("n")) for b in BANDS])
    joined = counts.select(F.explode(D.merge_small_bands(every, least)).alias("g")).select(F.explode("g.bands").alias("__band"), F.array_join("g.bands", "+").alias("band"))
    chosen = C.sample_per_band(rows.join(F.broadcast(joined), "__band"), "band", "image_path", n, seed)
    place = F.array_position(F.array(*[F.lit(b) for b in BANDS]), F.col("__band"))
    paged = pages_of(chosen, [place, F.col("ocr_confidence"), F.col("image_path")], cells)
    return paged.select((F.col("page") + 1).alias("sheet"), (F.col("page") * cells + F.col("cell") + 1).alias("cell"), "image_path", "ocr_confidence", "band")


def car_boxes(boxes: DataFrame, reserved: DataFrame, excluded: tuple[str, ...] = EXCLUDED, detector: bool = False) -> DataFrame:
    """boxes judged for a review: only those of a car's plate in form; labels near a reserved one, of five characters or more, go."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    return judge(boxes, reserved, ("low-aspect", ~G.car_like(w, h)), 5, excluded, detector)


def review(judged: DataFrame, most: int = MOST_CROPS, notes: Column | None = None) -> DataFrame:
    """Rows of the review sheet: up to `most` kept crops of each label, of different sources first; of copies in a source, the first by path and box."""
    kept = judged.filter("reason = 'kept'")
    size = (F.col("box.x2") - F.col("box.x1")) / (F.col("box.y2") - F.col("box.y1"))
    named = kept.select(
        X.crop_name("car", F.col("source_sha256"), F.col("rel_path"), F.col("box_index")).alias("crop_name"), F.col("label").alias("label_draft"), "ocr_confidence", F.col("rel_path").alias("source_ref"),
        "source_sha256", "crop_sha256", F.to_json(F.array("box.x1", "box.y1", "box.x2", "box.y2")).alias("box_json"), size.alias("aspect_ratio"), (F.lit("") if notes is None else F.coalesce(notes, F.lit(""))).alias("filter_notes"),
        "box_index",
    )
    return C.diverse(named, "label_draft", "source_sha256", "crop_sha256", "ocr_confidence", most, ("source_ref", "box_index")).drop("box_index")


def funnel_counts(judged: DataFrame, per_image: bool = False) -> DataFrame:
    """(reason, n) of boxes. With per_image, a reserved source counts once for each of its images, as the external export has it."""
    whole = F.col("reason").isin("excluded-source", "reserved-source-hash")
    if not per_image:
        return judged.groupBy("reason").agg(F.count("*").alias("n"))
    each = judged.groupBy("reason", F.when(whole, F.col("rel_path")).alias("__i")).agg(F.count("*").alias("__n"))
    return each.groupBy("reason").agg(F.sum(F.when(F.col("__i").isNotNull(), 1).otherwise(F.col("__n"))).cast("long").alias("n"))


def external_boxes(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """frames joined to a detector's boxes by their path: box in whole pixels, and filter_notes with the detector's confidence.

    frames: the image columns of a box. detections: rel_path, box_index, x1, y1, x2, y2, conf, parts, crop_sha256.
    """
    pixel = G.box(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")])
    inside = (F.col("box.x2") > F.col("box.x1")) & (F.col("box.y2") > F.col("box.y1"))
    # sides past the image end with it
    cut = G.box(F.col("x1").cast("int"), F.col("y1").cast("int"), F.least(F.col("x2").cast("int"), F.col("width")), F.least(F.col("y2").cast("int"), F.col("height")))
    # detections are read before the join, which then carries what they come to
    found = frames.join(_read(detections), "rel_path").withColumn("box", F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), cut).otherwise(pixel))
    found = found.withColumn("box", F.when(inside & F.col("width").isNotNull() & F.col("height").isNotNull(), F.col("box")))
    return found.withColumn("filter_notes", F.format_string("detector:%.4f", F.coalesce(F.col("conf").cast("double"), F.lit(0.0)))).drop("x1", "y1", "x2", "y2", "conf")


def review_candidates(boxes: DataFrame, reserved: DataFrame, excluded: tuple[str, ...] = (), count: int = CANDIDATES) -> DataFrame:
    """(candidate_id, group_id, ...): the best crop of each source, adequate ones first, then by focus, area, path and place; the first `count` whose crop isn't reserved.

    boxes also have `focus`. Source and crop hashes are reserved in one namespace. A reserved best crop leaves no other in its place.
    """
    hashes = _hashes(F.array("source_sha256", "crop_sha256"), reserved)
    fit = _marked(_pixels(boxes), "source_sha256", hashes, "__source").filter(~F.col("__source") & ~X.glob_any(F.col("image"), list(excluded)) & F.col("box").isNotNull()).drop("__source")
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    sized = fit.withColumn("crop_width", w).withColumn("crop_height", h).withColumn("__crop", F.lower(F.trim("crop_sha256"))).withColumn("__source", F.substring_index(F.regexp_replace("image", r"\.[^.]*\z", ""), ".rf.", 1))
    order = [((F.col("crop_width") >= 80) & (F.col("crop_height") >= 24)).desc(), F.col("focus").desc(), (F.col("crop_width") * F.col("crop_height")).desc(), F.col("rel_path").desc(), F.col("box_index").asc()]
    taken = hashes.select(F.col("hash").alias("__crop"))
    best = C.best_not_reserved(sized, "__source", order, taken, "__crop", count)
    place = F.row_number().over(W.orderBy(*order, "__source")) - 1  # of `count` rows at most
    return best.select(F.format_string("candidate-%04d", place).alias("candidate_id"), F.concat(F.lit("det:"), F.col("__source")).alias("group_id"), "rel_path", "source_sha256", "crop_sha256", "crop_width", "crop_height", "focus")


def curate_images(parts: dict[str, DataFrame], vehicles: DataFrame, target: int, prefixes: list[str], most: int = 5, seed: int = 42) -> DataFrame:
    """(name, label, fate) of the union of sources: no-vehicle, near-duplicate or overflow for those that go, in this order, else the split.

    parts: name, label and phash (64 bits) by source. vehicles: name (as in the union) of images with a vehicle.
    """
    whole = C.consolidate(parts, "name").select("name", "label", "phash")
    seen = vehicles.select("name").distinct().withColumn("__seen", F.lit(True))
    clean = written(whole.join(seen, "name", "left"), "consolidated")
    judged = written(B.greedy(clean.filter("__seen").drop("__seen"), "label", "name", "phash", most), "deduped")
    fit, over = C.cap(judged.filter("kept"), ["label"], [C.priority(F.col("name"), prefixes), F.col("name")], target)
    split = C.class_split(fit, "label", "name", seed, "task")
    gone = [clean.filter("__seen is null").withColumn("fate", F.lit("no-vehicle")), judged.filter("not kept").withColumn("fate", F.lit("near-duplicate")), over.withColumn("fate", F.lit("overflow"))]
    out = split.select("name", "label", F.col("split").alias("fate"))
    for g in gone:
        out = out.union(g.select("name", "label", "fate"))
    return out
