"""Frames and their detections: single-image verdicts, edge rows, progress and display figures, plug-in hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyline.operators import registry as R
from tallyline.operators.curate import top_per_group
from tallyline.operators.ordered import rising_edges
from tallyline.params import DEFAULTS, VEHICLE_CLASSES, Params


def usable(width: Column, height: Column) -> Column:
    """A crop of two pixels or more each way."""
    return F.coalesce((width >= 2) & (height >= 2), F.lit(False))


def detected(boxes: DataFrame, conf: float, override: str = "override") -> DataFrame:
    """Boxes at or above the detector's threshold, or that of their call where it brings one; without a confidence none."""
    return boxes.filter(F.col("conf") >= F.coalesce(F.col(override), F.lit(float(conf))))


def best_box(boxes: DataFrame, frame: str, by: str = "conf", order: str = "det_ord") -> DataFrame:
    """The box of each frame with the greatest value; of equals, the first."""
    return top_per_group(boxes, [frame], [F.col(by).desc(), F.col(order).asc()])


def single_frame(frames: DataFrame, vehicles: DataFrame, plates: DataFrame, registry: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One verdict a frame: the largest vehicle, the surest plate inside it, and the registry.

    frames: frame, color, color_conf (the colour is known before there is a plate). vehicles: frame, det_ord, cls, area.
    plates: frame, vehicle_ord, det_ord, conf, plate_text; vehicle_ord is null where the whole image was searched, which counts
    only for frames without a vehicle. Without a plate, or with a blank one, the verdict is NO_PLATE.
    """
    chosen = top_per_group(vehicles.filter(F.col("cls").isin(*VEHICLE_CLASSES)), ["frame"], [F.col("area").desc(), F.col("det_ord").asc()]).select("frame", F.col("det_ord").alias("__v"))
    inside = plates.join(chosen, "frame", "left").filter(F.col("vehicle_ord").eqNullSafe(F.col("__v")))
    read = best_box(inside, "frame").select("frame", "plate_text")
    joined = frames.join(read, "frame", "left")
    blank = F.trim(F.coalesce("plate_text", F.lit(""))) == ""
    out = R.verify(joined, registry, p)
    return out.withColumn("status", F.when(blank, "NO_PLATE").otherwise(F.col("status"))).withColumn("action", F.when(blank, "LOG").otherwise(F.col("action"))).withColumn("color_warning", ~blank & F.col("color_warning"))


def detections_of(frames: DataFrame, boxes: DataFrame, frame: str = "frame") -> DataFrame:
    """frames with their boxes as an array in order, empty where there are none."""
    rest = [c for c in boxes.columns if c != frame]
    grouped = boxes.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("det_ord", *[c for c in rest if c != "det_ord"]))).alias("boxes"))
    return frames.join(grouped, frame, "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(grouped.schema["boxes"].dataType)))


def overlays(boxes: Column) -> Column:
    """JSON of array<struct> with only bbox, conf and class of each."""
    return F.to_json(F.transform(F.filter(boxes, lambda b: b.isNotNull()), lambda b: F.struct(b["bbox"].alias("bbox"), b["conf"].alias("conf"), b["class"].alias("class"))))


def edge_state(state: Column) -> Column:
    """The state's name at the edge, where readiness is called verification."""
    return F.when(state == "READY_TO_DECIDE", "REVERSING_VERIFYING").otherwise(state)


def card(df: DataFrame) -> DataFrame:
    """df (plate, plate_text, color, color_conf, status, action) as display rows: a dash for no plate, per cent to two places."""
    shown = F.coalesce(F.nullif("plate", F.lit("")), F.nullif("plate_text", F.lit("")), F.lit("—"))
    return df.withColumn("plate_shown", shown).withColumn("color_percent", F.round(F.col("color_conf") * 100, 2)).withColumn("alert", (F.col("status") == "UNREGISTERED") | (F.col("action") == "ALLOW_WARN"))


def vote_progress(df: DataFrame, session: str = "session_id", p: Params = DEFAULTS) -> DataFrame:
    """(session, votes, target): votes of the most frequent raw text, held at the target; only sure reads count where confidences are given."""
    text = F.trim(F.coalesce("plate_text", F.lit("")))
    sure = F.col("plate_conf") >= p.lock_conf
    each = df.groupBy(session, text.alias("__p")).agg(F.count("*").alias("all"), F.count_if(F.coalesce(sure, F.lit(False))).alias("sure"), F.count("plate_conf").alias("given"))
    top = each.groupBy(session).agg(F.max(F.when(F.col("__p") != "", F.col("all"))).alias("a"), F.max(F.when(F.col("__p") != "", F.col("sure"))).alias("s"), F.sum("given").alias("g"))
    votes = F.coalesce(F.when(F.col("g") > 0, F.col("s")).otherwise(F.col("a")), F.lit(0))
    return top.select(session, F.least(votes, F.lit(p.lock_repeat)).cast("int").alias("votes"), F.lit(p.lock_repeat).alias("target"))


def kpis(df: DataFrame, session: str, order: str, latency: str, state: str, alert: Column, last: int = 100) -> DataFrame:
    """(session, total, avg_ms, fps, alerts): the mean latency of the last rows, frames a second from it, and alerts counted where a decision begins."""
    totals = df.groupBy(session).agg(F.count("*").alias("total"))
    recent = df.withColumn("__n", F.row_number().over(W.partitionBy(session).orderBy(F.col(order).desc()))).filter(F.col("__n") <= last).groupBy(session).agg(F.avg(latency).alias("avg_ms"))
    alerts = rising_edges(df, session, order, F.col(state) == "DECIDED").filter(alert).groupBy(session).agg(F.count("*").alias("alerts"))
    out = totals.join(recent, session).join(alerts, session, "left")
    return out.select(session, "total", "avg_ms", F.when(F.col("avg_ms") > 0, F.lit(1000.0) / F.col("avg_ms")).otherwise(0.0).alias("fps"), F.coalesce("alerts", F.lit(0)).alias("alerts"))


def class_histogram(lines: DataFrame, cls: str = "cls") -> DataFrame:
    return lines.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("n"))


def inventory(images: DataFrame, labels: DataFrame, split: str = "split", stem: str = "stem") -> DataFrame:
    """(split, images, labels, paired): files of each kind and stems on both sides."""
    mark = lambda df, i: df.select(split, stem, F.lit(i).alias("i"), F.lit(1 - i).alias("l"))
    each = mark(images, 1).union(mark(labels, 0)).groupBy(split, stem).agg(F.sum("i").alias("i"), F.sum("l").alias("l"))
    return each.groupBy(split).agg(F.sum("i").alias("images"), F.sum("l").alias("labels"), F.count_if((F.col("i") > 0) & (F.col("l") > 0)).alias("paired"))


def candidates(frames: DataFrame, boxes: DataFrame, every: int, annotations: DataFrame | None = None) -> DataFrame:
    """(frame_idx, bbox): of every n-th frame its annotated boxes where there is an annotation table, else its surest box (of equals the least)."""
    kept = frames.filter(F.pmod("frame_idx", F.lit(every)) == 0)
    if annotations is not None:
        return kept.join(annotations, "frame_idx").select("frame_idx", "bbox")
    return top_per_group(kept.join(boxes, "frame_idx"), ["frame_idx"], [F.col("conf").desc(), F.col("bbox").asc()]).select("frame_idx", "bbox")


def tolerant(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType) -> DataFrame:
    """Rows of fn(row) with an `error` column: a row on which fn raises has nulls and the message, and the others go on.

    The hook for detectors, readers and classifiers; schema: what fn returns.
    """
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                try:
                    got = fn(row)
                    rows.append([*(got.get(n) for n in names), None])
                except Exception as e:  # a bad row contributes no evidence
                    rows.append([None] * len(names) + [f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=[*names, "error"], dtype=object)

    return df.mapInPandas(run, T.StructType([*schema.fields, T.StructField("error", T.StringType())]))


def decodable(df: DataFrame, content: str, check: Callable[[bytes], bool]) -> DataFrame:
    """Rows whose content the check takes; one that raises isn't decodable."""

    @F.pandas_udf("boolean")
    def ok(x: pd.Series) -> pd.Series:
        def one(v) -> bool:
            try:
                return v is not None and bool(check(bytes(v)))
            except Exception:
                return False

        return x.map(one)

    return df.filter(ok(F.col(content)))
