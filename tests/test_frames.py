from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators import frames as X


def test_single_frame(spark):
    frames = spark.createDataFrame([(1, "Red", 0.9), (2, "Red", 0.9), (3, "Red", 0.9), (4, "Red", 0.9)], "frame long, color string, color_conf double")
    vehicles = spark.createDataFrame([(1, 0, 2, 5.0), (1, 1, 2, 5.0), (1, 2, 0, 99.0), (2, 0, 7, 1.0)], "frame long, det_ord long, cls int, area double")
    plates = spark.createDataFrame([(1, 0, 0, 0.5, "30F12345"), (1, 0, 1, 0.5, "X"), (1, 1, 2, 0.9, "Y"), (2, None, 0, 0.9, "30F12345"), (3, None, 0, 0.9, "11B11111"), (4, None, 0, 0.9, " ")], "frame long, vehicle_ord long, det_ord long, conf double, plate_text string")
    registry = spark.createDataFrame([("30F-12345", "Red", 1)], "license_plate string, car_color string, row_ord long")
    got = {r.frame: (r.status, r.action) for r in X.single_frame(frames, vehicles, plates, registry).collect()}
    assert got == {1: ("AUTHORIZED", "ALLOW"), 2: ("NO_PLATE", "LOG"), 3: ("UNREGISTERED", "DENY_ALERT"), 4: ("NO_PLATE", "LOG")}


def test_hooks(spark):
    df = spark.createDataFrame([(1,), (0,), (4,)], "v long")
    got = X.tolerant(df, lambda r: {"q": 8 // int(r["v"])}, T.StructType([T.StructField("q", T.LongType())])).collect()
    assert sorted((r.q is None, r.q or 0, (r.error or "")[:17]) for r in got) == [(False, 2, ""), (False, 8, ""), (True, 0, "ZeroDivisionError")]
    raw = spark.createDataFrame([(b"ok",), (b"no",), (None,)], "c binary")
    assert X.decodable(raw, "c", lambda b: b == b"ok" or 1 / 0).count() == 1


def test_rows(spark):
    boxes = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "frame long, det_ord long, conf double")
    assert X.best_box(boxes, "frame").first().det_ord == 0
    got = {r.frame: [b.det_ord for b in r.boxes] for r in X.detections_of(spark.range(1, 3).withColumnRenamed("id", "frame"), boxes).collect()}
    assert got == {1: [0, 1], 2: []}
    cards = spark.createDataFrame([("", "", "Red", 0.12345, "UNREGISTERED", "DENY_ALERT"), (None, "X", "Red", None, "AUTHORIZED", "ALLOW")], "plate string, plate_text string, color string, color_conf double, status string, action string")
    assert [(r.plate_shown, r.color_percent, r.alert) for r in X.card(cards).collect()] == [("—", 12.35, True), ("X", None, False)]
    idx = spark.range(6).withColumnRenamed("id", "frame_idx")
    found = spark.createDataFrame([(3, 0.5, [2]), (3, 0.5, [1]), (4, 0.9, [0])], "frame_idx long, conf double, bbox array<int>")
    assert [(r.frame_idx, r.bbox) for r in X.candidates(idx, found, 3).collect()] == [(3, [1])]
    json = spark.range(1).select(X.overlays(F.array(F.struct(F.array(F.lit(1)).alias("bbox"), F.lit(0.5).alias("conf"), F.lit("car").alias("class"), F.lit(9).alias("x")))).alias("j")).first().j
    assert json == '[{"bbox":[1],"conf":0.5,"class":"car"}]'
    assert spark.range(1).select(X.edge_state(F.lit("READY_TO_DECIDE")).alias("s"), X.usable(F.lit(2), F.lit(1)).alias("u")).first() == ("REVERSING_VERIFYING", False)
