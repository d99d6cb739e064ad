"""The chains on small cases with known results, nulls, ties and empty tables."""

import pytest

from tallyline.operators import chains as H

BOX = "image string, rel_path string, source_sha256 string, width int, height int, box_index int, cx double, cy double, bw double, bh double, parts array<struct<text:string,conf:double,y:double>>, crop_sha256 string, focus double"
KEPT = "label string, source_sha256 string, crop_sha256 string"
READ = [("12345", 0.9, 0.2), ("30a-", 0.8, 0.8)]


def _row(i, image=None, source="s", size=(640, 480), at=(0.5, 0.5, 0.25, 0.1), parts=READ, crop=None, focus=1.0):
    image = image or f"car{i}.jpg"
    return (image, f"a/{image}", source, *size, i, *at, parts, crop or f"c{i}", focus)


@pytest.fixture(scope="module")
def boxes(spark):
    plate = lambda t: [(t, 0.7, 0.5)]
    rows = [
        _row(0), _row(1, image="aGen1.jpg"), _row(2, source="RES"), _row(3, size=(None, None)), _row(4, at=(0.5, 0.5, 0.0, 0.1)), _row(5, at=(0.5, 0.5, 0.25, 0.03)),
        _row(6, parts=None), _row(7, parts=[]), _row(8, parts=plate("no plate")), _row(9, parts=plate("51B99999")), _row(10, parts=plate("51B99998")), _row(11, parts=plate("51B9999")), _row(12, crop="CR"),
        _row(13, image=None, source=None, crop=None), _row(14, at=(0.5, 0.5, 0.1, 0.1)),
    ]
    return spark.createDataFrame(rows, BOX)


@pytest.fixture(scope="module")
def reserved(spark):
    return spark.createDataFrame([("51b-999.99", "res ", ""), ("", None, "cr"), (None, "", None)], KEPT)


def _reasons(df):
    return {r.box_index: r.reason for r in df.collect()}


def test_pseudo_labels(boxes, reserved):
    got = _reasons(H.pseudo_labels(boxes, reserved))
    want = {0: "kept", 1: "excluded-source", 2: "reserved-source-hash", 3: "unreadable", 4: "too-small", 5: "too-small", 6: "unreadable", 7: "unreadable", 8: "invalid-format"}
    want |= {9: "reserved-label", 10: "reserved-label", 11: "reserved-label", 12: "reserved-crop-hash", 13: "kept", 14: "kept"}
    assert got == want


def test_car_boxes_and_review(boxes, reserved):
    judged = H.car_boxes(boxes, reserved)
    got = _reasons(judged)
    assert {k: got[k] for k in (4, 5, 9, 10, 11, 14)} == {4: "low-aspect", 5: "low-aspect", 9: "reserved-label", 10: "near-reserved-label", 11: "near-reserved-label", 14: "low-aspect"}
    rows = H.review(judged).collect()
    assert {(r.label_draft, r.crop_sha256, r.box_json) for r in rows} == {("30A12345", "c0", "[240,216,400,264]"), ("30A12345", "c13", "[240,216,400,264]")}
    assert {r.ocr_confidence for r in rows} == {0.8}


def test_review_takes_other_sources_first(spark):
    rows = [_row(i, source="s1", parts=[("30A12345", 0.9 - i / 100, 0.5)]) for i in range(3)] + [_row(9, source="s2", parts=[("30A12345", 0.1, 0.5)])]
    df = spark.createDataFrame(rows, BOX)
    judged = H.car_boxes(df, spark.createDataFrame([], KEPT))
    assert {r.crop_sha256 for r in H.review(judged, 3).collect()} == {"c0", "c1", "c9"}
    assert {r.crop_sha256 for r in H.review(judged, 2).collect()} == {"c0", "c9"}


def test_review_is_the_same_in_any_layout(spark, reserved):
    """Copies of a crop in other images of the same source."""
    rows = [_row(i, source="s", crop=f"c{i % 4}") for i in range(40)]
    names = lambda order: {r.crop_name for r in H.review(H.car_boxes(spark.createDataFrame(order, BOX).coalesce(1), reserved)).collect()}
    assert names(rows) == names(rows[::-1])


def test_boxes_stay_where_they_are(spark, boxes):
    """Few reserved rows out of a large table: neither their hashes nor their labels call for a shuffle of the boxes."""
    some = spark.range(3_000_000).filter("id % 1000000 = 7").selectExpr("concat('51B9999', id % 10) AS label", "concat('s', id) AS source_sha256", "concat('c', id) AS crop_sha256")
    for judged in (H.pseudo_labels(boxes, some), H.car_boxes(boxes, some)):
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
        assert _reasons(judged)[10] != "kept" and _reasons(judged)[0] == "kept"


def test_boxes_are_told_apart_by_their_keys(spark, tmp_path):
    from tallyline.plans import inputs as I

    rows = [(k, 5, s, 1) for k in (1, 2, 2) for s in (3, 803, 103, 35, None)] + [(3, 1_000_005, 3, 1), (3, 5, 3, 1), (3, 5, 3, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = I.boxes(spark, str(tmp_path))
    whole = I._df(I.table(spark, str(tmp_path), "lineitem"), I.BOXES_EXPR | {"parts": I.PARTS}).drop("kind").distinct()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect())) and got.count() == 11
    assert "hashpartitioning(l_orderkey" in got._jdf.queryExecution().executedPlan().toString()
    images = got.select("image", "rel_path", "source_sha256", "width", "height").distinct()
    assert sorted(map(repr, I.images(spark, str(tmp_path)).collect())) == sorted(map(repr, images.collect()))


def test_review_takes_the_first_copy_by_path_and_box(spark, reserved):
    """The copy that comes first is neither the narrowest nor the first by its box or its name."""
    rows = [_row(2, image="car2.jpg", at=(0.2, 0.5, 0.25, 0.1), crop="c"), _row(10, image="car1.jpg", at=(0.1, 0.5, 0.2, 0.1), crop="c"), _row(9, image="car1.jpg", at=(0.5, 0.5, 0.5, 0.1), crop="c")]
    got = H.review(H.car_boxes(spark.createDataFrame(rows, BOX), reserved)).collect()
    assert [(r.source_ref, r.box_json) for r in got] == [("a/car1.jpg", "[160,216,480,264]")]


def test_funnel_counts_images_of_the_external_export(spark, boxes, reserved):
    df = boxes.union(spark.createDataFrame([_row(2, source="res"), _row(20, image="aGen1.jpg", source="res")], BOX))
    each = {r.reason: r.n for r in H.funnel_counts(H.car_boxes(df, reserved)).collect()}
    image = {r.reason: r.n for r in H.funnel_counts(H.car_boxes(df, reserved, detector=True), per_image=True).collect()}
    assert each["reserved-source-hash"] == 2 and each["excluded-source"] == 2
    assert image["reserved-source-hash"] == 2 and "excluded-source" not in image  # car2.jpg and aGen1.jpg, once each


def test_external_boxes(spark):
    frames = spark.createDataFrame([("f.jpg", "a/f.jpg", "s", 100, 80), ("g.jpg", "a/g.jpg", "t", None, None)], "image string, rel_path string, source_sha256 string, width int, height int")
    found = [("a/f.jpg", 0, 10.9, 10.0, 200.0, 40.0, 0.5, READ, "x"), ("a/f.jpg", 1, 99.0, 10.0, 99.0, 40.0, None, READ, "y"), ("a/g.jpg", 0, 0.0, 0.0, 90.0, 30.0, 0.25, READ, "z")]
    df = spark.createDataFrame(found, "rel_path string, box_index int, x1 double, y1 double, x2 double, y2 double, conf double, parts array<struct<text:string,conf:double,y:double>>, crop_sha256 string")
    judged = H.car_boxes(H.external_boxes(frames, df), spark.createDataFrame([], KEPT), detector=True)
    got = {r.crop_sha256: (r.reason, r.filter_notes, r.box and tuple(r.box)) for r in judged.collect()}
    assert got == {"x": ("kept", "detector:0.5000", (10, 10, 100, 40)), "y": ("low-aspect", "detector:0.0000", None), "z": ("low-aspect", "detector:0.2500", None)}


def test_external_review_takes_the_first_copy_by_path_and_box(spark):
    """Three boxes of a source show one crop: the first by path and box stays, whatever its width, its note and its row."""
    frames = spark.createDataFrame([("f.jpg", "a/f.jpg", "s", 640, 480), ("e.jpg", "a/e.jpg", "s", 640, 480)], "image string, rel_path string, source_sha256 string, width int, height int")
    found = [("a/f.jpg", 0, 10.0, 10.0, 100.0, 40.0, 0.1, READ, "x"), ("a/e.jpg", 10, 5.0, 10.0, 95.0, 40.0, 0.2, READ, "x"), ("a/e.jpg", 9, 10.0, 10.0, 200.0, 40.0, 0.5, READ, "x")]
    df = spark.createDataFrame(found, "rel_path string, box_index int, x1 double, y1 double, x2 double, y2 double, conf double, parts array<struct<text:string,conf:double,y:double>>, crop_sha256 string")
    judged = H.car_boxes(H.external_boxes(frames, df), spark.createDataFrame([], KEPT), detector=True)
    got = H.review(judged, notes=judged.filter_notes).collect()
    assert [(r.source_ref, r.filter_notes) for r in got] == [("a/e.jpg", "detector:0.5000")] and "box_index" not in got[0]


def test_candidates(spark, reserved):
    rows = [_row(0, image="a.rf.1.jpg", focus=1.0), _row(1, image="a.rf.2.jpg", focus=2.0), _row(2, image="b.jpg", focus=9.0, at=(0.5, 0.5, 0.1, 0.1)), _row(3, image="c.jpg", focus=8.0, crop="CR"), _row(4, image="c.jpg", focus=7.0), _row(5, source="cr")]
    got = [(r.candidate_id, r.group_id, r.crop_sha256) for r in H.review_candidates(spark.createDataFrame(rows, BOX), reserved).orderBy("candidate_id").collect()]
    # b is too narrow, so it comes last; the best crop of c is reserved, in another case, and leaves none
    assert [(g, c) for _, g, c in got] == [("det:a", "c1"), ("det:b", "c2")] and [i for i, _, _ in got] == ["candidate-0000", "candidate-0001"]


def test_audit_joins_small_bands(spark):
    rows = [(f"images/{i:03d}", 0.05) for i in range(40)] + [("images/x", 0.55), ("images/y", 1.0), ("images/z", None)]
    got = H.audit(spark.createDataFrame(rows, "image_path string, ocr_confidence double"), n=30, cells=20).orderBy("cell").collect()
    assert len(got) == 32 and [r.cell for r in got] == list(range(1, 33)) and [r.sheet for r in got] == [1] * 20 + [2] * 12
    assert [(r.image_path, r.band) for r in got[-2:]] == [("images/x", "+".join(H.BANDS[1:])), ("images/y", "+".join(H.BANDS[1:]))]


def test_curation(spark):
    web = spark.createDataFrame([("1", "a", 0), ("2", "a", 1), ("3", "a", 2**40 - 1), ("4", "b", 0), ("5", None, 0)], "name string, label string, phash long")
    own = spark.createDataFrame([("1", "a", 2**62 - 1), ("9", "a", -1)], "name string, label string, phash long")
    seen = spark.createDataFrame([(n,) for n in ("web_1", "web_2", "web_3", "web_4", "own_1")], "name string")
    got = {r.name: r.fate for r in H.curate_images({"web": web, "own": own}, seen, 2, ["own_"]).collect()}
    assert got == {"own_1": "train", "web_1": "train", "web_2": "near-duplicate", "web_3": "overflow", "web_4": "train", "web_5": "no-vehicle", "own_9": "no-vehicle"}


def test_empty(spark, boxes, reserved):
    none, nothing = boxes.limit(0), reserved.limit(0)
    assert H.review(H.car_boxes(none, reserved)).count() == 0 and H.review_candidates(none, reserved).count() == 0
    assert H.audit(H.pseudo_manifest(H.pseudo_labels(none, nothing))).count() == 0
    assert _reasons(H.pseudo_labels(boxes, nothing))[9] == "kept"
