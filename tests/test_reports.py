"""OCR report, security trials and composition, at their edges."""

import pytest
from pyspark.sql import functions as F

from tallyline.operators import curate as C
from tallyline.operators import evaluate as E
from tallyline.operators import manifest as M
from tallyline.sources import snapshots

READS = "engine string, subset string, kind string, truth string, prediction string, latency_ms double, seq long"


def test_ocr_report(spark):
    """Warm-up calls count nowhere, the first cold call is the cold one, an empty subset has zeros, an engine with no samples has no latencies."""
    rows = [("a", "frozen", "cold", "30A12345", "30A12345", 90.0, 2), ("a", "frozen", "cold", "30A12345", "30A12345", 50.0, 1), ("a", "frozen", "warm", "x", "y", 9.0, 3), ("b", "expanded", "cold", "x", "y", 7.0, 1)]
    rows += [("a", "frozen", "sample", "30A12345", p, ms, 10 + i) for i, (p, ms) in enumerate([("30A12345", 1.0), ("30A1234", 2.0), (None, 10.0)])]
    got = {(r.engine, r.subset): tuple(r)[2:] for r in E.ocr_report(spark.createDataFrame(rows, READS)).collect()}
    assert got["a", "all"] == got["a", "frozen"] and got["a", "all"][:5] == (3, 1 / 3, 9 / 24, 1 / 3, 50.0) and got["a", "all"][5] == 2.0 and abs(got["a", "all"][6] - 9.2) < 1e-12
    assert got["a", "expanded"] == (0, 0.0, 0.0, 0.0, 50.0, None, None) and got["b", "all"] == (0, 0.0, 0.0, 0.0, 7.0, None, None) and len(got) == 6
    gate = E.ocr_deployment(E.ocr_report(spark.createDataFrame(rows, READS)), "a", "b").first()
    assert not gate.passed and len(gate.reasons) == 3
    assert E.ocr_report(spark.createDataFrame([], READS)).count() == 0


def test_a_class_that_wraps_gets_another_order(spark):
    df = spark.createDataFrame([("a", i) for i in range(12)] + [("b", i) for i in range(200)], "c string, i long")
    got = C.round_robin(df, "c", "i", 100).orderBy("turn").collect()
    assert [r.turn for r in got] == list(range(100)) and [r.c for r in got[:4]] == ["a", "b", "a", "b"]
    rounds = {k: [r.i for r in got if r.c == "a" and r["round"] == k] for k in range(5)}
    assert all(sorted(rounds[k]) == list(range(12)) for k in range(4)) and len(rounds[4]) == 2 and len({tuple(rounds[k]) for k in range(4)}) == 4
    assert len({r.i for r in got if r.c == "b"}) == 50
    assert C.round_robin(df, "c", "i", 0).count() == 0 and C.round_robin(df.limit(0), "c", "i", 5).count() == 0


def test_security_trials(spark):
    classes = ("Black", "Red", "White")
    cars = spark.createDataFrame([(i, classes[i % 3]) for i in range(30)], "id long, colour string")
    rows = E.security_trials(cars, "colour", "id", classes, 60).collect()
    assert len(rows) == 180 and len({r.plate for r in rows}) == 180
    by = lambda s: [r for r in rows if r.scenario == s]
    assert all(r.registered == r.true for r in by("legitimate")) and all(r.registered is None for r in by("unregistered"))
    swaps = by("plate_swap")
    assert all(r.registered in classes and r.registered != r.true for r in swaps) and len({(r.true, r.registered) for r in swaps}) == 6
    seen = E.security_trials(cars.withColumn("seen", F.col("colour")).withColumn("conf", F.lit(0.9)), "colour", "id", classes, 60)
    got = {r.metric: r.value for r in E.security_report(seen, "seen", "conf", [0.5]).collect()}
    assert got["legitimate.false_alarms"] == 0 and got["unregistered.rate"] == 1 and got["gate.0.50.false_alarm_rate"] == 0
    missed = sum({r.true, r.registered} == {"Black", "White"} for r in swaps)
    assert got["plate_swap.missed"] == got["plate_swap.neutral_missed"] == missed and 0 < missed < 60


MANIFEST = "image_path string, label string, group_id string, split string, source_sha256 string, crop_sha256 string"


def test_a_breach_stops_the_commit(spark, tmp_path):
    path = str(tmp_path / "manifest")
    rows = lambda *r: spark.createDataFrame(list(r), MANIFEST)
    reserved = rows(("r", "51A-99999", "held", "test", "AA", None))
    good = [rows(("a", "30F12345", "g1", "train", "h1", "h2")), rows(("b", "30F12346", "g2", "val", None, ""), ("b", "30F12346", "g2", "val", None, ""))]
    assert M.compose(good, reserved, path) == {"rows": 3, "reserved": 0, "crossing": 0}
    version, data = snapshots.current(spark, path)
    assert version == 1 and spark.read.parquet(data).count() == 3 and spark.read.parquet(data).columns == reserved.columns
    for bad in (("c", "51a99999", "g3", "train", None, None), ("c", "11B11111", "held", "train", None, None), ("c", "11B11111", "g3", "train", None, " aa "), ("c", "30F-12345", "g3", "test", None, None), ("c", "11B11111", "g1", "val", None, None), ("c", "11B11111", "g3", "val", "h2", None)):
        with pytest.raises(ValueError, match="in two splits"):
            M.compose([*good, rows(bad)], reserved, path)
        assert snapshots.current(spark, path) == (1, data)
    flags = {r.image_path: (r.reserved, r.crossing) for r in M.marked([*good, rows(("c", "51A99999", "g1", "val", None, None))], reserved).collect()}
    assert flags == {"a": (False, True), "b": (False, False), "c": (True, True)}
