import pytest
from pyspark.sql import functions as F

from tallyline.functions import decode as D
from tallyline.functions import geometry as G
from tallyline.functions import text as X
from tallyline.params import PLATE


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, plate, registry, detected", [("30f - 123.45", "30F12345", "30F12345", "30F12345"), (None, "", None, None), ("straße 1", "STRAE1", "STRASSE1", "STRASSE1"), ("30F\t1", "30F1", "30F1", "30F\t1"), ("", "", "", "")])
def test_normalisers(spark, raw, plate, registry, detected):
    c = F.lit(raw).cast("string")
    assert _one(spark, X.plate_text(c)) == plate
    assert _one(spark, X.registry_key(c)) == registry
    assert _one(spark, X.detected_key(c)) == detected


@pytest.mark.parametrize("raw, ok, lock", [("30F12345", True, "30F12345"), ("30F1234", True, None), ("30F12345\n", False, "30F12345"), ("30f12345", False, "30F12345"), ("30K", False, None), (None, False, None)])
def test_plate_format(spark, raw, ok, lock):
    c = F.lit(raw).cast("string")
    assert _one(spark, X.is_plate(c)) is ok
    assert _one(spark, X.lock_plate(c)) == lock


@pytest.mark.parametrize("conf, band", [(0.0, "0.0-0.1"), (0.3, "0.3-0.4"), (0.99, "0.9-1.0"), (1.0, "1.0"), (1.5, "1.0"), (None, None)])
def test_bands(spark, conf, band):
    assert _one(spark, X.confidence_band(F.lit(conf).cast("double"))) == band


def test_verified_and_colors(spark):
    assert [_one(spark, X.verified(F.lit(v))) for v in ("True", " 1 ", "0", "false", "yes", "")] == [True, True, False, False, None, None]
    assert _one(spark, X.color_of(F.lit("Nardo Gray"))) == "Grey"
    assert _one(spark, X.color_of(F.lit("mauve"))) is None
    assert _one(spark, X.colors_equivalent(F.lit("BLACK"), F.lit("SILVER"))) is True
    assert _one(spark, X.colors_equivalent(F.lit("RED"), F.lit("SILVER"))) is False


def test_boxes(spark):
    b = _one(spark, G.pixel_box(F.lit(-3.0), F.lit(2.5), F.lit(700.0), F.lit(3.5), F.lit(640), F.lit(480)))
    assert tuple(b) == (0, 2, 640, 4)  # half to even
    assert _one(spark, G.pixel_box(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(9), F.lit(9))) is None
    assert _one(spark, G.yolo_box(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(0.5), F.lit(10), F.lit(10))) is None
    assert _one(spark, G.coco_to_yolo(F.lit(10.0), F.lit(20.0), F.lit(20.0), F.lit(40.0), F.lit(100), F.lit(100))) == "0 0.200000 0.400000 0.200000 0.400000"
    assert tuple(_one(spark, G.body_band(F.lit(100)))) == (20, 85)
    assert tuple(_one(spark, G.body_band(F.lit(2)))) == (0, 2)


def test_ctc(spark):
    rows = [[5.0, 0.0, 0.0], [5.0, 0.0, 0.0], [0.0, 0.0, 5.0], [5.0, 0.0, 0.0], [0.0, 5.0, 0.0]]
    df = spark.createDataFrame([(rows,), ([[0.0, 0.0, 9.0]],)], "r array<array<double>>")
    got = [tuple(r.x) for r in df.select(D.ctc_decode(F.col("r"), "AB").alias("x")).collect()]
    assert got[0][0] == "AAB" and 0.98 < got[0][1] < 0.99
    assert got[1] == ("", 0.0)
    assert [_one(spark, D.ctc_timesteps(F.lit(v))) for v in ("", "A", "AAB", "AABBB")] == [0, 1, 4, 8]
    assert _one(spark, D.encode_labels(F.lit("0AZ"))) == [0, 10, 35]
    assert _one(spark, D.encode_labels(F.lit("0a"))) is None


def test_reading_order(spark):
    parts = "array(named_struct('text','456','cx',20.0D,'cy',52.0D), named_struct('text','30','cx',5.0D,'cy',10.0D), named_struct('text','F1','cx',30.0D,'cy',12.0D), named_struct('text','23','cx',2.0D,'cy',50.0D))"
    assert _one(spark, D.reading_order(F.expr(parts))) == "30F123456"
    assert [_one(spark, D.reading_order(F.expr(f"cast({v} as array<struct<text:string,cx:double,cy:double>>)"))) for v in ("array()", "null")] == ["", None]
    # the parts are worked out once, not again for each of them
    assert str(D.reading_order(F.col("given"))).count("given") == 1


def test_merges(spark):
    obs = F.expr("array(named_struct('text','123.45','conf',0.9D,'y',0.1D), named_struct('text','30F','conf',0.7D,'y',0.8D), named_struct('text','x','conf',0.1D,'y',0.5D))")
    assert tuple(_one(spark, D.merged_observation(obs, PLATE))) == ("30F12345", 0.7)
    single = F.expr("array(named_struct('text','30F12345','conf',0.6D,'y',0.1D), named_struct('text','zz','conf',0.9D,'y',0.9D))")
    assert tuple(_one(spark, D.merged_observation(single, PLATE))) == ("30F12345", 0.6)
    none = F.expr("array(named_struct('text','zz','conf',0.9D,'y',0.9D))")
    assert _one(spark, D.merged_observation(none, PLATE)) is None
    lines = F.expr("array(named_struct('text','-','conf',0.1D,'y_min',5.0D), named_struct('text','b2','conf',0.5D,'y_min',9.0D), named_struct('text','A1','conf',1.0D,'y_min',1.0D))")
    assert tuple(_one(spark, D.lines_by_height(lines))) == ("A1B2", 0.75)


def test_small_bands(spark):
    counts = F.expr("array(named_struct('band','a','n',3L), named_struct('band','b','n',8L), named_struct('band','c','n',20L), named_struct('band','d','n',2L))")
    assert [(r.bands, r.n) for r in _one(spark, D.merge_small_bands(counts))] == [(["a", "b"], 11), (["c"], 20), (["d"], 2)]
