"""Registry, votes, gate, fuzzy and manifest operators on small cases."""

import os

import pytest
from pyspark.sql import functions as F

from tallyline.operators import curate as C
from tallyline.operators import evaluate as E
from tallyline.operators import fuzzy as Z
from tallyline.operators import hamming as B
from tallyline.operators import manifest as M
from tallyline.operators import ordered as O
from tallyline.operators import registry as R
from tallyline.operators import voting as V
from tallyline.params import Params
from tallyline.streaming import gate

REG = [("30F-12345", "BLACK", 1), ("30f - 123.45", "RED", 2), ("51A-99999", " blue", 3), ("", "RED", 4), (None, None, 5)]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REG, "license_plate string, car_color string, row_ord long")


def test_verify(spark, registry):
    rows = [(1, "30F12345", "black", 0.9), (2, "30f-123.45", "Silver", 0.9), (3, "51A99999", "Red", 0.39), (4, "51A99999", "Red", 0.4), (5, "51A99999", "Red", None), (6, "11B11111", "Red", 0.9), (7, None, None, None), (8, "51A99999", "", 0.9)]
    got = R.verify(spark.createDataFrame(rows, "id long, plate_text string, color string, color_conf double"), registry)
    by = {r.id: (r.status, r.action, r.color_warning) for r in got.collect()}
    assert by == {
        1: ("AUTHORIZED", "ALLOW", False), 2: ("AUTHORIZED", "ALLOW", False), 3: ("AUTHORIZED", "ALLOW", False), 4: ("AUTHORIZED", "ALLOW_WARN", True),
        5: ("AUTHORIZED", "ALLOW_WARN", True), 6: ("UNREGISTERED", "DENY_ALERT", False), 7: ("UNREGISTERED", "DENY_ALERT", False), 8: ("AUTHORIZED", "ALLOW_WARN", True),
    }


def test_registry_changes(spark, registry):
    new = spark.createDataFrame([(" 77C-11111 ", "RED", 10), ("77c11111", "BLUE", 11), ("30F.12345", "RED", 12), (" - ", "RED", 13)], registry.schema)
    grown, refused = R.add(registry, new)
    assert {r.license_plate for r in grown.filter("row_ord >= 10").collect()} == {"77C-11111"}
    assert {r.row_ord for r in refused.collect()} == {11, 12, 13}
    left, gone = R.delete(registry, "30F 12345")
    assert gone and left.count() == 3
    assert R.delete(registry, "nothing")[1] is False


def test_majority(spark):
    rows = [("a", 1, "X", "Red"), ("a", 2, "Y", "Blue"), ("a", 3, "X", "Blue"), ("a", 4, "", "Red"), ("b", 1, "X", ""), ("b", 2, "Y", None), ("c", 1, " ", "Red"), ("c", 2, None, "Red")]
    got = {r.session_id: (r.status, r.plate, r.votes, r.n_frames, r.color) for r in V.majority(spark.createDataFrame(rows, "session_id string, seq long, plate_text string, color string")).collect()}
    assert got == {"a": ("DECIDED", "X", 2, 4, "Red"), "b": ("UNCERTAIN", "", 1, 2, ""), "c": ("NO_PLATE", "", 0, 2, "Red")}


def _f(text, conf, color="Red", cc=0.9):
    return V.Frame(text, conf, color, cc)


def test_decide():
    d = V.decide
    assert d([], set(), False).status == "NO_PLATE"
    assert d([_f("", 0.9), _f("  ", None)], set(), True).status == "NO_PLATE"
    assert d([_f("30K", 0.99)], set(), True).status == "UNCERTAIN"
    assert d([_f("30F12345", 0.9)], set(), False).status == "UNCERTAIN"
    assert d([_f("30F12345", 0.9)], set(), True).plate == "30F12345"
    assert d([_f("30F12345", 0.6), _f("30F-123.45", 0.5)], set(), False).plate == "30F12345"
    assert d([_f("30F12345", 0.45), _f("30F12345", 0.45)], set(), False).status == "UNCERTAIN"
    assert d([_f("30F12345", 0.45), _f("30F12345", 0.45)], set(), True).status == "COMMIT"
    assert d([_f("30F12345", 0.84)], set(), True).status == "UNCERTAIN"
    near = [_f("30F12345", 0.9), _f("30F12345", 0.9), _f("30F12346", 0.6)]
    assert d(near, set(), False).plate == "30F12345"
    assert d(near, {"30F12346"}, False).plate == "30F12346"
    chain = [_f("30F12345", 0.6), _f("30F12346", 0.6), _f("30F12347", 0.6), _f("30F12377", 0.6)]
    got = V.clusters(chain)
    assert len(got) == 1 and got[0]["representative"] == "30F12347"  # one edit from all three others
    two = [_f("30F12345", 0.6), _f("30F12345", 0.6), _f("51A99999", 0.9), _f("51A99999", 0.9)]
    assert d(two, set(), False).plate == "51A99999"
    colors = [_f("30F12345", 0.9, "Blue", 0.5), _f("30F12345", 0.9, "Red", 0.7), _f("30F12345", 0.9, "", None)]
    assert (d(colors, set(), False).color, d(colors, set(), False).color_conf) == ("BLUE", 0.5)
    mixed = [_f("30F12345", 0.9, " red", 0.5), _f("30F12345", 0.9, "Red", None), _f("30F12345", 0.9, "Blue", 0.9)]
    assert (d(mixed, set(), False).color, d(mixed, set(), False).color_conf) == ("RED", 0.25)


def test_lock_aware(spark, registry):
    rows = [("s", i, "30F12345", 0.9, "Red", 0.9) for i in range(60)] + [("t", 1, "51A99999", 0.9, "Blue", 0.9), ("u", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "session_id string, seq long, plate_text string, plate_conf double, color string, color_conf double")
    got = {r.session_id: (r.status, r.action, r.n_frames) for r in V.lock_aware(df, registry).collect()}
    assert got == {"s": ("AUTHORIZED", "ALLOW_WARN", 50), "t": ("AUTHORIZED", "ALLOW", 1), "u": ("NO_PLATE", "LOG", 1)}


def test_vote_dispatch(spark, registry):
    """A session without any plate_conf goes to the majority vote; one with a single value to the lock-aware one."""
    none = [("a", i, t, None, "Red", None) for i, t in enumerate(["30F12345", "30F12345", "30F12346", ""])]
    tie = [("b", i, t, None, "Red", None) for i, t in enumerate(["30F12345", "30F12346"])]
    one = [("c", i, "30F12345", 0.9 if i == 0 else None, "Red", 0.9) for i in range(3)]
    blank = [("d", 0, " ", None, None, None)]
    weak = [("e", i, "30F12345", 0.1 if i else None, "Red", 0.9) for i in range(3)]
    df = spark.createDataFrame(none + tie + one + blank + weak, "session_id string, seq long, plate_text string, plate_conf double, color string, color_conf double")
    got = {r.session_id: (r.plate, r.status, r.action, r.n_frames) for r in V.aggregate(df, registry).collect()}
    assert got == {"a": ("30F12345", "AUTHORIZED", "ALLOW_WARN", 4), "b": ("", "UNCERTAIN", "LOG", 2), "c": ("30F12345", "AUTHORIZED", "ALLOW_WARN", 3), "d": ("", "NO_PLATE", "LOG", 1), "e": ("", "UNCERTAIN", "LOG", 3)}


def _drive(rows, p=Params()):
    s, out = gate.Session(), []
    for i, (target, row) in enumerate(rows):
        s.update(target, row, float(i), p)
        out.append(s.state)
    return s, out


def test_machine():
    read = ["30F12345", 0.9, "Red", 0.9, "BLACK"]
    s, out = _drive([(True, read)] * 4)
    assert out == ["TRACKING", "TRACKING", "READY_TO_DECIDE", "DECIDED"] and s.decision == ["AUTHORIZED", "ALLOW_WARN", "30F12345", True] and s.decided_at == 3.0
    s, out = _drive([(True, read)] * 4 + [(True, read), (False, None)])
    assert out[-2:] == ["DECIDED", "IDLE"] and s.decision is None
    blank = ["", None, "", None, None]
    p = Params(max_ready_samples=5)
    s, out = _drive([(True, blank)] * 7, p)
    assert out[-1] == "DECIDED" and s.decision[:2] == ["UNCERTAIN", "LOG"]
    s, out = _drive([(True, blank)] * 2 + [(True, ["30F12345", 0.9, "", None, None])] + [(True, blank)] * 20)
    assert out[-1] == "READY_TO_DECIDE" and s.decision is None and s.decided_at is None  # a single read waits for the time-out
    s, out = _drive([(True, blank)] * 2 + [(True, ["30F12345", 0.9, "", None, None])] + [(True, blank)] * 20, Params(max_ready_samples=15))
    assert out.index("DECIDED") == 16 and s.decision[:3] == ["UNREGISTERED", "DENY_ALERT", "30F12345"] and s.decided_at == 16.0
    s, out = _drive([(True, read), (False, None), (True, read), (True, read), (True, read)])
    assert out == ["TRACKING", "IDLE", "TRACKING", "TRACKING", "READY_TO_DECIDE"]
    s, _ = _drive([(True, blank)] * 100)
    assert len(s.evidence) == 50


def test_nothing_is_decided_before_the_guard(spark, registry):
    """One sure read and then blanks: no row before DECIDED has a status, an action or a plate."""
    rows = [("session-9", i, float(i), True, "30F12345" if i == 3 else "", 0.95, "Red", 0.9, "frame", 0) for i in range(40)]
    rows += [("session-8", i, float(i), True, "30F12345" if i in (3, 30) else "", 0.95, "Red", 0.9, "frame", 0) for i in range(40)]
    got = gate.replay(spark, spark.createDataFrame(rows, gate.FRAME), registry).collect()
    assert {r.state for r in got if r.session_id == "session-9"} == {"TRACKING", "READY_TO_DECIDE"}
    assert {r.seq for r in got if r.state == "DECIDED"} == set(range(30, 40))
    for r in got:
        assert (r.state == "DECIDED") == (r.status is not None) == (r.action is not None) == (r.plate is not None) == (r.decided_at == 30.0)


def test_event_rows(spark):
    good = '{"event_id":"e1","source_time_s":1.5,"playback_time_s":2,"is_playing":true,"decision":{"status":"AUTHORIZED"},"latency_ms":"x"}'
    bad = ['{"source_time_s":1}', good.replace("1.5", "-1"), good.replace("1.5", "true"), good.replace("1.5", '"1"'), good.replace('"status":"AUTHORIZED"', '"x":1'), "not json", None]
    got = spark.createDataFrame([(v,) for v in [good, *bad]], "v string").select(gate.event_row(F.col("v")).alias("r")).collect()
    assert (got[0].r.event_id, got[0].r.source_time_s, got[0].r.latency_ms) == ("e1", 1.5, None)
    assert all(r.r is None for r in got[1:])
    frames = spark.createDataFrame([("session-1", 0.0), ("short", 1.0), ("session-1", float("nan")), ("session-1", -1.0), (None, 1.0), ("session 12", 1.0)], "session_id string, source_time_s double")
    ok, aside = gate.valid(frames)
    assert (ok.count(), aside.count()) == (1, 5)


def test_fuzzy(spark):
    df = spark.createDataFrame([(v,) for v in ["abc", "abd", "abde", "xbde", "zz", "zz", "", None, "q"]], "v string")
    assert {tuple(r) for r in Z.near_pairs(df, "v").collect()} == {("abc", "abd"), ("abd", "abde"), ("abde", "xbde")}
    assert {(r.value, r.cluster, r.n) for r in Z.near_clusters(df, "v").collect()} == {("abc", "abc", 1), ("abd", "abc", 1), ("abde", "abc", 1), ("xbde", "abc", 1), ("zz", "zz", 2), ("q", "q", 1)}
    assert Z.near_pairs(df.limit(0), "v").count() == 0
    drafts = spark.createDataFrame([("30F12345",), ("30F1234",), ("30F",), ("30F123456",), ("30F12399",), ("51A00000",), ("",), (None,)], "draft string")
    reserved = spark.createDataFrame([("30F-12345",)], "label string")
    got = {r.draft: r.reason for r in Z.near_reserved(drafts, reserved).collect()}
    assert got == {"30F12345": "reserved-label", "30F1234": "near-reserved-label", "30F": None, "30F123456": "near-reserved-label", "30F12399": None, "51A00000": None, "": None, None: None}
    assert {r.draft: r.reason for r in Z.near_reserved(drafts, reserved, guard=None).collect()}["30F"] == "near-reserved-label"


def test_manifest(spark):
    cols = "row_number long, image_path string, label string, source_type string, group_id string, split string, verified string, source_sha256 string, crop_sha256 string"
    h = "ab" * 32
    ok = [(2, "a.jpg", "30F-12345", "real", "g1", "test", "true", h, None), (3, "b.jpg", "51A-99999", "synthetic", "g2", "train", "0", None, "")]
    df = spark.createDataFrame(ok, cols)
    assert M.check(df) is df
    assert tuple(M.summary(df).first()) == (2, 2, 2, 1)
    cases = {
        "C2": (4, "/c.jpg", "11B11111", "real", "g3", "train", "1", None, None), "C3": (4, "a.jpg", "11B11111", "real", "g3", "train", "1", None, None),
        "C5": (4, "c.jpg", "nope", "real", "g3", "train", "1", None, None), "C6": (4, "c.jpg", "11B11111", "scan", "g3", "train", "1", None, None),
        "C7": (4, "c.jpg", "11B11111", "real", "g3", "dev", "1", None, None), "C8": (4, "c.jpg", "11B11111", "real", "g3", "train", "yes", None, None),
        "C9": (4, "c.jpg", "11B11111", "real", " ", "train", "1", None, None), "C10": (4, "c.jpg", "11B11111", "real", "g1", "train", "1", None, None),
        "C11": (4, "c.jpg", "30F12345", "real", "g3", "train", "1", None, None), "C12": (4, "c.jpg", "30F-12345", "real", "g3", "test", "1", None, None),
        "C13": (4, "c.jpg", "11B11111", "real", "g3", "train", "1", "xyz", None), "C14": (4, "c.jpg", "11B11111", "real", "g3", "train", "1", None, h.upper()),
        "C15": (4, "c.jpg", "11B11111", "pseudo", "g3", "val", "1", None, None),
    }
    for rule, row in cases.items():
        broken = spark.createDataFrame([*ok, row], cols)
        assert rule in {r.rule for r in M.violations(broken).collect()}, rule
        with pytest.raises(ValueError, match=rule):
            M.check(broken)
    with pytest.raises(ValueError, match="C1"):
        M.check(df.drop("split"))
    files = spark.createDataFrame([("a.jpg",)], "image_path string")
    assert {(r.rule, r.key) for r in M.violations(df, files).collect()} == {("C4", "b.jpg")}
    other = spark.createDataFrame([(9, "z.jpg", "30F12345", "real", "g9", "train", "1", None, None)], cols)
    assert {tuple(r) for r in M.leaks(df, other).collect()} == {("label", 1)}
    assert [r.row_number for r in M.isolated(df, other, "row_number").collect()] == [3]


def test_curation(spark):
    df = spark.createDataFrame([("l", "s1", "c1", 0.9), ("l", "s1", "c2", 0.8), ("l", "s2", "c3", 0.7), ("l", "s1", "c1", 0.9), ("m", "s1", "c4", 0.1)], "label string, source string, crop string, conf double")
    assert {(r.label, r.crop) for r in C.diverse(df, "label", "source", "crop", "conf", 2).collect()} == {("l", "c1"), ("l", "c3"), ("m", "c4")}
    assert C.diverse(df.limit(0), "label", "source", "crop", "conf").count() == 0
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([0, 1, 63, 62, 0, 1 << 62])], "g string, i long, h long")
    assert {r.i for r in B.greedy(rows, "g", "i", "h", 5).filter("kept").collect()} == {0, 2}
    split = C.grouped_split(spark.range(1000).selectExpr("id", "id % 50 AS g"), "g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()} == {"train": 40, "val": 5, "test": 5}


def test_swap_totals(spark):
    rows = [("BLACK", "WHITE", "ALLOW"), ("Grey", "Silver", "ALLOW_WARN"), ("BLACK", "RED", "ALLOW_WARN"), ("RED", "BLUE", "ALLOW_WARN"), ("RED", "BLUE", None)]
    df = spark.createDataFrame(rows, "registered string, true string, action string")
    assert tuple(E.swap_totals(df).first()) == (5, 3, 2, 0.6, 0.4, 2, 1, 0.5)
    assert tuple(E.swap_totals(df.filter("registered = 'RED'")).first()) == (2, 1, 1, 0.5, 0.5, 0, 0, None)
    assert tuple(E.swap_totals(df.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0, 0, None)


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.95, True)], "c double, ok boolean")
    assert tuple(E.calibrate(df, "c", "ok").first()) == (0.9, 1.0, 0.5, 2, 4, True)
    assert tuple(E.calibrate(df.filter("not ok"), "c", "ok").first()) == (None, None, 0.0, 0, 1, False)
    assert E.gate_sweep(df.limit(0).selectExpr("'x' AS scenario", "'x' AS predicted", "'x' AS registered", "c AS conf"), [0.4]).count() == 0


def test_ordered(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([True, True, None, True, True, True, True])], "k string, o long, v boolean")
    assert [(r.run, r.state) for r in O.gate_state(df, "k", "o", F.col("v"), 3).orderBy("o").collect()] == [(1, "TRACKING"), (2, "TRACKING"), (0, "IDLE"), (1, "TRACKING"), (2, "TRACKING"), (3, "READY_TO_DECIDE"), (4, "READY_TO_DECIDE")]
    assert [r.o for r in O.rising_edges(df, "k", "o", F.col("v")).orderBy("o").collect()] == [0, 3]
    assert [len(r.evidence) for r in O.sliding_evidence(df, "k", "o", ["o"], 3).orderBy("o").collect()] == [1, 2, 3, 3, 3, 3, 3]


def test_plan_keeps_pairs_apart(spark):
    df = spark.createDataFrame([("abc",), ("abd",)], "v string")
    plan = Z.near_pairs(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)


def test_running_sums_and_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], float(rng.integers(0, 40)) if i % 7 else None) for i in range(500)] + [("c", None), ("d", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.p50, r.p95) for r in E.percentiles(df, ["k"], "v").collect()}
    for k in ("a", "b", None, "d"):
        own = [v for x, v in rows if x == k and v is not None]
        assert got[k][0] == len(own) and np.allclose(got[k][1:], np.percentile(own, [50, 95]))
    assert got["c"] == (0, None, None)
    run = C.running(spark.range(100).repartition(7), [-F.col("id")], {"total": "id"}).orderBy("id").collect()
    assert [r.total for r in run] == [sum(range(i, 100)) for i in range(100)]
    plan = E.calibrate(spark.range(100).selectExpr("id / 100D AS c", "id > 50 AS ok"), "c", "ok")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(c" not in plan


def test_small_helpers(spark):
    files = spark.createDataFrame([("a.jpg", bytearray(b"x")), ("b.jpg", bytearray(b"y"))], "image_path string, content binary")
    rows = spark.createDataFrame([("a.jpg", "2D711642B726B04401627CA9FBAC32F5C8530FB1903CC4DB02258717921A4881"), ("b.jpg", "00"), ("c.jpg", "00")], "image_path string, source_sha256 string")
    assert {r.image_path: r.provenance for r in M.provenance(rows, files).collect()} == {"a.jpg": "verified", "b.jpg": "mismatch", "c.jpg": "unavailable"}
    reads = spark.createDataFrame([("30F12345", 0.6), ("30F12346", 0.6), ("30F12347", 0.6), ("30F12377", 0.6), ("51A99999", 0.9)], "p string, c double")
    got = {r.representative: r["count"] for r in Z.representatives(reads, "p", "c", Z.near_clusters(reads, "p")).collect()}
    assert got == {"30F12347": 4, "51A99999": 1}
