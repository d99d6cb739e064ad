"""Streams: sessions with timers, the sampler, pacing, the HTTP source and its quarantine."""

import json
import math
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tallyline.sources import http
from tallyline.streaming import gate, intake, sessions

REG = [("30F-12345", "BLACK", 1), ("51A-99999", "BLUE", 2)]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REG, "license_plate string, car_color string, row_ord long")


def waits(ready, seconds=120):
    end = time.monotonic() + seconds
    while not ready() and time.monotonic() < end:
        time.sleep(0.5)
    assert ready()


def started(df, name, tmp_path):
    return df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()


def frame_rows(k, seqs, **more):
    base = {"target": True, "plate_text": "30F12345", "plate_conf": 0.3, "color": "Black", "color_conf": 0.9, "kind": "frame", "generation": 0, **more}
    return [(f"session-{k}", i, float(i), *[base[c] for c in ("target", "plate_text", "plate_conf", "color", "color_conf", "kind", "generation")]) for i in seqs]


def add_file(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def source(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_stream_equals_replay(spark, registry, tmp_path):
    """Commits, resets and passing generations over three micro-batches."""
    rows = []
    for k in range(6):
        for i in range(30):
            rows.append((f"session-{k}", i, float(i), i % 13 != k, "30F12345" if (i + k) % 4 else "30F1234", 0.3 + (i * 7 + k) % 60 / 100, "Red", None if i % 5 == 0 else 0.8, "reset" if i == 20 and k == 2 else "frame", 1 if k == 3 and 10 <= i < 15 else 0))
    for part in range(3):  # in order, a file a batch
        add_file(spark, [r for r in rows if r[1] // 10 == part], gate.FRAME, tmp_path / "in")
    want = gate.replay(spark, spark.createDataFrame(rows, gate.FRAME), registry)
    q = started(sessions.stream(source(spark, gate.FRAME, tmp_path / "in"), registry), "gate_out", tmp_path)
    expected = want.count()
    try:
        waits(lambda: spark.table("gate_out").count() >= expected, 240)
    finally:
        q.stop()
    plain = lambda d: sorted(map(tuple, d.fillna(-1.0).collect()), key=str)
    assert plain(spark.table("gate_out")) == plain(want) and expected > 100


def test_idle_sessions_go_and_active_ones_stay(spark, registry, tmp_path):
    """One session pauses for longer than idle_ms and begins anew; the other gets a frame now and then and keeps its run."""
    (tmp_path / "in").mkdir()
    q = started(sessions.stream(source(spark, gate.FRAME, tmp_path / "in"), registry, idle_ms=6000), "idle_out", tmp_path)
    seen = lambda: {(r.session_id, r.seq): r.run for r in spark.table("idle_out").collect()}
    try:
        add_file(spark, frame_rows(1, [0, 1]) + frame_rows(2, [0, 1]), gate.FRAME, tmp_path / "in")
        waits(lambda: len(seen()) == 4)
        for i in range(2, 7):
            time.sleep(2)
            add_file(spark, frame_rows(2, [i]), gate.FRAME, tmp_path / "in")
            waits(lambda i=i: ("session-2", i) in seen())
        add_file(spark, frame_rows(1, [2]), gate.FRAME, tmp_path / "in")
        waits(lambda: ("session-1", 2) in seen())
    finally:
        q.stop()
    runs = seen()
    assert runs["session-1", 1] == 2 and runs["session-1", 2] == 1
    assert [runs["session-2", i] for i in range(7)] == list(range(1, 8))


def test_idle_time_runs_from_completion(spark, registry):
    """A frame at 0 ms that is done at 250 s: at 500 s the session is there still, at 550 s it isn't."""
    names = gate.FRAME + ", arrived_ms long, done_ms long"
    rows = [(*r, 0, 250_000) if r[1] == 0 else (*r, at, at) for at, k in ((500_000, 1), (550_000, 2)) for r in frame_rows(k, [0, 1])]
    got = {(r.session_id, r.seq): r.run for r in gate.replay(spark, spark.createDataFrame(rows, names), registry, idle_ms=300_000).collect()}
    assert got["session-1", 1] == 2 and got["session-2", 1] == 1


def test_sampler_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{k}", i, 40.0 * i if rng.random() < 0.95 else None, rng.choice(["offer"] * 6 + ["done"] * 3 + ["reset"])) for k in range(5) for i in range(60)]
    for part in range(3):
        add_file(spark, [r for r in rows if r[1] // 20 == part], sessions.OFFER, tmp_path / "in")
    want = sorted(map(tuple, sessions.sampled(spark.createDataFrame(rows, sessions.OFFER)).collect()))
    q = started(sessions.sampled_stream(source(spark, sessions.OFFER, tmp_path / "in")), "sent_out", tmp_path)
    try:
        waits(lambda: spark.table("sent_out").count() >= len(want))
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("sent_out").collect())) == want and len(want) > 50


def test_sampler_by_hand(spark):
    rows = [("s", i, t, k) for i, (t, k) in enumerate([(0.0, "offer"), (50.0, "offer"), (100.0, "offer"), (200.0, "offer"), (210.0, "done"), (220.0, "done"), (230.0, "done"), (299.0, "offer"), (300.0, "offer"), (310.0, "reset"), (311.0, "offer")])]
    got = sorted((r.offer_seq, r.sent_seq) for r in sessions.sampled(spark.createDataFrame(rows, sessions.OFFER)).collect())
    assert got == [(0, 0), (3, 4), (8, 8), (10, 10)]  # 1 came too soon, 2 gave way to 3, 5 ended 3's request


def test_pacing_against_the_loop(spark):
    rng, rows, want = random.Random(2), [], {}
    for k in range(20):
        clock, index = 0.0, 0
        for i in range(50):
            clock += rng.choice([0.01, 0.04, 0.2, 1.5])
            target = max(index, int(max(0.0, clock - 0.5) * 25))
            want[f"s{k}", i] = (target, target - index)
            index = target + 1
            rows.append((f"s{k}", i, clock))
    df = spark.createDataFrame(rows, "session_id string, seq long, elapsed_s double")
    shown = sessions.paced(df, 25, 0.5)
    assert {(r.session_id, r.seq): (r.frame, r.skipped) for r in shown.collect()} == want
    all_frames = sessions.with_skipped(shown, "session_id").groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("d"), F.max("frame").alias("m"), F.count_if("displayed").alias("shown")).collect()
    assert all(r.n == r.d == r.m + 1 and r.shown == 50 for r in all_frames)
    assert sessions.paced(df.withColumn("n_frames", F.lit(30)), 25, 0.5, n_frames="n_frames").agg(F.max("frame")).first()[0] <= 29


@pytest.fixture
def log():
    lines = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            if at.path == "/offset":
                body = json.dumps({"end": len(lines)})
            else:
                q = parse_qs(at.query)
                body = "".join(json.dumps(x) + "\n" for x in lines[int(q["start"][0]) : int(q["end"][0])])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield lines, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def line(i, **more):
    return json.dumps({"session_id": "session-1", "seq": i, "source_time_s": i / 10, "plate_text": "30F12345", **more})


def test_frames_over_http(spark, log, tmp_path):
    """Frames posted before, during and between two runs come once each; what is no frame goes to the quarantine, each with a reason."""
    lines, url = log
    good, aside, cp = (str(tmp_path / x) for x in ("frames", "aside", "cp"))
    bad = {"not json": "not a frame", "[1]": "not a frame", line(0, seq="x"): "not a frame", line(0, session_id="short"): "bad session id", line(0, source_time_s=-1): "bad source time", line(0, source_time_s=None): "bad source time", line(0, seq=None): "no sequence number"}

    def run(upto):
        q = intake.store(http.frames(spark, url, lines="7"), good, aside, cp)
        n = lambda: sum(intake.stored(spark, p).count() for p in (good, aside)) if (tmp_path / "aside").exists() else 0
        try:
            waits(lambda: n() >= upto)
            q.processAllAvailable()
        finally:
            q.stop()

    lines += [line(i) for i in range(20)] + list(bad)
    run(27)
    lines += [line(i) for i in range(20, 45)]
    run(52)
    got = intake.stored(spark, good)
    assert sorted(r.seq for r in got.collect()) == list(range(45)) and got.filter("kind = 'frame' and not target and generation = 0").count() == 45
    assert {r.body: r.reason for r in intake.stored(spark, aside).collect()} == bad and intake.stored(spark, aside).count() == len(bad)
    assert sorted(r.offset for p in (good, aside) for r in intake.stored(spark, p).collect()) == list(range(52))


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    """foreachBatch's function, twice with one number."""
    raw = spark.createDataFrame([(0, line(0)), (1, "x"), (2, None)], "offset long, body string")
    calls = {}

    class Writer:
        def foreachBatch(self, f):
            calls["write"] = f
            return self

        def option(self, *a):
            return self

        def start(self):
            return self

    class Stream:
        writeStream = Writer()

    intake.store(Stream(), str(tmp_path / "f"), str(tmp_path / "a"), "cp")
    calls["write"](raw, 3)
    calls["write"](raw, 3)
    assert (intake.stored(spark, str(tmp_path / "f")).count(), intake.stored(spark, str(tmp_path / "a")).count()) == (1, 2)


def test_lost_lines_are_an_error(log):
    lines, url = log
    lines += ["a", "b"]
    reader = http.LogReader(url, 10, 5)
    assert reader.latestOffset() == {"line": 2} and list(reader.read(http.Range(0, 2))) == [(0, "a"), (1, "b")]
    with pytest.raises(OSError):
        list(reader.read(http.Range(0, 3)))
    assert math.ceil(25 / 10) == len(reader.partitions({"line": 0}, {"line": 25}))
