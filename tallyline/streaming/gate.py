"""The gate's session machine, as one Python state machine that runs in batch replay here and in Structured Streaming in streaming.sessions.

A session is sequential: rows of a key are taken in the order of seq. The machine holds at most max_collect_frames evidence rows.
Registered variants and colours are joined to frames before the state, so that a registry change takes effect with the next
micro-batch and no task holds the registry.

Defined cases: a frame with a bad session id or source time is set aside by valid(); a null target is none; a null plate text is
a blank read; kind `reset` drops the state; a frame of an older generation than the state's is dropped, one of a newer resets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as X
from tallyline.operators import registry as R
from tallyline.operators import voting as V
from tallyline.params import DEFAULTS, SESSION_ID, Params

FRAME = "session_id string, seq long, source_time_s double, target boolean, plate_text string, plate_conf double, color string, color_conf double, kind string, generation int"
OUT = "session_id string, seq long, state string, run int, ready int, status string, action string, plate string, color_warning boolean, decided_at double"


def valid(frames: DataFrame, session: str = "session_id", time: str = "source_time_s") -> tuple[DataFrame, DataFrame]:
    """(frames to use, frames set aside): a session id of 8 to 64 plain characters and a finite time of 0 or more."""
    t = F.col(time).cast("double")
    ok = F.coalesce(F.col(session).rlike(SESSION_ID) & ~F.isnan(t) & (F.abs(t) < float("inf")) & (t >= 0), F.lit(False))
    return frames.filter(ok), frames.filter(~ok)


def event_row(value: Column) -> Column:
    """A posted JSON event as struct(event_id, source_time_s, playback_time_s, is_playing, status, latency_ms), or null where it isn't one.

    Numbers must be JSON numbers, so that true or "1" is none; a bad latency alone is left out.
    """
    j = F.from_json(value, "event_id string, source_time_s string, playback_time_s string, is_playing string, latency_ms string, decision struct<status:string>")
    number = lambda c: F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), c.cast("double"))
    quoted = lambda name: value.rlike(rf'"{name}"\s*:\s*"')
    good = lambda name: F.when(~quoted(name), F.when(number(j[name]) >= 0, number(j[name])))
    ok = (F.coalesce(F.trim(j["event_id"]), F.lit("")) != "") & good("source_time_s").isNotNull() & good("playback_time_s").isNotNull() & j["is_playing"].isin("true", "false") & (F.coalesce(j["decision"]["status"], F.lit("")) != "")
    row = F.struct(j["event_id"].alias("event_id"), good("source_time_s").alias("source_time_s"), good("playback_time_s").alias("playback_time_s"), (j["is_playing"] == "true").alias("is_playing"), j["decision"]["status"].alias("status"), good("latency_ms").alias("latency_ms"))
    return F.when(F.coalesce(ok, F.lit(False)), row)


@dataclass
class Session:
    """State of one session; update() takes a frame and gives the row to emit."""

    state: str = "IDLE"
    run: int = 0
    ready: int = 0
    seen: int = 0
    generation: int = 0
    evidence: list[list] = field(default_factory=list)
    decision: list | None = None
    decided_at: float | None = None

    def _clear(self) -> None:
        self.evidence, self.ready = [], 0

    def _candidate(self, p: Params) -> list:
        """[status, action, plate, color_warning] of the evidence."""
        frames = [V.Frame(*e[:4]) for e in self.evidence]
        known = {f.eligible: e[4] for f, e in zip(frames, self.evidence) if f.eligible and e[4] is not None}
        d = V.decide(frames, known, self.ready >= p.collect_frames, p)
        if d.status != "COMMIT":
            return [d.status, "LOG", "", False]
        status, action, warning = V.judged(d.plate, d.color, d.color_conf, known, p)
        return [status, action, d.plate, warning]

    def update(self, target: bool, row: list | None, time: float | None, p: Params = DEFAULTS, every: int = 1) -> None:
        """row: plate_text, plate_conf, color, color_conf, registered colour (null if not listed); None where the frame gave no evidence."""
        self.seen += 1
        if self.seen % every:
            return
        if not target:
            self._clear()
            self.state, self.run, self.decision, self.decided_at = "IDLE", 0, None, None
            return
        if self.state == "DECIDED":
            return
        self.run += 1
        if self.run < p.min_persist_frames:
            self._clear()
            self.state = "TRACKING"
            return
        self.state = "READY_TO_DECIDE"
        self.ready += 1
        if row is not None:
            self.evidence = [*self.evidence, row][-p.max_collect_frames :]
        candidate = self._candidate(p)
        agree = sum(V.near(candidate[2], e) for e in (V.eligible(x[0]) for x in self.evidence) if e)
        timed_out = self.ready >= p.max_ready_samples
        # a candidate is shown to nobody before the guard or the time-out lets it through
        if (candidate[0] in ("AUTHORIZED", "UNREGISTERED") and agree >= p.lock_repeat) or timed_out:
            if candidate[0] == "NO_PLATE":
                candidate[:2] = ["UNCERTAIN", "LOG"]
            self.state, self.decision, self.decided_at = "DECIDED", candidate, time


def _fed(session: Session, f: dict, p: Params, every: int) -> tuple[Session, tuple | None]:
    """(session after a frame, the row to emit, if any)."""
    generation = int(f["generation"] or 0)
    if generation < session.generation:
        return session, None
    if f["kind"] == "reset" or generation > session.generation:
        session = Session(generation=max(generation, session.generation))
        if f["kind"] == "reset":
            return session, None
    session.update(bool(f["target"]), [f["plate_text"] or "", f["plate_conf"], f["color"] or "", f["color_conf"], f["registered_color"]], f["source_time_s"], p, every)
    d = session.decision or [None, None, None, False]
    return session, (f["session_id"], int(f["seq"]), session.state, session.run, session.ready, d[0], d[1], d[2], bool(d[3]), session.decided_at)


def _plain(frames: pd.DataFrame) -> Iterator[dict]:
    """Rows in the order of seq, with None for what pandas has as not a number."""
    for f in frames.sort_values("seq").to_dict("records"):
        yield {k: None if v is None or v != v or v is pd.NA else v for k, v in f.items()}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"decided_at": "float64"})


def listed(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """frames with the registered colour of their plate, null where it isn't listed. Frames may be a stream."""
    known = R.first_by_key(registry.select(X.registry_key(F.col("license_plate")).alias("__key"), X.color_key(F.col("car_color")).alias("registered_color"), "row_ord"), "__key", "row_ord")
    return frames.withColumn("__key", X.lock_plate(F.col("plate_text"))).join(known.select("__key", "registered_color"), "__key", "left").drop("__key")


def replay(spark: SparkSession, frames: DataFrame, registry: DataFrame, p: Params = DEFAULTS, every: int = 1, idle_ms: int | None = None) -> DataFrame:
    """One row a frame, as the stream gives it: the machine over each session's frames in order, frame by frame.

    With idle_ms, frames have arrived_ms and done_ms too, and a frame that arrives idle_ms or more after the last was done finds a new session.
    """

    def play(rows: Iterator[dict]) -> Iterator[tuple]:
        session, last = Session(), None
        for f in rows:
            if last is not None and f["arrived_ms"] - last >= idle_ms:
                session = Session()
            session, out = _fed(session, f, p, every)
            last = f["done_ms"] if idle_ms is not None else None
            if out is not None:
                yield out

    names = [c.split()[0] for c in FRAME.split(", ")] + (["arrived_ms", "done_ms"] if idle_ms is not None else [])
    return V.by_session(listed(frames, registry).select(*names, "registered_color"), "session_id", ["seq"], play, OUT)


def frames_of_events(events: DataFrame, **more: str) -> DataFrame:
    """Frames made from the events table: a session a user; a target while values are below 300; plates misread now and then. more: other expressions."""
    from tallyline.plans.inputs import PLATES_EXPR

    cols = {**PLATES_EXPR, "source_time_s": "cast(event_id as double) / 10", "target": "value < 300", "kind": "'frame'", "generation": "0", **more}
    names = [c.split()[0] for c in FRAME.split(", ")]
    return events.selectExpr(*[f"{cols[n].format(s='string')} AS {n}" for n in [*names, *[m for m in more if m not in names]]])
