"""Keyed sessions in Structured Streaming: the gate's machine, and a sampler with one request in flight, with typed state and timers.

Both run on transformWithStateInPandas, which keeps a key's state in columns of their own and needs the RocksDB state store; states() sets it. A
session is created by its first row, removed when it has been idle for idle_ms after the completion of its last rows (a session whose rows are being
worked on has no such timer), and created anew by the next row, without what it knew. Rows of a key in a micro-batch are taken in the order of seq, in
one pandas frame, so a source that admits a bounded number of rows a batch bounds it too.

Defined cases: those of streaming.gate; a completion without a request in flight changes nothing; null times are no attempts.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor

from tallyline.operators import voting as V
from tallyline.params import DEFAULTS, Params
from tallyline.streaming import gate

HEAD = "state string, run int, ready int, seen int, generation int, status string, action string, plate string, color_warning boolean, decided_at double, expires_ms long"
EVIDENCE = "plate_text string, plate_conf double, color string, color_conf double, registered_color string"
IDLE_MS = 300_000
#: of the sampler
INTERVAL_MS = 100.0
OFFER = "session_id string, seq long, t_ms double, kind string"
SENT = "session_id string, offer_seq long, sent_seq long, offered_ms double, sent_ms double"
SLOT = "busy boolean, pending_seq long, pending_ms double, last_ms double"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def states(spark: SparkSession) -> None:
    """Sets the state store that typed state needs, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _now_ms() -> int:
    return int(time.time() * 1000)


class Gate(StatefulProcessor):
    """One session of the gate: a head of scalars, its evidence rows, and a timer that runs from completion."""

    def __init__(self, p: Params = DEFAULTS, every: int = 1, idle_ms: int = IDLE_MS, now=_now_ms):
        self.p, self.every, self.idle_ms, self.now = p, every, idle_ms, now
        self.kinds = T.StructType.fromDDL(HEAD), T.StructType.fromDDL(EVIDENCE)  # here, as init has no session that could read them

    def init(self, handle) -> None:
        self.handle = handle
        self.head, self.evidence = handle.getValueState("head", self.kinds[0]), handle.getListState("evidence", self.kinds[1])

    def _load(self) -> tuple[gate.Session, int | None]:
        if not self.head.exists():
            return gate.Session(), None
        state, run, ready, seen, generation, *decision, decided_at, expires = self.head.get()
        decision = None if decision[0] is None else list(decision)
        return gate.Session(state, run, ready, seen, generation, [list(e) for e in self.evidence.get()], decision, decided_at), expires

    def _save(self, s: gate.Session, expires: int) -> None:
        status, action, plate, warning = s.decision or (None, None, None, None)
        self.head.update((s.state, s.run, s.ready, s.seen, s.generation, status, action, plate, warning, s.decided_at, expires))
        if s.evidence:
            self.evidence.put([tuple(e) for e in s.evidence])
        else:
            self.evidence.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, expires = self._load()
        if expires is not None:
            self.handle.deleteTimer(expires)
        out = []
        for f in gate._plain(pd.concat(list(rows))):
            session, row = gate._fed(session, f, self.p, self.every)
            out += [row] if row is not None else []
        expires = max(self.now(), timerValues.getCurrentProcessingTimeInMs()) + self.idle_ms
        self._save(session, expires)
        self.handle.registerTimer(expires)
        yield gate._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.head.clear()
        self.evidence.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream(frames: DataFrame, registry: DataFrame, p: Params = DEFAULTS, every: int = 1, idle_ms: int = IDLE_MS) -> DataFrame:
    """gate.replay's rows over a stream of frames (gate.FRAME); registered colours are joined before the state."""
    states(frames.sparkSession)
    return gate.listed(frames, registry).groupBy("session_id").transformWithStateInPandas(Gate(p, every, idle_ms), gate.OUT, "append", "ProcessingTime")


class Slot:
    """One request in flight and the newest sample that waits for it."""

    def __init__(self, busy: bool = False, pending: tuple[int, float] | None = None, last: float | None = None, interval: float = INTERVAL_MS):
        self.busy, self.pending, self.last, self.interval = busy, pending, last, interval

    def feed(self, seq: int, t: float | None, kind: str) -> tuple[int, float] | None:
        """The sample (seq, time) that this row sends, if any."""
        if kind == "done":
            if not self.busy:
                return None
            sent, self.pending = self.pending, None
            self.busy = sent is not None
            return sent
        if kind == "reset":
            self.busy, self.pending, self.last = False, None, None
            return None
        if t is None or self.last is not None and t - self.last < self.interval:
            return None
        self.last = t
        if self.busy:
            self.pending = (seq, t)
            return None
        self.busy = True
        return seq, t


class Sampler(StatefulProcessor):
    """The slot of a session, over offers, completions and resets as they come."""

    def __init__(self, interval: float = INTERVAL_MS):
        self.interval, self.kind = interval, T.StructType.fromDDL(SLOT)

    def init(self, handle) -> None:
        self.slot = handle.getValueState("slot", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        busy, seq, t, last = self.slot.get() if self.slot.exists() else (False, None, None, None)
        slot, out = Slot(busy, None if seq is None else (seq, t), last, self.interval), []
        for f in gate._plain(pd.concat(list(rows))):
            sent = slot.feed(int(f["seq"]), f["t_ms"], f["kind"])
            if sent:
                out.append((key[0], sent[0], int(f["seq"]), sent[1], f["t_ms"]))
        self.slot.update((slot.busy, *(slot.pending or (None, None)), slot.last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    def close(self) -> None:
        pass


def sampled_stream(offers: DataFrame, interval: float = INTERVAL_MS) -> DataFrame:
    """The samples that are sent, over a stream of OFFER rows of kind offer, done or reset."""
    states(offers.sparkSession)
    return offers.select(*[c.split()[0] for c in OFFER.split(", ")]).groupBy("session_id").transformWithStateInPandas(Sampler(interval), SENT, "append", "ProcessingTime")


def sampled(offers: DataFrame, interval: float = INTERVAL_MS) -> DataFrame:
    """The same in batch: sessions stream through one sorted pass, none is held."""

    def play(rows: Iterator[dict]) -> Iterator[tuple]:
        slot = Slot(interval=interval)
        for f in rows:
            sent = slot.feed(f["seq"], f["t_ms"], f["kind"])
            if sent:
                yield f["session_id"], sent[0], f["seq"], sent[1], f["t_ms"]

    return V.by_session(offers.select(*[c.split()[0] for c in OFFER.split(", ")]), "session_id", ["seq"], play, SENT)


def paced(reads: DataFrame, fps: float, max_lag_s: float, key: str = "session_id", order: str = "seq", elapsed: str = "elapsed_s", n_frames: str | None = None) -> DataFrame:
    """reads with `frame` (the source frame that each shows) and `skipped` (frames passed over since the last): at most max_lag_s behind its clock.

    A read takes the frame after the last one, or that of its elapsed time less the lag, if later. The i-th read so shows i + the largest lead
    over i of any read so far, a running maximum. Reads beyond `n_frames`, where given, have no frame and are left out.
    """
    w = W.partitionBy(key).orderBy(order)
    i = F.row_number().over(w) - 1
    lead = F.floor(F.greatest(F.lit(0.0), F.col(elapsed) - max_lag_s) * fps) - F.col("__i")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    led = reads.withColumn("__i", i).withColumn("__lead", lead)
    shown = led.withColumn("frame", (F.col("__i") + F.greatest(F.lit(0), F.max("__lead").over(upto))).cast("long"))
    out = shown.withColumn("skipped", F.col("frame") - F.coalesce(F.lag("frame").over(w), F.lit(-1)) - 1).drop("__i", "__lead")
    return out if n_frames is None else out.filter(F.col("frame") < F.col(n_frames))


def with_skipped(shown: DataFrame, *keep: str) -> DataFrame:
    """One row a source frame up to each read's: (keep, frame, displayed). What was passed over for display goes on as evidence."""
    frames = F.sequence(F.col("frame") - F.col("skipped"), F.col("frame"))
    return shown.select(*keep, F.col("frame").alias("__shown"), F.explode(frames).alias("frame")).select(*keep, "frame", (F.col("frame") == F.col("__shown")).alias("displayed"))
