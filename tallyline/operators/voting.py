"""Votes of bounded evidence windows on one plate for each session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import fsum

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tallyline.functions import text as X
from tallyline.operators import registry as R
from tallyline.params import DEFAULTS, LOCK_PLATE, NEUTRAL_COLORS, Params


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key. The limit is applied in each task before the shuffle, so no key brings more than n rows a task."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("__n") <= n).drop("__n")


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals, that seen first. Counts are summed before the shuffle."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("m")).select(*keys, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def majority(df: DataFrame, session: str = "session_id", plate: str = "plate_text", color: str = "color", order: str = "seq") -> DataFrame:
    """(session, plate, votes, n_frames, status): the most frequent raw text; NO_PLATE without any, UNCERTAIN if the top two tie; and the colour mode over all rows."""
    stripped = df.withColumn("__p", F.trim(F.coalesce(F.col(plate), F.lit(""))))
    counted = stripped.groupBy(session, "__p").agg(F.count("*").alias("n"))
    evidence = F.col("__p") != ""
    # of the most frequent texts the last and the first: they differ if the top ties, and no list of texts is kept
    tally = counted.groupBy(session).agg(
        F.sum("n").alias("n_frames"), F.max(F.when(evidence, F.struct("n", "__p"))).alias("last"), F.min(F.when(evidence, F.struct((-F.col("n")).alias("m"), "__p"))).alias("first")
    )
    status = F.when(F.col("last").isNull(), "NO_PLATE").when(F.col("last.__p") != F.col("first.__p"), "UNCERTAIN").otherwise("DECIDED")
    picked = tally.select(session, "n_frames", F.coalesce("last.n", F.lit(0)).alias("votes"), status.alias("status"), F.when(status == "DECIDED", F.col("last.__p")).otherwise("").alias("plate"))
    colors = first_seen_mode(df.filter(F.coalesce(F.trim(color), F.lit("")) != ""), [session], color, order).select(session, F.col(color).alias("color"))
    return picked.join(colors, session, "left").withColumn("color", F.coalesce("color", F.lit("")))


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion or replacement apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def eligible(text: str | None) -> str | None:
    import re

    norm = "".join(c for c in text or "" if c.isascii() and c.isalnum()).upper()
    return norm if re.match(LOCK_PLATE.replace(r"\z", r"\Z"), norm) else None


@dataclass
class Frame:
    """One row of evidence."""

    plate_text: str
    plate_conf: float | None
    color: str
    color_conf: float | None
    eligible: str | None = field(init=False)

    def __post_init__(self) -> None:
        self.eligible = eligible(self.plate_text)


def clusters(frames: list[Frame]) -> list[dict]:
    """Single-link clusters of plates at most one edit apart. Frames are grouped by plate in the order first seen, which decides ties of colours."""
    by: dict[str, list[Frame]] = {}
    for f in frames:
        by.setdefault(f.eligible or "", []).append(f)
    left, out = list(by), []
    while left:
        grown = [left.pop(0)]
        for v in grown:
            for w in [x for x in left if near(v, x)]:
                grown.append(w)
                left.remove(w)
        own = [v for v in by if v in grown]
        rows = [f for v in own for f in by[v]]

        def support(v: str, rows: list[Frame] = rows) -> tuple:
            return sum(near(v, f.eligible or "") for f in rows), fsum(f.plate_conf or 0.0 for f in by[v]), len(by[v]), v

        out.append({"variants": own, "frames": rows, "support": support, "representative": max(own, key=support), "counts": {v: len(by[v]) for v in own}, "conf": fsum(f.plate_conf or 0.0 for f in rows)})
    return out


@dataclass
class Decision:
    """What a window of evidence says; the verdict on a committed plate comes from the registry."""

    status: str
    plate: str = ""
    color: str = ""
    color_conf: float | None = None
    votes: dict[str, int] = field(default_factory=dict)


def decide(frames: list[Frame], known: set[str] | dict, soft: bool, p: Params = DEFAULTS) -> Decision:
    """NO_PLATE, UNCERTAIN, or COMMIT: hard clusters first, soft ones and then a single sure read only if `soft`. known: registered keys."""
    if not any((f.plate_text or "").strip() for f in frames):
        return Decision("NO_PLATE")
    fit = [f for f in frames if f.eligible]
    conf = lambda f: f.plate_conf or 0.0
    rank = lambda c: (len(c["frames"]), c["conf"], c["representative"])

    def chosen(c: dict) -> str:
        listed = [v for v in c["variants"] if v in known]
        return max(listed, key=c["support"]) if listed else c["representative"]

    def commit(plate: str, rows: list[Frame], c: dict) -> Decision:
        colors = [(f.color or "").strip().upper() for f in rows]
        counts: dict[str, int] = {}
        for x in colors:
            if x:
                counts[x] = counts.get(x, 0) + 1
        top = max(counts, key=lambda k: counts[k]) if counts else ""
        own = [f.color_conf or 0.0 for f, x in zip(rows, colors) if x == top]  # a colour without a confidence is unsure
        return Decision("COMMIT", plate, top, fsum(own) / len(own) if own else 0.0, c["counts"])

    for least in [p.lock_conf, *([p.soft_conf] if soft else [])]:
        good = [c for c in clusters([f for f in fit if conf(f) >= least]) if len(c["frames"]) >= p.lock_repeat]
        if good:
            best = max(good, key=rank)
            return commit(chosen(best), best["frames"], best)
    if soft:
        good = clusters([f for f in fit if conf(f) >= p.single_lock_conf])
        if good:
            best = max(good, key=lambda c: (max(conf(f) for f in c["frames"]), c["conf"], c["representative"]))
            plate = chosen(best)
            return commit(plate, [f for f in best["frames"] if f.eligible == plate] or best["frames"], best)
    return Decision("UNCERTAIN", votes={c["representative"]: len(c["frames"]) for c in clusters([f for f in fit if conf(f) >= p.soft_conf])})


def judged(plate: str, color: str, conf: float | None, known: dict[str, str], p: Params = DEFAULTS) -> tuple[str, str, bool]:
    """(status, action, color_warning) of a plate against {key: colour}."""
    if plate not in known:
        return "UNREGISTERED", "DENY_ALERT", False
    have, want = color.strip().upper(), known[plate]
    if have == want or (have in NEUTRAL_COLORS and want in NEUTRAL_COLORS) or (conf is not None and conf < p.color_warn_conf):
        return "AUTHORIZED", "ALLOW", False
    return "AUTHORIZED", "ALLOW_WARN", True


VOTE = "session_id string, plate string, color string, color_conf double, outcome string, votes map<string,int>, n_frames int"


def by_session(df: DataFrame, key: str, order: list[str], play: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, most: int = 4096) -> DataFrame:
    """Rows of play(rows of a session, in order), session by session as they come from a sorted partition: none is held whole."""
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = (r for b in batches for r in b.to_pylist()), []
        for _, own in groupby(rows, key=lambda r: r[key]):
            for out in play(own):
                held.append(out)
                if len(held) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def lock_aware(df: DataFrame, registry: DataFrame, soft: bool = True, p: Params = DEFAULTS) -> DataFrame:
    """One row for each session: the decision over its last max_collect_frames rows, and the verdict on a committed plate.

    df: session_id, seq, plate_text, plate_conf, color, color_conf. At most so many rows of a session meet in a task. Registered
    variants are marked by a join beforehand, so that no task needs the registry.
    """
    recent = last_rows(df, "session_id", "seq", p.max_collect_frames)
    keys = registry.select(X.registry_key(F.col("license_plate")).alias("__key")).distinct().withColumn("listed", F.lit(True))
    marked = recent.withColumn("__key", X.lock_plate(F.col("plate_text"))).join(keys, "__key", "left")

    def vote(rows: Iterator[dict]) -> Iterator[tuple]:
        rows = list(rows)
        frames = [Frame(r["plate_text"] or "", r["plate_conf"], r["color"] or "", r["color_conf"]) for r in rows]
        d = decide(frames, {f.eligible for f, r in zip(frames, rows) if r["listed"]}, soft, p)
        yield rows[0]["session_id"], d.plate, d.color, d.color_conf, d.status, list(d.votes.items()), len(frames)

    used = marked.select(F.col("session_id").cast("string").alias("session_id"), "seq", "plate_text", F.col("plate_conf").cast("double").alias("plate_conf"), "color", F.col("color_conf").cast("double").alias("color_conf"), "listed")
    voted = by_session(used, "session_id", ["seq"], vote, VOTE)
    checked = R.verify(voted, registry, p, plate="plate")
    out = F.col("outcome") == "COMMIT"
    return checked.select(
        "session_id", "plate", "color", "n_frames", "votes",
        F.when(out, F.col("status")).otherwise(F.col("outcome")).alias("status"), F.when(out, F.col("action")).otherwise("LOG").alias("action"), (out & F.col("color_warning")).alias("color_warning"),
    )


def legacy(df: DataFrame, registry: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The majority vote of each session, and the verdict on a plate that it decides; there is no confidence of colours to doubt."""
    voted = majority(df).withColumn("color_conf", F.lit(None).cast("double")).withColumnRenamed("status", "outcome")
    checked = R.verify(voted, registry, p, plate="plate")
    out = F.col("outcome") == "DECIDED"
    return checked.select(
        F.col("session_id").cast("string").alias("session_id"), "plate", "color", F.col("n_frames").cast("int").alias("n_frames"),
        F.when(out, F.col("status")).otherwise(F.col("outcome")).alias("status"), F.when(out, F.col("action")).otherwise("LOG").alias("action"), (out & F.col("color_warning")).alias("color_warning"),
    )


def aggregate(df: DataFrame, registry: DataFrame, soft: bool = True, p: Params = DEFAULTS) -> DataFrame:
    """One row for each session: the lock-aware vote where any of its rows has a plate_conf, else the majority vote."""
    given = df.groupBy("session_id").agg((F.count("plate_conf") > 0).alias("__given"))
    marked = df.join(given.withColumnRenamed("session_id", "__session"), F.col("session_id").eqNullSafe(F.col("__session"))).drop("__session")
    locked = lock_aware(marked.filter("__given").drop("__given"), registry, soft, p).drop("votes")
    return locked.unionByName(legacy(marked.filter("not __given").drop("__given"), registry, p))
