"""From raw lines to frames: what can't be read is set aside with a reason, and both tables are written once a batch.

Defined cases: a line that is no JSON object, one without a usable session id or time, and one with a field of another type are bad;
a null or absent field else is null; target defaults to false, kind to `frame` and generation to 0; a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.params import SESSION_ID
from tallyline.streaming import gate

_BROKEN = "__broken"


def judged(raw: DataFrame, body: str = "body") -> DataFrame:
    """raw with the columns of gate.FRAME and `reason`: null, or why the line is set aside."""
    schema = f"{gate.FRAME}, {_BROKEN} string"
    read = raw.withColumn("__f", F.from_json(F.col(body), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
    f = lambda c: F.col(f"__f.{c}")
    time = f("source_time_s")
    good_time = F.coalesce(~F.isnan(time) & (F.abs(time) < float("inf")) & (time >= 0), F.lit(False))
    reason = (
        F.when(F.col(body).isNull() | F.col("__f").isNull() | f(_BROKEN).isNotNull(), "not a frame")
        .when(~F.coalesce(f("session_id").rlike(SESSION_ID), F.lit(False)), "bad session id")
        .when(~good_time, "bad source time")
        .when(f("seq").isNull(), "no sequence number")
    )
    given = {"target": F.lit(False), "kind": F.lit("frame"), "generation": F.lit(0)}
    names = [c.split()[0] for c in gate.FRAME.split(", ")]
    cols = [F.coalesce(f(n), given[n]).alias(n) if n in given else f(n).alias(n) for n in names]
    return read.withColumn("reason", reason).select(*raw.columns, *cols, "reason")


def store(raw: DataFrame, frames: str, aside: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes good lines to `frames` and others to the quarantine `aside`, a folder batch=N each.

    A batch's folders are overwritten, so that a batch that Spark runs again after a failure leaves each line once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = judged(batch).persist()
        try:
            rows.filter("reason is null").drop("reason", "body").write.mode("overwrite").parquet(f"{frames}/batch={number}")
            rows.filter("reason is not null").select("offset", "body", "reason").write.mode("overwrite").parquet(f"{aside}/batch={number}")
        finally:
            rows.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What store() has written to one of its folders."""
    return spark.read.option("basePath", path).parquet(path)
