"""Frames over HTTP as a stream: a Python data source whose offsets are places in the sender's log.

The sender keeps what it was given as a log of lines and answers two requests: GET {url}/offset gives {"end": n}, the lines so far, and GET
{url}/lines?start=a&end=b gives lines a to b - 1 as JSON strings, one a row. Spark plans a micro-batch as a range of offsets, writes it to the
checkpoint before it reads, and reads ranges of at most `lines` in tasks, so that a batch that is run again reads the same lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINES = "offset long, body string"


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _asked(url: str, timeout: float) -> bytes:
    with urlopen(url, timeout=timeout) as r:
        return r.read()


class LogReader(DataSourceStreamReader):
    def __init__(self, url: str, lines: int, timeout: float):
        self.url, self.lines, self.timeout = url.rstrip("/"), lines, timeout

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        return {"line": int(json.loads(_asked(f"{self.url}/offset", self.timeout))["end"])}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        lo, hi = start["line"], end["line"]
        return [Range(a, min(hi, a + self.lines)) for a in range(lo, hi, self.lines)]

    def read(self, part: Range) -> Iterator[tuple]:
        rows = _asked(f"{self.url}/lines?start={part.start}&end={part.end}", self.timeout).decode().split("\n")
        rows = [json.loads(r) for r in rows if r]
        if len(rows) != part.end - part.start:
            raise OSError(f"{len(rows)} of the lines {part.start} to {part.end} came")
        yield from zip(range(part.start, part.end), rows)


class FramesOverHttp(DataSource):
    """Options: url; lines (of a task, 10,000), timeout (seconds, 30)."""

    @classmethod
    def name(cls) -> str:
        return "frames_http"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> LogReader:
        if not self.options.get("url"):
            raise ValueError("frames_http needs the option url")
        return LogReader(self.options["url"], int(self.options.get("lines", 10_000)), float(self.options.get("timeout", 30)))


def frames(spark: SparkSession, url: str, **options: str):
    """(offset, body) of the sender's log, as a stream."""
    spark.dataSource.register(FramesOverHttp)
    return spark.readStream.format("frames_http").option("url", url).options(**options).load()
