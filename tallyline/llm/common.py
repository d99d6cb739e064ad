"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.tables import written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def hash_share(df: DataFrame, address: str, most: int) -> DataFrame:
    """About `most` rows of df with different addresses, all if it has no more: those whose address lies in the share of the range that gives so many.

    `address` is a column of 64-bit hashes of what tells rows apart, such as id and text, so that neither null nor repeated ids come in or stay out
    together, and repeated rows count once. What is chosen depends on the rows alone. Only an estimate of a count comes to the driver, and of a larger
    table only the chosen rows are moved.
    """
    n = df.agg(F.approx_count_distinct(address, 0.02)).first()[0]
    if n > most:
        df = df.filter(F.pmod(F.col(address), F.lit(1 << 31)) < int(most / n * (1 << 31)))
    return df.dropDuplicates([address])


def batches_of(batches: Iterator[pa.RecordBatch], mb: float = 4.0, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `mb` MB, or one row where a single text is longer."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.cumsum(pc.binary_length(b.column(b.schema.names.index(column))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + mb * 1e6, "right")))
            yield b.slice(at, to - at)
            at = to
        del b
        released()


def released() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers stay for later stages, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


class Recent:
    """A table of what was asked for last: two parts of at most `most`; the older one is let go when the newer is full."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


def clash_free(names: list[str], wanted: str) -> str:
    """`wanted`, with underscores put before it until no input column has that name (case aside)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
