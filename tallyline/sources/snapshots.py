"""Versioned tables in a folder: data first, then one rename that makes it the next version.

`data/` holds a folder of files for each attempt, `versions/` a small file for each version, which names one of them. A version's file is written
aside and renamed to its number, which the file system refuses where that number is taken. So a reader sees one whole version, a writer that dies
leaves at most files that nobody reads, and of two writers that began at one version the second gets a Conflict.

Defined cases: a folder that isn't there is version 0, without data; vacuum keeps the newest versions and what they name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one began at."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    folder = at(f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if re.fullmatch(r"\d{12}", n))


def data_of(spark: SparkSession, path: str, version: int) -> str:
    """The folder with a version's data."""
    fs, at = _fs(spark, path)
    stream = fs.open(at(f"{path}/versions/{version:012d}"))
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}/data/{name}"


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(version, folder with its data): (0, None) before the first commit."""
    found = versions(spark, path)
    return (found[-1], data_of(spark, path, found[-1])) if found else (0, None)


def _written(df: DataFrame, folder: str, write: Callable[[DataFrame, str], None]) -> None:
    write(df, folder)


def _named(spark: SparkSession, path: str, name: str) -> str:
    """A file with the name of the data folder, beside the versions."""
    fs, at = _fs(spark, path)
    aside = f"{path}/versions/_{name}"
    stream = fs.create(at(aside), False)
    try:
        stream.write(name.encode())
    finally:
        stream.close()
    return aside


def _published(spark: SparkSession, aside: str, path: str, version: int) -> None:
    """The rename, refused where the version exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at = jvm.org.apache.hadoop.fs.Path
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(at(aside), at(f"{path}/versions/{version:012d}"), how)
    except Exception as e:
        if version in versions(spark, path):
            _fs(spark, path)[0].delete(at(aside), False)
            raise Conflict(f"{path}: version {version} is there already") from e
        raise


def commit(df: DataFrame, path: str, base: int, write: Callable[[DataFrame, str], None]) -> int:
    """Makes df version base + 1 of `path` and gives its number; write(df, folder) writes it. Conflict if there is such a version already."""
    spark, name = df.sparkSession, uuid4().hex
    _written(df, f"{path}/data/{name}", write)
    _published(spark, _named(spark, path, name), path, base + 1)
    return base + 1


def change(spark: SparkSession, path: str, read: Callable[[str | None], DataFrame], f: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], None], tries: int = 5) -> int:
    """Commits f(read(data)) on the newest version, and again on a newer one while others come first."""
    for left in reversed(range(tries)):
        base, data = current(spark, path)
        try:
            return commit(f(read(data)), path, base, write)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all versions but the newest `keep`, and data that none of these names; the number of data folders that go. Not beside a writer."""
    fs, at = _fs(spark, path)
    found = versions(spark, path)
    live = {data_of(spark, path, v).rsplit("/", 1)[1] for v in found[-keep:]}
    for v in found[:-keep]:
        fs.delete(at(f"{path}/versions/{v:012d}"), False)
    gone = [s.getPath() for s in fs.listStatus(at(f"{path}/data")) if s.getPath().getName() not in live] if found else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
