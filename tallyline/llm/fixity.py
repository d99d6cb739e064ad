"""WARC records, and a Merkle audit of their replicas.

A record is hashed with its bytes; FANOUT consecutive records make an offset range, whose hash covers its children's hashes and
lengths, and so on up to one root a file. Two replicas are compared from their roots down: at each level only the children of
nodes that differ are joined, so that an intact file costs one comparison and a damaged record FANOUT at each level.

A record's place in the tree is its position in the manifest of the file; a record that a replica lacks leaves its place empty.
Hashes cover lengths, not absolute offsets, so that a record of another length changes no other branch.

Files of single records that are gzipped each, as crawls come, are read too; offsets and lengths are then those of the gzip members.

Defined cases: a null url or body is empty; records of one page are kept in the order of url and digest; a null page_id is in
one of files -1 to -NULL_FILES, by its url and digest; other columns of pages are not carried; records that both replicas lack don't exist; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.common import table, written

FANOUT, PER_FILE, NULL_FILES = 16, 512, 4096


def record_text(url: Column, body: Column) -> Column:
    """A WARC/1.1 response record: headers, an empty line, the body and two line ends."""
    body = F.coalesce(body, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def parse_records(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of a file without compression. Raises ValueError where a record is torn."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        size = headers.get("content-length", "")
        stop = end + 4 + (int(size) if re.fullmatch(r"\d+", size) else -1)
        if not size or raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is torn")
        yield at, stop + 4 - at, headers, raw[end + 4 : stop]
        at = stop + 4


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file. Raises ValueError where one is torn."""
    at, step = 0, 1 << 16
    while at < len(raw):
        d, parts, to = zlib.decompressobj(31), [], at
        try:
            while not d.eof and to < len(raw):
                parts.append(d.decompress(raw[to : to + step]))
                to += step
        except zlib.error as e:
            raise ValueError(f"no gzip member at byte {at}") from e
        if not d.eof:
            raise ValueError(f"the gzip member at byte {at} is torn")
        size = min(to, len(raw)) - at - len(d.unused_data)
        yield at, size, b"".join(parts)
        at += size


def stored_records(raw: bytes) -> Iterator[tuple[int, int, bytes, dict[str, str], bytes]]:
    """(offset, length, record, headers, body) of a file, plain or with a gzip member a record; offsets and lengths are as stored."""
    if not raw.startswith(b"\x1f\x8b"):
        for at, size, headers, body in parse_records(raw):
            yield at, size, raw[at : at + size], headers, body
        return
    for at, size, whole in members(raw):
        for _, _, headers, body in parse_records(whole):
            yield at, size, whole, headers, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, offset, length, digest, url, body) of the records of all files under path; a task reads a file at a time."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                whole = raw.as_py()
                got = [(name, i, o, n, hashlib.sha256(record).hexdigest(), h.get("warc-target-uri"), body) for i, (o, n, record, h, body) in enumerate(stored_records(whole))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], names=["file", "position", "offset", "length", "digest", "url", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, position long, offset long, length long, digest string, url string, body binary")


def manifest(records: DataFrame, file: str, order: list[str]) -> DataFrame:
    """records (with digest, length) and position and offset in their files."""
    in_file = W.partitionBy(file).orderBy(*order)
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("position", (F.row_number().over(in_file) - 1).cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of all files, records first: (file, node, length, hash). The last has one node a file."""
    level = written(records.select("file", F.col("position").alias("node"), "length", F.col("digest").alias("hash")), "leaves")
    out = [level]
    while out[-1].filter("node > 0").take(1):
        up = (
            out[-1]
            .groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent"))
            .agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("node", F.col("length").alias("n"), "hash"))).alias("c"))
        )
        own = F.array_join(F.transform("c", lambda x: F.concat_ws(":", (x["node"] % fanout).cast("string"), x["n"].cast("string"), x["hash"])), ",")
        out.append(written(up.select("file", F.col("parent").alias("node"), "length", F.sha2(own.cast("binary"), 256).alias("hash")), "level"))
    return out


def audit(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, position, status) of the records that differ: `changed`, `missing` (from two) or `extra` (only in two)."""
    top = max(len(one), len(two))
    suspects = None
    for level in range(top - 1, -1, -1):
        a, b = (x[min(level, len(x) - 1)] if level < len(x) else _raised(x, level) for x in (one, two))
        a, b = (x.select("file", "node", F.struct("length", "hash").alias(n)) for x, n in ((a, "a"), (b, "b")))
        if suspects is not None:
            down = suspects.select("file", F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(down, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        suspects = written(a.join(b, ["file", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))), "suspects")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return suspects.select("file", F.col("node").alias("position"), status.alias("status"))


def _raised(levels: list[DataFrame], level: int) -> DataFrame:
    """The roots of a lower tree, hashed up to the level of a higher one so that heights match."""
    out = levels[-1]
    for _ in range(level - len(levels) + 1):
        own = F.concat_ws(":", F.lit("0"), F.col("length").cast("string"), F.col("hash"))
        out = out.select("file", "node", "length", F.sha2(own.cast("binary"), 256).alias("hash"))
    return out


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, file, length, digest, order columns) of each page as a record; PER_FILE page ids share a file."""
    text = record_text(F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"))
    file = F.coalesce(F.floor(F.col("page_id") / PER_FILE), -1 - F.pmod(F.xxhash64("url", "digest"), F.lit(NULL_FILES))).cast("long")
    return rows.select("page_id", file.alias("file"), "url", "length", "digest")


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records, against a replica with known damage: page ids 5 mod 97 have a byte replaced, 7 mod 193 are lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    listed = written(manifest(page_records(pages), "file", ["page_id", "url", "digest"]), "manifest")
    torn = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html"))
    other = pages.filter("page_id is null or page_id % 193 <> 7").withColumn("html", torn)
    # the replica's records stand where the manifest has them
    place = listed.select("page_id", "file", "url", "position", F.row_number().over(W.partitionBy("page_id", "url").orderBy("position")).alias("k"))
    copy = page_records(other).withColumn("k", F.row_number().over(W.partitionBy("page_id", "url").orderBy("digest")))
    on = [copy["page_id"].eqNullSafe(place["page_id"]), copy["url"] == place["url"], copy["k"] == place["k"]]
    replica = copy.join(place, on).select(place["file"], "position", "length", "digest")
    found = audit(tree(listed), tree(replica))
    return listed.join(found, ["file", "position"], "left").select("page_id", "file", "position", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
OP6_SQL = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, CAST(coalesce(page_id // {PER_FILE}, -1) AS BIGINT) AS file, html, {_RECORD} AS rec FROM pages
), d AS (SELECT page_id, url, file, html, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM r)
SELECT page_id, file, row_number() OVER w - 1 AS position, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
       length, digest,
       CASE WHEN page_id % 193 = 7 THEN 'missing' WHEN page_id % 97 = 5 AND NOT starts_with(coalesce(html, ''), '#') THEN 'changed' ELSE 'ok' END AS status
FROM d WINDOW w AS (PARTITION BY file ORDER BY page_id, url, digest)
"""
