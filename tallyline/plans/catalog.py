"""Registered queries over the shared test tables, each with the SQL that gives the same rows.

Every query reads whole tables. Counts are BIGINT on both sides; doubles are single divisions, or extremes, that both engines
compute alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.functions import decode as D
from tallyline.functions import geometry as G
from tallyline.functions import text as X
from tallyline.operators import chains as H
from tallyline.operators import curate as C
from tallyline.operators import evaluate as E
from tallyline.operators import fuzzy as Z
from tallyline.operators import hamming as B
from tallyline.operators import manifest as M
from tallyline.operators import ordered as O
from tallyline.operators import registry as R
from tallyline.operators import voting as V
from tallyline.params import BANDS, DEFAULTS
from tallyline.plans import inputs as I
from tallyline.plans.inputs import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# registry


@query(f"SELECT event_id, status, action, action = 'ALLOW_WARN' AS color_warning FROM ({I.VERIFIED})")
def verify_registry(spark, d):
    return R.verify(I.readings(spark, d), I.registry(spark, d)).select("event_id", "status", "action", "color_warning")


@query(f"""
SELECT event_id, CASE WHEN status = 'UNREGISTERED' THEN 'Plate ' || plate_text || ' is not registered in the system.'
  WHEN upper(color) = registered OR (upper(color) IN {I.NEUTRAL} AND registered IN {I.NEUTRAL}) THEN 'Vehicle ' || plate_text || ' authorized: plate and colour match.'
  WHEN action = 'ALLOW' THEN 'Vehicle ' || plate_text || ' authorized by plate; colour differs (detected ' || color || ', registered ' || registered || ') but colour confidence (' || printf('%.2f', color_conf) || ') is below the warning threshold (0.40), so not flagged.'
  ELSE 'Vehicle ' || plate_text || ' authorized by plate; colour differs (detected ' || color || ', registered ' || registered || ').' END AS message
FROM ({I.VERIFIED})""")
def verify_messages(spark, d):
    return R.verify(I.readings(spark, d), I.registry(spark, d)).select("event_id", "message")


@query(f"SELECT event_id FROM ({I.VERIFIED}) WHERE status = 'AUTHORIZED'")
def is_registered_semi(spark, d):
    return R.registered(I.readings(spark, d), I.registry(spark, d)).select("event_id")


@query(f"SELECT event_id FROM ({I.VERIFIED}) WHERE status = 'UNREGISTERED'")
def unregistered_anti(spark, d):
    return R.registered(I.readings(spark, d), I.registry(spark, d), inside=False).select("event_id")


@query("SELECT n_name AS license_plate, CAST(min(n_nationkey) AS BIGINT) AS row_ord FROM nation GROUP BY n_name")
def first_match_dedup(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("license_plate"), F.col("n_nationkey").cast("long").alias("row_ord"))
    return R.first_by_key(rows.union(rows.withColumn("row_ord", F.col("row_ord") + 100)), "license_plate", "row_ord").select("license_plate", "row_ord")


@query("""
SELECT cast(c_custkey AS VARCHAR) AS license_plate, c_custkey AS row_ord FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT cast(s_suppkey AS VARCHAR), s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 3 = 0""")
def registry_upsert(spark, d):
    have = I.registry(spark, d).select("license_plate", "row_ord")
    new = table(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" ")).alias("license_plate"), (F.col("s_suppkey") + 1000000).alias("row_ord"))
    return R.add(have, new)[0]


@query("SELECT cast(c_custkey AS VARCHAR) AS license_plate FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey <> 7")
def registry_delete(spark, d):
    return R.delete(I.registry(spark, d), " 7.")[0].select("license_plate")


# texts


@query(r"""
SELECT c_custkey AS id, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS plate_key, upper(regexp_replace(c_name, '[\s\-.]', '', 'g')) AS registry_key,
  upper(translate(c_name, ' -.', '')) AS detected_key, regexp_replace(upper(c_name), '[\s\-.]', '', 'g') AS ocr_key, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS upper_first, upper(trim(c_mktsegment)) AS color_key
FROM customer""")
def normalize_text_key(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), X.plate_text(n).alias("plate_key"), X.registry_key(n).alias("registry_key"), X.detected_key(n).alias("detected_key"),
        X.ocr_key(n).alias("ocr_key"), X.plate_text_upper_first(n).alias("upper_first"), X.color_key(F.col("c_mktsegment")).alias("color_key"),
    )


@query(rf"""
SELECT seq, regexp_full_match(plate_text, '[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4,6}}') AS raw_valid, regexp_full_match(n, '[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4,6}}') AS norm_valid,
  CASE WHEN regexp_full_match(n, '[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{5,6}}') THEN n END AS lock_plate
FROM (SELECT *, upper(regexp_replace(plate_text, '[^A-Za-z0-9]', '', 'g')) AS n FROM ({I.PLATES}))""")
def format_validate(spark, d):
    p = F.col("plate_text")
    return I.plates(spark, d).select("seq", X.is_plate(p).alias("raw_valid"), X.is_plate(X.plate_text(p)).alias("norm_valid"), X.lock_plate(p).alias("lock_plate"))


@query("""
SELECT p_partkey AS id, 'source:' || substr(sha256(split_part(p_name || '.rf.' || p_brand, '.rf.', 1)), 1, 16) AS source_group,
  'crop_' || substr(sha256(p_name), 1, 16) || '_' || substr(sha256(p_brand), 1, 12) || '_' || printf('%02d', p_size) || '.jpg' AS crop_name,
  'demo-' || substr(sha256(p_brand || ':' || p_name), 1, 32) AS session_id, 'demo-view-' || substr(sha256(p_name), 1, 16) || '-' || p_type AS component_key
FROM part""")
def identity_hash(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), X.source_group(F.concat(n, F.lit(".rf."), b)).alias("source_group"), X.crop_name("crop", F.sha2(n.cast("binary"), 256), b, F.col("p_size")).alias("crop_name"),
        X.demo_session_id(n, b).alias("session_id"), X.demo_component_key(n, F.col("p_type")).alias("component_key"),
    )


@query(rf"""
SELECT seq, CASE WHEN regexp_full_match(n, '[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4,6}}') THEN 'vehicle:' || substr(sha256(n), 1, 16) END AS identity
FROM (SELECT seq, upper(regexp_replace(plate_text, '[^A-Za-z0-9]', '', 'g')) AS n FROM ({I.PLATES}))""")
def plate_identity(spark, d):
    return I.plates(spark, d).select("seq", X.identity_group(F.col("plate_text")).alias("identity"))


_BAND = "CASE WHEN c >= 1 THEN '1.0' ELSE printf('%.1f-%.1f', floor(c * 10) / 10.0, (floor(c * 10) + 1) / 10.0) END"
_BANDS = "(SELECT unnest([" + ", ".join(f"'{b}'" for b in BANDS) + "]) AS band)"


@query(f"""
WITH e AS (SELECT {_BAND} AS band, user_id FROM (SELECT user_id, least(CAST(1 AS DOUBLE), CAST(event_id % 128 AS DOUBLE) / 120) AS c FROM events))
SELECT b.band, count(e.band) AS n, count(e.band) / CAST((SELECT count(*) FROM e) AS DOUBLE) AS share, count(DISTINCT user_id) AS labels FROM {_BANDS} b LEFT JOIN e ON e.band = b.band GROUP BY b.band""")
def confidence_band_hist(spark, d):
    rows = table(spark, d, "events").select("user_id", X.confidence_band(F.least(F.lit(1.0), (F.col("event_id") % 128).cast("double") / 120)).alias("band"))
    return E.band_counts(rows, "band", "user_id")


@query("""
SELECT p_partkey AS id, CASE WHEN contains(t, 'white') THEN 'White' WHEN contains(t, 'black') THEN 'Black' WHEN contains(t, 'grey') OR contains(t, 'gray') OR contains(t, 'nardo') OR contains(t, 'gry') THEN 'Grey'
  WHEN contains(t, 'silver') THEN 'Silver' WHEN contains(t, 'red') THEN 'Red' WHEN contains(t, 'blue') THEN 'Blue' WHEN contains(t, 'brown') OR contains(t, 'bronze') THEN 'Brown' WHEN contains(t, 'yellow') OR contains(t, 'gold') THEN 'Yellow' END AS color,
  CASE WHEN starts_with(lower(p_brand), 'brand#1') THEN 'Brand#1' WHEN starts_with(lower(p_brand), 'brand#2') THEN 'Brand#2' END AS brand,
  CASE lower(p_type) WHEN 'small' THEN 'Compact' WHEN 'large' THEN 'Truck' ELSE 'ignored' END AS body
FROM (SELECT *, lower(p_name) AS t FROM part)""")
def color_case_map(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), X.color_of(F.col("p_name")).alias("color"), X.brand_of(F.col("p_brand"), ["Brand#1", "Brand#2"]).alias("brand"), X.mapped(F.col("p_type"), {"small": "Compact", "large": "Truck"}, "ignored").alias("body")
    )


@query("SELECT p_partkey AS id FROM part WHERE p_brand GLOB 'Brand#1*' OR p_name GLOB 's* r?ng'")
def glob_exclude(spark, d):
    n = X.glob_any(F.col("p_brand"), ["Brand#1*"]) | X.glob_any(F.col("p_name"), ["s* r?ng"])
    return table(spark, d, "part").filter(n).select(F.col("p_partkey").alias("id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS back FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 0 AND value >= 0")
def json_props(spark, d):
    j = F.from_json("props", "k double")
    ok = j["k"].isNotNull() & ~F.isnan(j["k"]) & (F.abs(j["k"]) < float("inf")) & (j["k"] >= 0) & (F.col("value") >= 0)
    k = j["k"].cast("long")
    return table(spark, d, "events").filter(ok).select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("back"))


_BODY = """concat('{{"event_id":"', CASE WHEN event_id % 11 = 3 THEN ' ' ELSE concat('e', cast(event_id as {s})) END, '","source_time_s":', CASE event_id % 7 WHEN 0 THEN '-1' WHEN 1 THEN '"1"' WHEN 2 THEN 'true' ELSE cast(event_id as {s}) END,
  ',"playback_time_s":2.5,"is_playing":', CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '1' END, CASE WHEN event_id % 13 = 0 THEN '' ELSE ',"decision":{{"status":"AUTHORIZED"}}' END, ',"latency_ms":', CASE WHEN event_id % 2 = 0 THEN '"x"' ELSE '12.5' END, CASE WHEN event_id % 17 = 0 THEN '' ELSE '}}' END)"""


@query(f"""
WITH b AS (SELECT event_id AS id, {_BODY.format(s="VARCHAR")} AS b FROM events), j AS (SELECT id, CAST(b AS JSON) AS j FROM b WHERE json_valid(b))
SELECT id, json_extract_string(j, '$.event_id') AS event_id, CAST(j->'$.source_time_s' AS DOUBLE) AS source_time_s, CAST(j->'$.playback_time_s' AS DOUBLE) AS playback_time_s, CAST(j->'$.is_playing' AS BOOLEAN) AS is_playing, json_extract_string(j, '$.decision.status') AS status,
  CASE WHEN json_type(j, '$.latency_ms') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(j->'$.latency_ms' AS DOUBLE) END AS latency_ms
FROM j WHERE trim(json_extract_string(j, '$.event_id')) <> '' AND json_type(j, '$.source_time_s') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND json_type(j, '$.is_playing') = 'BOOLEAN' AND json_extract_string(j, '$.decision.status') <> ''
  AND CASE WHEN json_type(j, '$.source_time_s') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(j->'$.source_time_s' AS DOUBLE) >= 0 ELSE false END""")
def event_rows(spark, d):
    """Posted events that are rows, of those with faults of each kind."""
    from tallyline.streaming import gate

    bodies = table(spark, d, "events").selectExpr("event_id AS id", f"{_BODY.format(s='string')} AS b")
    return bodies.select("id", gate.event_row(F.col("b")).alias("r")).filter("r is not null").select("id", "r.*")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unavailable' WHEN doc_id % 7 = 1 THEN 'mismatch' ELSE 'verified' END AS provenance FROM documents WHERE text IS NOT NULL")
def provenance_check(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("image_path"), F.col("text").cast("binary").alias("content"))
    sha = F.sha2("content", 256)
    rows = docs.select("doc_id", "image_path", F.when(F.col("doc_id") % 7 == 1, F.reverse(sha)).otherwise(F.upper(sha)).alias("source_sha256"))
    return M.provenance(rows, docs.filter("doc_id % 5 <> 0").select("image_path", "content")).select("doc_id", "provenance")


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '—' WHEN event_id % 4 = 1 THEN plate_text ELSE registered_plate END AS plate_shown, round(color_conf * 100, 2) AS color_percent, status = 'UNREGISTERED' OR action = 'ALLOW_WARN' AS alert FROM (SELECT *, replace(plate_text, '-', '') AS registered_plate FROM ({I.VERIFIED}))")
def display_cards(spark, d):
    from tallyline.operators import frames

    rows = R.verify(I.readings(spark, d), I.registry(spark, d))
    named = rows.withColumn("plate", F.when(F.col("event_id") % 4 > 1, F.replace("plate_text", F.lit("-"), F.lit(""))).when(F.col("event_id") % 2 == 0, "")).withColumn("plate_text", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("plate_text")))
    return frames.card(named).select("event_id", "plate_shown", "color_percent", "alert")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN b - a >= 2 THEN a ELSE 0 END AS top, CASE WHEN b - a >= 2 THEN b ELSE h END AS bottom, w >= 2 AND h >= 2 AS usable, printf('0 %.6f %.6f %.6f %.6f', (x + w / 2) / 64, (y + h / 2) / 32, w / CAST(64 AS DOUBLE), h / CAST(32 AS DOUBLE)) AS line, CASE WHEN x2 > x1 THEN x2 - x1 END AS pixels
FROM (SELECT *, CAST(trunc(h * CAST(0.2 AS DOUBLE)) AS INTEGER) AS a, CAST(trunc(h * CAST(0.85 AS DOUBLE)) AS INTEGER) AS b, CAST(least(640, greatest(0, round_even(x / 4, 0))) AS INTEGER) AS x1, CAST(least(640, greatest(0, round_even((x + w) / 4, 0))) AS INTEGER) AS x2 FROM (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 512 AS DOUBLE) AS x, CAST(l_suppkey % 256 AS DOUBLE) AS y, 2 * (CAST(l_quantity AS INTEGER) % 3) AS w, CAST(2 * (l_partkey % 45) AS INTEGER) AS h FROM lineitem))""")
def crop_forms(spark, d):
    """Body bands, usable crops, label lines and pixels of boxes."""
    from tallyline.operators import frames

    r = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 512D AS x", "l_suppkey % 256D AS y", "2 * (cast(l_quantity as int) % 3) AS w", "cast(2 * (l_partkey % 45) as int) AS h")
    x, y, w, h = (F.col(c) for c in "xywh")
    p = G.pixel_box(x / 4, F.lit(0.0), (x + w) / 4, F.lit(9.0), F.lit(640), F.lit(480))
    band = G.body_band(h)
    return r.select("l_orderkey", "l_linenumber", band["top"].alias("top"), band["bottom"].alias("bottom"), frames.usable(w, h).alias("usable"), G.coco_to_yolo(x, y, w, h, F.lit(64), F.lit(32)).alias("line"), (p["x2"] - p["x1"]).alias("pixels"))


@query("SELECT frame_idx, bbox FROM (SELECT l_orderkey AS frame_idx, l_partkey AS bbox, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS n FROM lineitem WHERE l_orderkey % 3 = 0) WHERE n = 1 UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 5 = 0")
def frame_candidates(spark, d):
    """The surest box of every third frame, and the annotated boxes of every fifth."""
    from tallyline.operators import frames

    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_idx"))
    lines = table(spark, d, "lineitem")
    boxes = lines.select(F.col("l_orderkey").alias("frame_idx"), F.col("l_quantity").alias("conf"), F.col("l_partkey").alias("bbox"))
    return frames.candidates(f, boxes, 3).union(frames.candidates(f, boxes, 5, lines.select(F.col("l_orderkey").alias("frame_idx"), F.col("l_suppkey").alias("bbox"))))


@query(r"SELECT session_id, seq FROM (SELECT session_id, seq, (event_id % 7) - 1.0 AS t FROM (" + I.READINGS + r")) WHERE regexp_full_match(session_id, '[A-Za-z0-9_-]{8,64}') AND t >= 0")
def valid_frames(spark, d):
    from tallyline.streaming.gate import valid

    rows = I.readings(spark, d).withColumn("source_time_s", (F.col("event_id") % 7) - 1.0)
    return valid(rows)[0].select("session_id", "seq")


# boxes

_BOX = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS x1, CAST(l_linenumber * 10 AS INTEGER) AS y1, CAST(l_quantity * 9 AS INTEGER) AS x2, CAST(l_linenumber * 10 + l_suppkey % 400 AS INTEGER) AS y2, CAST(l_partkey % 9 AS INTEGER) AS cls FROM lineitem"


def _boxes(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "int(l_quantity) x1", "int(l_linenumber * 10) y1", "int(l_quantity * 9) x2", "int(l_linenumber * 10 + l_suppkey % 400) y2", "int(l_partkey % 9) cls")
    w, h = F.lit(640), F.lit(480)
    b = G.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    c = G.center(b, w, h)
    return rows.withColumn("area", G.area_ratio(b, w, h)).withColumn("inside", G.in_region(c["x"], c["y"], DEFAULTS.roi))


_AREA = "(greatest(0, x2 - x1) * greatest(0, y2 - y1)) / CAST(640 * 480 AS DOUBLE)"
_INSIDE = "(x1 + x2) / CAST(2 AS DOUBLE) / 640 BETWEEN 0.2 AND 0.8 AND (y1 + y2) / CAST(2 AS DOUBLE) / 480 BETWEEN 0.2 AND 1.0"


@query(f"SELECT l_orderkey, l_linenumber, x1, y1, x2, y2, {_AREA} AS area FROM ({_BOX}) WHERE {_INSIDE} AND {_AREA} >= 0.1 AND cls IN (2, 5, 7)")
def roi_filter(spark, d):
    return _boxes(spark, d).filter("inside").filter((F.col("area") >= DEFAULTS.min_area_ratio) & F.col("cls").isin(2, 5, 7)).select("l_orderkey", "l_linenumber", "x1", "y1", "x2", "y2", "area")


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_AREA} DESC, l_linenumber, x1, y2) AS n FROM ({_BOX}) WHERE {_INSIDE} AND {_AREA} >= 0.1) WHERE n = 1")
def largest_in_group(spark, d):
    fit = _boxes(spark, d).filter("inside").filter(F.col("area") >= DEFAULTS.min_area_ratio)
    return C.top_per_group(fit, ["l_orderkey"], [F.desc("area"), F.asc("l_linenumber"), F.asc("x1"), F.asc("y2")]).select("l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN c > a AND e > b THEN a END AS x1, CASE WHEN c > a AND e > b THEN b END AS y1, CASE WHEN c > a AND e > b THEN c END AS x2, CASE WHEN c > a AND e > b THEN e END AS y2
FROM (SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(640, round_even((cx - 0.125) * 640, 0))) AS INTEGER) AS a, CAST(greatest(0, least(480, round_even((cy - h / 2) * 480, 0))) AS INTEGER) AS b,
  CAST(greatest(0, least(640, round_even((cx + 0.125) * 640, 0))) AS INTEGER) AS c, CAST(greatest(0, least(480, round_even((cy + h / 2) * 480, 0))) AS INTEGER) AS e
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 64 AS DOUBLE) / 64 AS cx, CAST(l_suppkey % 32 AS DOUBLE) / 32 AS cy, CAST(l_linenumber AS DOUBLE) / 16 AS h FROM lineitem))""")
def yolo_boxes(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "(l_partkey % 64) / 64D cx", "(l_suppkey % 32) / 32D cy", "l_linenumber / 16D h")
    b = G.yolo_box(F.col("cx"), F.col("cy"), F.lit(0.25), F.col("h"), F.lit(640), F.lit(480))
    return rows.withColumn("b", b).select("l_orderkey", "l_linenumber", "b.x1", "b.y1", "b.x2", "b.y2")


@query(f"SELECT l_orderkey, l_linenumber, least(x2 - x1, y2 - y1) >= 20 AND (x2 - x1) / CAST(y2 - y1 AS DOUBLE) >= 2.2 AS car_like, greatest(0, x1 - CAST(trunc((x2 - x1) * CAST(0.05 AS DOUBLE)) AS INTEGER)) AS px FROM ({_BOX}) WHERE y2 > y1")
def car_like_boxes(spark, d):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pad = G.padded(G.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 0.05, F.lit(640), F.lit(480))
    return _boxes(spark, d).filter("y2 > y1").select("l_orderkey", "l_linenumber", G.car_like(w, h).alias("car_like"), pad["x1"].alias("px"))


# votes


@query(f"""
WITH c AS (SELECT session_id, trim(plate_text) AS p, count(*) AS n FROM ({I.PLATES}) GROUP BY ALL),
t AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS n_frames, max(n) FILTER (p <> '') AS votes FROM c GROUP BY 1),
s AS (SELECT t.*, (SELECT count(*) FROM c WHERE c.session_id = t.session_id AND p <> '' AND c.n = t.votes) AS ties FROM t),
m AS (SELECT session_id, color FROM (SELECT session_id, color, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(seq)) AS k FROM ({I.PLATES}) GROUP BY session_id, color) WHERE k = 1)
SELECT s.session_id, n_frames, CAST(coalesce(votes, 0) AS BIGINT) AS votes, CASE WHEN votes IS NULL THEN 'NO_PLATE' WHEN ties > 1 THEN 'UNCERTAIN' ELSE 'DECIDED' END AS status,
  CASE WHEN ties = 1 THEN (SELECT p FROM c WHERE c.session_id = s.session_id AND p <> '' AND c.n = s.votes) ELSE '' END AS plate, m.color
FROM s JOIN m ON m.session_id = s.session_id""")
def majority_vote(spark, d):
    return V.majority(I.plates(spark, d)).select("session_id", "n_frames", "votes", "status", "plate", "color")


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE k = 1")
def mode_first_seen(spark, d):
    return V.first_seen_mode(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query(I.LOCK_VOTE)
def lock_aware_vote(spark, d):
    got = V.lock_aware(I.plates(spark, d), I.plate_registry(spark, d))
    return got.select("session_id", "plate", "color", "n_frames", "status", "action", "color_warning")


# near duplicates

_NAMES = "(SELECT DISTINCT regexp_replace(c_name, '[0-9]{3}$', '') || substr(c_name, -2) AS v FROM customer UNION SELECT DISTINCT p_name FROM part)"


def _names(spark, d):
    short = F.concat(F.regexp_replace("c_name", "[0-9]{3}$", ""), F.substring("c_name", -2, 2))
    return table(spark, d, "customer").select(short.alias("v")).union(table(spark, d, "part").select("p_name"))


@query(f"SELECT a.v AS a, b.v AS b FROM {_NAMES} a JOIN {_NAMES} b ON a.v < b.v AND abs(length(a.v) - length(b.v)) <= 1 WHERE levenshtein(a.v, b.v) <= 1")
def near_duplicate_pairs(spark, d):
    return Z.near_pairs(_names(spark, d), "v")


@query(f"""
WITH RECURSIVE v AS (SELECT v, count(*) AS n FROM (SELECT regexp_replace(c_name, '[0-9]{{3}}$', '') || substr(c_name, -2) AS v FROM customer UNION ALL SELECT p_name FROM part) GROUP BY 1),
e AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON a.v <> b.v AND abs(length(a.v) - length(b.v)) <= 1 AND levenshtein(a.v, b.v) <= 1),
r AS (SELECT v AS node, v AS seen FROM v UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT v.v AS value, min(r.seen) AS cluster, any_value(v.n) AS n FROM v JOIN r ON r.node = v.v GROUP BY v.v""")
def near_duplicate_clusters(spark, d):
    return Z.near_clusters(_names(spark, d), "v")


_RESERVED = "(SELECT DISTINCT upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS r FROM part WHERE p_partkey % 40 = 0)"
_DRAFTS = "(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || 'x' WHEN 2 THEN substr(p_name, 1, 4) ELSE substr(p_name, 2) || 'yy' END AS draft FROM part)"


def _reserved_sql(guard: int) -> str:
    return f"""
SELECT id, CASE min(k) WHEN 0 THEN 'reserved-label' WHEN 1 THEN 'near-reserved-label' END AS reason FROM (
  SELECT id, CASE WHEN n = r THEN 0 WHEN n <> '' AND ((starts_with(n, r) AND length(r) >= {guard}) OR (starts_with(r, n) AND length(n) >= {guard}) OR (abs(length(n) - length(r)) <= 1 AND levenshtein(n, r) <= 1)) THEN 1 END AS k
  FROM (SELECT id, upper(regexp_replace(draft, '[^A-Za-z0-9]', '', 'g')) AS n FROM {_DRAFTS}) CROSS JOIN {_RESERVED}) GROUP BY id"""


def _drafts(spark, d):
    part = table(spark, d, "part")
    drafts = part.selectExpr("p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || 'x' WHEN 2 THEN substr(p_name, 1, 4) ELSE substr(p_name, 2) || 'yy' END AS draft")
    return drafts, part.filter("p_partkey % 40 = 0").select(F.col("p_name").alias("label"))


@query(_reserved_sql(5))
def reserved_near_filter(spark, d):
    return Z.near_reserved(*_drafts(spark, d)).select("id", "reason")


@query(_reserved_sql(1))
def reserved_near_unguarded(spark, d):
    return Z.near_reserved(*_drafts(spark, d), guard=None).select("id", "reason")


_PAIRS = "(SELECT truth, CASE item_id % 3 WHEN 0 THEN truth ELSE substr(truth, 2) || 'q' END AS guess, CASE WHEN item_id % 2 = 0 THEN 'frozen' ELSE 'expanded' END AS subset FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS truth FROM benchmark))"


@query(f"SELECT subset, count(*) AS n, count(*) FILTER (levenshtein(truth, guess) = 0) AS exact, CAST(sum(levenshtein(truth, guess)) AS DOUBLE) / sum(length(truth)) AS cer_micro, round(avg(levenshtein(truth, guess) / CAST(greatest(1, length(truth)) AS DOUBLE)), 9) AS cer_macro FROM {_PAIRS} GROUP BY subset")
def cer_by_subset(spark, d):
    rows = table(spark, d, "benchmark").selectExpr("item_id", "regexp_replace(text, '[^ -~]', '') AS truth")
    rows = rows.selectExpr("truth", "CASE item_id % 3 WHEN 0 THEN truth ELSE substr(truth, 2) || 'q' END AS guess", "CASE WHEN item_id % 2 = 0 THEN 'frozen' ELSE 'expanded' END AS subset")
    return Z.edit_rates(rows, "truth", "guess", ["subset"]).select("subset", "n", "exact", "cer_micro", F.round("cer_macro", 9).alias("cer_macro"))


# manifests

_MANIFEST = """(SELECT d.doc_id AS row_number, 'img/' || (d.doc_id % 990) || '.jpg' AS image_path, lang || (d.doc_id % 300) AS label, CASE WHEN d.doc_id % 50 = 7 THEN 'scan' WHEN l.quality = 1 THEN 'real' ELSE 'pseudo' END AS source_type,
  CASE WHEN d.doc_id % 60 = 3 THEN ' ' ELSE source || '-' || (d.doc_id % 70) END AS group_id, CASE WHEN d.doc_id % 45 = 4 THEN 'dev' WHEN d.doc_id % 10 = 0 THEN 'val' WHEN d.doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN d.doc_id % 33 = 2 THEN 'yes' WHEN l.quality = 1 THEN 'True' ELSE '0' END AS verified, {sha} AS source_sha256 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_MANIFEST_SQL = _MANIFEST.format(sha="CASE WHEN d.doc_id % 77 = 5 THEN 'zz' ELSE sha256(coalesce(text, '')) END")


def _manifest(spark, d):
    for name in ("documents", "labels"):
        table(spark, d, name).createOrReplaceTempView(f"tl_{name}")
    return spark.sql("SELECT * FROM " + _MANIFEST.format(sha="CASE WHEN d.doc_id % 77 = 5 THEN 'zz' ELSE sha2(coalesce(text, ''), 256) END").replace("documents", "tl_documents").replace("labels l", "tl_labels l"))


_REAL = "(source_type = 'real' AND lower(trim(verified)) IN ('true', '1'))"


@query(f"""
WITH m AS (SELECT * FROM {_MANIFEST_SQL})
SELECT 'C3' AS rule, image_path AS key, count(*) AS rows FROM m GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'C6', CAST(row_number AS VARCHAR), 1 FROM m WHERE source_type NOT IN ('real', 'synthetic', 'pseudo')
UNION ALL SELECT 'C7', CAST(row_number AS VARCHAR), 1 FROM m WHERE split NOT IN ('train', 'val', 'test')
UNION ALL SELECT 'C8', CAST(row_number AS VARCHAR), 1 FROM m WHERE lower(trim(verified)) NOT IN ('true', '1', 'false', '0')
UNION ALL SELECT 'C9', CAST(row_number AS VARCHAR), 1 FROM m WHERE trim(group_id) = ''
UNION ALL SELECT 'C13', CAST(row_number AS VARCHAR), 1 FROM m WHERE NOT regexp_full_match(source_sha256, '[0-9a-f]{{64}}')
UNION ALL SELECT 'C15', CAST(row_number AS VARCHAR), 1 FROM m WHERE split IN ('val', 'test') AND NOT {_REAL}
UNION ALL SELECT 'C10', group_id, count(*) FROM m WHERE group_id <> '' GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'C11', label, count(*) FROM m WHERE label <> '' GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'C12', label, count(*) FROM m WHERE {_REAL} GROUP BY 2 HAVING count(DISTINCT group_id) > 1
UNION ALL SELECT 'C14', source_sha256, count(*) FROM m WHERE source_sha256 <> '' GROUP BY 2 HAVING count(DISTINCT split) > 1""")
def manifest_violations(spark, d):
    return M.violations(_manifest(spark, d), label_ok=F.col("label").isNotNull())


@query(f"""
WITH m AS (SELECT row_number, label, group_id, split, source_sha256 FROM {_MANIFEST_SQL}),
i AS (SELECT row_number, split, 'label' AS kind, upper(label) AS value FROM m UNION ALL SELECT row_number, split, 'group', trim(group_id) FROM m UNION ALL SELECT row_number, split, 'hash', lower(trim(source_sha256)) FROM m),
b AS (SELECT kind, value, min(split) < max(split) AS crosses, EXISTS (FROM (SELECT sha256(text) AS h, item_id FROM benchmark) r WHERE (kind = 'hash' AND value = h) OR (kind = 'label' AND value = 'EN' || (item_id * 7)) OR (kind = 'group' AND value = 'web-' || item_id)) AS taken FROM i WHERE value <> '' GROUP BY 1, 2)
SELECT m.row_number, coalesce(bool_or(taken), false) AS reserved, coalesce(bool_or(crosses), false) AS crossing FROM m LEFT JOIN i ON i.row_number = m.row_number LEFT JOIN b ON b.kind = i.kind AND b.value = i.value GROUP BY 1""")
def composed_manifest(spark, d):
    """What stops the composition of two manifests: identities that are reserved or cross splits."""
    rows = _manifest(spark, d).select("row_number", "label", "group_id", "split", "source_sha256")
    reserved = table(spark, d, "benchmark").select(F.concat(F.lit("en"), (F.col("item_id") * 7).cast("string")).alias("label"), F.concat(F.lit("web-"), F.col("item_id").cast("string")).alias("group_id"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"))
    return M.marked([rows.filter("row_number % 2 = 0"), rows.filter("row_number % 2 = 1")], reserved).select("row_number", "reserved", "crossing")


@query(f"SELECT count(*) AS rows, count(DISTINCT label) AS labels, count(DISTINCT group_id) AS groups, count(*) FILTER ({_REAL} AND split = 'test') AS real_test FROM {_MANIFEST_SQL}")
def manifest_summary(spark, d):
    return M.summary(_manifest(spark, d))


def _ids(spark, d):
    ids = lambda n, key: table(spark, d, n).select(F.concat(F.lit("30A"), F.lpad((F.col(key) * 13 % 90000).cast("string"), 5, "0")).alias("label"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), F.col(key).alias("id"))
    return ids("documents", "doc_id"), ids("benchmark", "item_id")


_IDS = "(SELECT {k} AS id, '30A' || lpad(CAST({k} * 13 % 90000 AS VARCHAR), 5, '0') AS label, sha256(text) AS sha FROM {t})"
_DOC_IDS, _BENCH_IDS = _IDS.format(k="doc_id", t="documents"), _IDS.format(k="item_id", t="benchmark")


@query(f"SELECT 'label' AS kind, count(DISTINCT label) AS shared FROM {_DOC_IDS} WHERE label IN (SELECT label FROM {_BENCH_IDS}) UNION ALL SELECT 'hash', count(DISTINCT sha) FROM {_DOC_IDS} WHERE sha IN (SELECT sha FROM {_BENCH_IDS}) HAVING count(*) > 0")
def leak_report(spark, d):
    return M.leaks(*_ids(spark, d))


@query(f"SELECT id FROM {_DOC_IDS} WHERE label NOT IN (SELECT label FROM {_BENCH_IDS}) AND (sha IS NULL OR sha NOT IN (SELECT sha FROM {_BENCH_IDS}))")
def isolated_rows(spark, d):
    return M.isolated(*_ids(spark, d), key="id").select("id")


# curation


@query("""
WITH g AS (SELECT s, row_number() OVER (ORDER BY sha256('42:' || s), s) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT source AS s FROM documents))
SELECT doc_id, CASE WHEN pos <= round_even(n * 0.8, 0) THEN 'train' WHEN pos <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM documents JOIN g ON source = s""")
def grouped_split(spark, d):
    return C.grouped_split(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


_CLASS = "(SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS pos FROM documents)"


@query(f"SELECT doc_id, CASE WHEN pos <= greatest(1, floor(n * CAST(0.70 AS DOUBLE))) THEN 'train' WHEN pos <= greatest(1, floor(n * CAST(0.70 AS DOUBLE))) + greatest(1, floor(n * CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM {_CLASS}")
def stratified_split(spark, d):
    return C.class_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "split")


@query(f"SELECT doc_id, CASE WHEN pos <= greatest(1, floor(n * CAST(0.2 AS DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM {_CLASS}")
def holdout_split(spark, d):
    return C.class_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", rule="holdout").select("doc_id", "split")


@query(f"SELECT doc_id, CASE WHEN pos <= k THEN 'test' WHEN pos <= 2 * k THEN 'val' ELSE 'train' END AS split FROM (SELECT *, round_even(n * CAST(0.15 AS DOUBLE), 0) AS k FROM {_CLASS})")
def task_split(spark, d):
    return C.class_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", rule="task").select("doc_id", "split")


_PRIO = "CASE WHEN starts_with(p_name, 'red') THEN 0 WHEN starts_with(p_name, 'small') THEN 1 ELSE 2 END"


@query(f"SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY {_PRIO}, p_name, p_partkey) <= 50 AS kept FROM part")
def cap_per_class(spark, d):
    part = table(spark, d, "part")
    kept, over = C.cap(part, ["p_type"], [C.priority(F.col("p_name"), ["red", "small"]), F.col("p_name"), F.col("p_partkey")], 50)
    return kept.select(F.col("p_partkey").alias("id"), F.lit(True).alias("kept")).union(over.select("p_partkey", F.lit(False)))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_brand, p_partkey) AS s FROM part)
SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY s > 1, p_retailprice DESC, p_brand, p_partkey) AS k FROM r) WHERE k <= 30""")
def diverse_topk(spark, d):
    return C.diverse(table(spark, d, "part"), "p_type", "p_brand", "p_partkey", "p_retailprice", 30).select("p_type", "p_partkey")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def best_per_group(spark, d):
    return C.top_per_group(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) ORDER BY p_retailprice DESC, p_partkey, p_brand LIMIT 10")
def topk_anti(spark, d):
    reserved = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return C.best_not_reserved(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], reserved, "p_partkey", 10).select("p_brand", "p_partkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 30")
def sample_per_band(spark, d):
    return C.sample_per_band(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id")


@query("""
WITH o AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY sha256('42:' || p_partkey), p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_type) AS n FROM part),
c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS c, count(*) OVER () AS k, least(200, max(n)) AS n FROM o GROUP BY 1),
t AS (SELECT CAST(range AS INTEGER) AS turn FROM range(200))
SELECT turn, CAST(turn // k // c.n AS INTEGER) AS round, o.p_partkey FROM t JOIN c ON turn % k = c.c JOIN o ON o.p_type = c.p_type AND o.pos = (turn // k) % c.n WHERE turn // k // c.n = 0
UNION ALL SELECT turn, round, p_partkey FROM (
  SELECT t.turn, CAST(turn // k // c.n AS INTEGER) AS round, (turn // k) % c.n AS place, o.p_partkey, row_number() OVER (PARTITION BY t.turn ORDER BY sha256('42.' || (turn // k // c.n) || ':' || o.p_partkey), o.p_partkey) - 1 AS pos
  FROM t JOIN c ON turn % k = c.c JOIN o ON o.p_type = c.p_type WHERE turn // k // c.n > 0) WHERE pos = place""")
def round_robin_trials(spark, d):
    return C.round_robin(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 200).select("turn", "round", "p_partkey")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark, d):
    return C.exact_dedup(table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


@query("""
WITH RECURSIVE o AS (SELECT vec_id, label, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS h, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r(label, n, vec_id, kept, held) AS (SELECT label, n, vec_id, true, [h] FROM o WHERE n = 1
  UNION ALL SELECT label, n, vec_id, ok, CASE WHEN ok THEN list_append(held, h) ELSE held END FROM (SELECT o.*, r.held, len(list_filter(r.held, lambda x: hamming(x, o.h) <= 12)) = 0 AS ok FROM r JOIN o ON o.label = r.label AND o.n = r.n + 1))
SELECT vec_id, label, kept FROM r""")
def greedy_dedup(spark, d):
    bits = F.aggregate(F.slice("embedding", 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    rows = table(spark, d, "embeddings").select("vec_id", "label", bits.alias("phash"))
    return B.greedy(rows, "label", "vec_id", "phash", 12).select("vec_id", "label", "kept")


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.quality = 0 THEN 'low-quality' WHEN l.toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' WHEN d.text IN (SELECT text FROM benchmark) THEN 'reserved' ELSE 'kept' END AS reason
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1""")
def funnel_reasons(spark, d):
    reserved = table(spark, d, "benchmark").select("text").distinct().withColumn("r", F.lit(True))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").join(reserved, "text", "left")
    return C.funnel(rows, [("low-quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1), ("short", F.col("n_chars") < 200), ("reserved", F.col("r"))]).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'a_' || n_name AS name, 'a' AS origin FROM nation UNION ALL SELECT 'b_' || r_name, 'b' FROM region")
def consolidate_sources(spark, d):
    return C.consolidate({"a": table(spark, d, "nation").select(F.col("n_name").alias("name")), "b": table(spark, d, "region").select(F.col("r_name").alias("name"))}, "name")


@query("SELECT s_suppkey AS k FROM supplier UNION SELECT c_custkey FROM customer")
def merge_skip_existing(spark, d):
    return C.merge_new(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT o_orderkey AS l_orderkey, o_orderstatus AS split, coalesce(n, 0) AS boxes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def images_with_boxes(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("split"))
    boxes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("boxes"))
    return images.join(boxes, "l_orderkey", "left").select("l_orderkey", "split", F.coalesce("boxes", F.lit(0)).alias("boxes"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def semantic_filter(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


# ordered rows


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 3 = 0")
def every_nth(spark, d):
    return O.every_nth(table(spark, d, "events"), "user_id", "event_id", 3).select("event_id")


@query("""
WITH e AS (SELECT *, value < 60 AS ok, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
r AS (SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS INTEGER) AS run FROM e)
SELECT event_id, run, CASE WHEN run = 0 THEN 'IDLE' WHEN run < 3 THEN 'TRACKING' ELSE 'READY_TO_DECIDE' END AS state FROM r""")
def run_length_gate(spark, d):
    return O.gate_state(table(spark, d, "events"), "user_id", "event_id", F.col("value") < 60, DEFAULTS.min_persist_frames).select("event_id", "run", "state")


@query("SELECT event_id FROM (SELECT event_id, event_type = 'purchase' AS s, lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE s AND NOT coalesce(b, false)")
def rising_edge(spark, d):
    return O.rising_edges(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase").select("event_id")


@query("SELECT event_id, count(value) OVER w AS n, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def sliding_window_50(spark, d):
    return O.sliding_stats(table(spark, d, "events"), "user_id", "event_id", "value", 50).select("event_id", "n", "low", "high")


@query("SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS latched FROM events")
def evidence_latch(spark, d):
    return O.latch(table(spark, d, "events").withColumn("e", F.col("event_id")), "user_id", "event_id", F.col("event_type") == "purchase", "e", "latched").select("event_id", "latched")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def final_event_changes(spark, d):
    return O.changed(table(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pos = least(n - 1, floor(n * 0.5))")
def frame_at_fraction(spark, d):
    return O.at_fraction(table(spark, d, "events"), "user_id", "event_id", 0.5).select("event_id")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_per_session(spark, d):
    return O.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50")
def result_log(spark, d):
    return O.newest(table(spark, d, "events"), "event_id").select("event_id")


@query("SELECT p_partkey, CAST((n - 1) // 24 AS INTEGER) AS page, CAST((n - 1) % 24 AS INTEGER) AS cell FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS n FROM part)")
def sheet_map(spark, d):
    return O.pages_of(table(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 24).select("p_partkey", "page", "cell")


# evaluation


@query("SELECT e.label AS truth, count(*) FILTER (g = 0) AS p_0, count(*) FILTER (g = 1) AS p_1, count(*) FILTER (g = 2) AS p_2 FROM (SELECT label % 3 AS label, (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 3 AS g FROM embeddings) e GROUP BY 1")
def confusion_matrix(spark, d):
    return E.confusion(_predictions(spark, d), "truth", "guess", [0, 1, 2])


def _predictions(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id", "label % 3 AS truth", "(label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 3 AS guess")


@query("""
WITH p AS (SELECT label % 3 AS t, (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 3 AS g FROM embeddings), c AS (SELECT DISTINCT t AS class FROM p UNION SELECT g FROM p)
SELECT class, s AS support, CASE WHEN q = 0 THEN 0.0 ELSE k / CAST(q AS DOUBLE) END AS precision, CASE WHEN s = 0 THEN 0.0 ELSE k / CAST(s AS DOUBLE) END AS recall, CASE WHEN q + s = 0 THEN 0.0 ELSE 2 * k / CAST(q + s AS DOUBLE) END AS f1
FROM (SELECT class, (SELECT count(*) FROM p WHERE t = class) AS s, (SELECT count(*) FROM p WHERE g = class) AS q, (SELECT count(*) FROM p WHERE t = class AND g = class) AS k FROM c)""")
def class_metrics(spark, d):
    return E.class_metrics(_predictions(spark, d), "truth", "guess")


_CLASSES = ["de", "en", "es", "fr", "it"]


@query(f"SELECT class, n, (CAST(1 AS DOUBLE) / greatest(1, n)) / avg(CAST(1 AS DOUBLE) / greatest(1, n)) OVER () AS weight FROM (SELECT class, count(lang) AS n FROM (SELECT unnest({_CLASSES!r}) AS class) LEFT JOIN documents ON lang = class GROUP BY 1)")
def class_weights(spark, d):
    return E.class_weights(table(spark, d, "documents"), "lang", _CLASSES)


@query(f"SELECT count(*) AS n, count(*) FILTER (action = 'ALLOW') AS correct, count(*) FILTER (action = 'ALLOW_WARN') AS false_alarms, count(*) FILTER (status <> 'AUTHORIZED') AS unexpected, count(*) FILTER (action = 'ALLOW_WARN') / CAST(count(*) AS DOUBLE) AS false_alarm_rate FROM ({I.VERIFIED})")
def security_legitimate(spark, d):
    return E.legitimate(R.verify(I.readings(spark, d), I.registry(spark, d)))


@query(f"SELECT registered, \"true\", count(*) AS n, count(*) FILTER (action <> 'ALLOW_WARN') AS missed, count(*) FILTER (action <> 'ALLOW_WARN') / CAST(count(*) AS DOUBLE) AS miss_rate FROM (SELECT registered, upper(color) AS \"true\", action FROM ({I.VERIFIED}) WHERE registered IS NOT NULL) GROUP BY ALL")
def security_swaps(spark, d):
    reg = I.registry(spark, d)
    got = R.verify(I.readings(spark, d), reg).withColumn("k", F.regexp_replace("plate_text", "-", ""))
    return E.swaps(got.join(reg.select(F.col("license_plate").alias("k"), F.col("car_color").alias("registered")), "k").withColumn("true", F.upper("color")))


@query(f"SELECT count(*) AS n, count(*) FILTER (status = 'UNREGISTERED') AS correct, count(*) FILTER (status = 'UNREGISTERED') / CAST(count(*) AS DOUBLE) AS rate FROM ({I.VERIFIED})")
def security_unregistered(spark, d):
    return E.unregistered(R.verify(I.readings(spark, d), I.registry(spark, d)))


_GATES = [0.0, 0.3, 0.4, 0.5, 0.6]
_TRIALS = f"(SELECT CASE WHEN event_id % 2 = 0 THEN 'legitimate' ELSE 'swap' END AS scenario, upper(color) AS predicted, {I._case('event_id % 5', {})[:-4]} WHEN 0 THEN 'BLACK' WHEN 1 THEN 'RED' WHEN 2 THEN 'WHITE' WHEN 3 THEN 'BLUE' ELSE 'SILVER' END AS registered, color_conf AS conf FROM ({I.READINGS}))"


@query(f"""
WITH t AS (SELECT *, NOT (predicted = registered OR (predicted IN {I.NEUTRAL} AND registered IN {I.NEUTRAL})) AND NOT (conf IS NOT NULL AND conf < gate) AS warn FROM {_TRIALS} CROSS JOIN (SELECT CAST(unnest({_GATES!r}) AS DOUBLE) AS gate))
SELECT gate, count(*) FILTER (scenario = 'legitimate' AND warn) / CAST(count(*) FILTER (scenario = 'legitimate') AS DOUBLE) AS false_alarm_rate, count(*) FILTER (scenario = 'swap' AND warn) / CAST(count(*) FILTER (scenario = 'swap') AS DOUBLE) AS detection_rate FROM t GROUP BY gate""")
def gate_sweep(spark, d):
    rows = I.readings(spark, d).selectExpr("CASE WHEN event_id % 2 = 0 THEN 'legitimate' ELSE 'swap' END AS scenario", "upper(color) AS predicted", "CASE event_id % 5 WHEN 0 THEN 'BLACK' WHEN 1 THEN 'RED' WHEN 2 THEN 'WHITE' WHEN 3 THEN 'BLUE' ELSE 'SILVER' END AS registered", "color_conf AS conf")
    return E.gate_sweep(rows, _GATES)


_COLOURS = ("Black", "Blue", "Brown", "Grey", "Red", "Silver", "White", "Yellow")
_CARS_EXPR = {"vec_id": "vec_id", "colour": f"element_at(array({', '.join(map(repr, _COLOURS))}), cast(label % 8 + 1 as int))", "seen": f"element_at(array({', '.join(map(repr, _COLOURS))}), cast((label + CASE WHEN vec_id % 5 = 0 THEN 3 ELSE 0 END) % 8 + 1 as int))", "conf": "(vec_id % 100) / cast(100 as double)"}
_TRIAL_SQL = f"""
cars AS (SELECT vec_id, k[label % 8 + 1] AS colour, k[(label + CASE WHEN vec_id % 5 = 0 THEN 3 ELSE 0 END) % 8 + 1] AS seen, (vec_id % 100) / CAST(100 AS DOUBLE) AS conf FROM embeddings, (SELECT {list(_COLOURS)!r} AS k)),
scen AS (SELECT unnest(['legitimate', 'plate_swap', 'unregistered']) AS scenario, unnest([42, 43, 44]) AS seed),
cls AS (SELECT colour, row_number() OVER (ORDER BY colour) - 1 AS c, count(*) OVER () AS k, n FROM (SELECT colour, count(*) AS n FROM cars GROUP BY 1)),
turn AS (SELECT scenario, seed, CAST(t AS INTEGER) AS turn, colour, (t // k) % n AS place, t // k // n AS round FROM scen, range(600) r(t) JOIN cls ON t % k = c),
pick AS (SELECT t.scenario, t.seed, t.turn, t.place, x.*, row_number() OVER (PARTITION BY t.scenario, t.turn ORDER BY sha256(t.seed || CASE WHEN t.round > 0 THEN '.' || t.round ELSE '' END || ':' || x.vec_id), x.vec_id) - 1 AS pos FROM turn t JOIN cars x USING (colour)),
trial AS (SELECT *, CASE scenario WHEN 'legitimate' THEN colour WHEN 'plate_swap' THEN list_filter({list(_COLOURS)!r}, lambda z: z <> colour)[CAST('0x' || substr(sha256(seed || ':other:' || turn), 1, 8) AS BIGINT) % 7 + 1] END AS registered FROM pick WHERE pos = place),
v AS (SELECT *, upper(seen) = upper(registered) OR (upper(seen) IN {I.NEUTRAL} AND upper(registered) IN {I.NEUTRAL}) AS same, upper(colour) IN {I.NEUTRAL} AND upper(registered) IN {I.NEUTRAL} AS neutral, NOT coalesce(same OR conf < 0.4, false) AND registered IS NOT NULL AS warn FROM trial)"""


@query(f"""
WITH {_TRIAL_SQL},
g AS (SELECT gate, avg(CASE WHEN NOT same AND NOT conf < gate THEN 1 ELSE 0 END) FILTER (scenario = 'legitimate') AS f, count(*) FILTER (scenario = 'plate_swap' AND NOT same AND NOT conf < gate) / CAST(count(*) FILTER (scenario = 'plate_swap') AS DOUBLE) AS d FROM v, (SELECT unnest([0.0, 0.4, 0.6]) AS gate) WHERE registered IS NOT NULL GROUP BY gate),
l AS (SELECT count(*) AS n, count(*) FILTER (NOT warn) AS correct, count(*) FILTER (warn) AS alarms FROM v WHERE scenario = 'legitimate'),
s AS (SELECT count(*) AS n, count(*) FILTER (warn) AS caught, count(*) FILTER (neutral) AS nn, count(*) FILTER (neutral AND NOT warn) AS nm FROM v WHERE scenario = 'plate_swap')
SELECT unnest(['legitimate.n', 'legitimate.correct', 'legitimate.false_alarms', 'legitimate.unexpected', 'legitimate.false_alarm_rate']) AS metric, unnest([n, correct, alarms, 0, alarms / CAST(n AS DOUBLE)]) AS value FROM l
UNION ALL SELECT unnest(['plate_swap.n', 'plate_swap.caught', 'plate_swap.missed', 'plate_swap.detection_rate', 'plate_swap.miss_rate', 'plate_swap.neutral_n', 'plate_swap.neutral_missed', 'plate_swap.neutral_miss_rate']), unnest([n, caught, n - caught, caught / CAST(n AS DOUBLE), (n - caught) / CAST(n AS DOUBLE), nn, nm, nm / CAST(nn AS DOUBLE)]) FROM s
UNION ALL SELECT unnest(['unregistered.n', 'unregistered.correct', 'unregistered.rate']), unnest([n, n, CAST(1 AS DOUBLE)]) FROM (SELECT count(*) AS n FROM v WHERE scenario = 'unregistered')
UNION ALL SELECT printf('gate.%.2f.false_alarm_rate', gate), f FROM g UNION ALL SELECT printf('gate.%.2f.detection_rate', gate), d FROM g""")
def security_evaluation(spark, d):
    """Trials, registration, verification, scores and the sweep as one chain."""
    trials = E.security_trials(table(spark, d, "embeddings").selectExpr(*[f"{v} AS {k}" for k, v in _CARS_EXPR.items()]), "colour", "vec_id", _COLOURS, 600)
    return E.security_report(trials, "seen", "conf", [0.0, 0.4, 0.6])


_TRUTH = "concat('30A', lpad(cast(10000 + p_partkey * 37 % 80000 as {s}), 5, '0'))"
_READ_EXPR = {
    "engine": "engine", "subset": "CASE WHEN p_partkey % 2 = 0 THEN 'frozen' ELSE 'expanded' END", "kind": "CASE WHEN p_partkey % 100 = 1 THEN 'cold' ELSE 'sample' END", "truth": _TRUTH,
    "prediction": f"CASE WHEN p_partkey * k % 13 = 0 THEN '' WHEN p_partkey * k % 17 = 0 THEN concat(substr({_TRUTH}, 2), 'Q') WHEN p_partkey * k % 19 = 0 THEN substr({_TRUTH}, 1, 7) ELSE {_TRUTH} END",
    "latency_ms": "cast(p_partkey * k * 31 % 1009 as double)", "seq": "p_partkey",
}
_ENGINES = "(SELECT 'candidate' AS engine, 1 AS k UNION ALL SELECT 'other', 3)"
_READS = "SELECT " + ", ".join(f"{v.format(s='VARCHAR')} AS {k}" for k, v in _READ_EXPR.items()) + f" FROM part, {_ENGINES}"
_OCR = rf"""
two AS (SELECT * REPLACE (unnest(['all', subset]) AS subset) FROM ({_READS})),
report AS (SELECT engine, subset, count(*) AS n, count(*) FILTER (prediction = truth) / CAST(count(*) AS DOUBLE) AS exact_match, CAST(sum(levenshtein(prediction, truth)) AS DOUBLE) / sum(length(truth)) AS cer,
  count(*) FILTER (NOT regexp_full_match(prediction, '[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4,6}}')) / CAST(count(*) AS DOUBLE) AS invalid_format_rate, first(cold) AS cold_ms, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95
  FROM two JOIN (SELECT engine, arg_min(latency_ms, seq) AS cold FROM ({_READS}) WHERE kind = 'cold' GROUP BY 1) USING (engine) WHERE kind = 'sample' GROUP BY 1, 2)"""


def _reads_of_engines(spark, d):
    engines = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(k).cast("long").alias("k")) for e, k in (("candidate", 1), ("other", 3))]))
    return table(spark, d, "part").select("p_partkey", engines.alias("e")).select("p_partkey", "e.*").selectExpr(*[f"{v.format(s='string')} AS {k}" for k, v in _READ_EXPR.items()])


@query(f"WITH {_OCR} SELECT * FROM report")
def ocr_report(spark, d):
    return E.ocr_report(_reads_of_engines(spark, d))


@query(f"""
WITH {_OCR}, r AS (SELECT max(exact_match) FILTER (engine = 'candidate' AND subset = 'frozen') AS a, max(exact_match) FILTER (engine = 'candidate' AND subset = 'expanded') AS b, max(cer) FILTER (engine = 'candidate' AND subset = 'all') AS c, max(p95) FILTER (engine = 'candidate' AND subset = 'all') AS p, max(p95) FILTER (engine = 'other' AND subset = 'all') AS q FROM report)
SELECT len(reasons) = 0 AS passed, array_to_string(reasons, '; ') AS reasons FROM (SELECT list_filter([CASE WHEN a < 0.9 THEN 'frozen exact match ' || printf('%.4f', a) || ' is below 0.90' END, CASE WHEN b < 0.9 THEN 'expanded exact match ' || printf('%.4f', b) || ' is below 0.90' END,
  CASE WHEN c > 0.031 THEN 'combined CER ' || printf('%.4f', c) || ' exceeds 0.031' END, CASE WHEN p >= q THEN 'candidate warm p95 latency ' || printf('%.2f', p) || ' ms is not lower than Paddle p95 ' || printf('%.2f', q) || ' ms' END], lambda x: x IS NOT NULL) AS reasons FROM r)""")
def ocr_deployment(spark, d):
    """From predictions to the reasons against deployment."""
    return E.ocr_deployment(E.ocr_report(_reads_of_engines(spark, d)), "candidate", "other").select("passed", F.array_join("reasons", "; ").alias("reasons"))


@query("SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return E.percentiles(table(spark, d, "events"), ["event_type"], "value")


@query(f"SELECT count(*) AS total, CAST(sum(ms) AS DOUBLE) / count(*) AS avg_ms, count(*) FILTER (status = 'AUTHORIZED') AS authorized_count, count(*) FILTER (status = 'UNREGISTERED') AS unregistered_count, CAST(0 AS BIGINT) AS mismatch_count, CAST(0 AS BIGINT) AS no_plate_count, CAST(0 AS BIGINT) AS error_count FROM (SELECT status, event_id % 97 AS ms FROM ({I.VERIFIED}))")
def evaluation_metrics(spark, d):
    return E.latency_metrics(R.verify(I.readings(spark, d), I.registry(spark, d)).withColumn("ms", F.col("event_id") % 97), "ms", "status")


@query("SELECT stage, quantile_cont(ms, 0.5) AS median, min(ms) AS low, max(ms) AS high FROM (SELECT unnest(['l_quantity', 'l_linenumber', 'total']) AS stage, unnest([l_quantity, CAST(l_linenumber AS DOUBLE), l_quantity + l_linenumber]) AS ms FROM lineitem) GROUP BY 1")
def stage_latency(spark, d):
    return E.stage_latency(table(spark, d, "lineitem").select("l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber")), ["l_quantity", "l_linenumber"])


@query("""
SELECT l_orderkey, passed, len(reasons) AS n_reasons, array_to_string(reasons, '; ') AS reasons FROM (SELECT l_orderkey, list_filter([CASE WHEN a < 0.9 THEN 'frozen exact match ' || printf('%.4f', a) || ' is below 0.90' END, CASE WHEN b < 0.9 THEN 'expanded exact match ' || printf('%.4f', b) || ' is below 0.90' END,
  CASE WHEN c > 0.031 THEN 'combined CER ' || printf('%.4f', c) || ' exceeds 0.031' END, CASE WHEN p >= q THEN 'candidate warm p95 latency ' || printf('%.2f', p) || ' ms is not lower than Paddle p95 ' || printf('%.2f', q) || ' ms' END], lambda x: x IS NOT NULL) AS reasons, a >= 0.9 AND b >= 0.9 AND c <= 0.031 AND p < q AS passed
  FROM (SELECT l_orderkey, min(l_quantity) / CAST(50 AS DOUBLE) AS a, max(l_quantity) / CAST(50 AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) / 125 AS c, min(l_quantity) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1))""")
def deployment_gate(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.min("l_quantity") / 50).alias("frozen_exact"), (F.max("l_quantity") / 50).alias("expanded_exact"), (F.count("*").cast("double") / 125).alias("cer"), F.min("l_quantity").alias("candidate_p95"), F.max("l_quantity").alias("other_p95")
    )
    return E.deployment_gate(rows).select("l_orderkey", "passed", F.size("reasons").cast("long").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons"))


_CAL = "(SELECT CAST(event_id % 100 AS DOUBLE) / 100 AS c, event_id % 100 >= 90 OR event_id % 3 = 0 AS ok FROM events)"


@query(f"""
WITH s AS (SELECT t.c, count(*) AS support, count(*) FILTER (ok) AS hits FROM (SELECT DISTINCT c FROM {_CAL}) t JOIN {_CAL} r ON r.c >= t.c GROUP BY 1), b AS (SELECT * FROM s WHERE hits / CAST(support AS DOUBLE) >= 0.9 ORDER BY c LIMIT 1)
SELECT b.c AS threshold, hits / CAST(support AS DOUBLE) AS precision, coalesce(support / CAST(n AS DOUBLE), 0) AS coverage, CAST(coalesce(support, 0) AS BIGINT) AS support, n AS total, b.c IS NOT NULL AS available FROM (SELECT count(*) AS n FROM {_CAL}) LEFT JOIN b ON true""")
def threshold_calibration(spark, d):
    rows = table(spark, d, "events").selectExpr("(event_id % 100) / 100D AS c", "event_id % 100 >= 90 OR event_id % 3 = 0 AS ok")
    return E.calibrate(rows, "c", "ok", 0.9)


@query("SELECT o_custkey, o_orderkey AS epoch FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_checkpoint(spark, d):
    return E.best_checkpoint(table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey AS epoch", "o_orderpriority AS exact", "o_totalprice AS cer"), ["o_custkey"])


@query("SELECT event_type AS candidate, count(*) AS n, count(*) FILTER (user_id % 2 = event_id % 2) / CAST(count(*) AS DOUBLE) AS accuracy FROM events GROUP BY 1")
def model_benchmark(spark, d):
    return E.benchmark(table(spark, d, "events").selectExpr("event_type AS candidate", "user_id % 2 AS truth", "event_id % 2 AS guess", "value AS ms")).select("candidate", "n", "accuracy")


@query("SELECT vec_id AS sample_id, truth AS true_label, guess AS pred_label FROM (SELECT vec_id, label % 3 AS truth, (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 3 AS guess, (vec_id % 50) / CAST(50 AS DOUBLE) AS c FROM embeddings) WHERE truth <> guess AND c >= 0.8")
def label_audit(spark, d):
    rows = _predictions(spark, d).selectExpr("vec_id AS sample_id", "truth AS true_label", "guess AS pred_label", "(vec_id % 50) / 50D AS confidence")
    return E.suspects(rows).select("sample_id", "true_label", "pred_label")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id % 2000 DESC, event_id) - 1 AS place FROM events WHERE event_id % 2000 >= 1998")
def near_certain(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "(event_id % 2000) / 2000D AS conf")
    from tallyline.operators.ordered import pages_of

    return pages_of(E.near_certain(rows, "conf"), [F.col("conf").desc(), F.col("event_id")], 1).select("event_id", F.col("page").cast("long").alias("place"))


@query(f"SELECT session_id, plate, color, n_frames, status, action, color_warning FROM ({I.LOCK_VOTE})")
def vote_dispatch(spark, d):
    return V.aggregate(I.plates(spark, d), I.plate_registry(spark, d))


# sequences


@query("""
WITH RECURSIVE b AS (SELECT band, n, row_number() OVER (ORDER BY band) AS i FROM (SELECT CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) AS band, count(*) AS n FROM events GROUP BY 1)),
r(i, g, total) AS (SELECT i, 1, n FROM b WHERE i = 1 UNION ALL SELECT b.i, CASE WHEN r.total < 200 THEN r.g ELSE r.g + 1 END, CASE WHEN r.total < 200 THEN r.total + b.n ELSE b.n END FROM r JOIN b ON b.i = r.i + 1)
SELECT string_agg(band, '|' ORDER BY b.i) AS bands, CAST(sum(n) AS BIGINT) AS n FROM r JOIN b ON b.i = r.i GROUP BY g""")
def merge_small_bands(spark, d):
    bands = table(spark, d, "events").groupBy((F.floor(F.col("value") / 40)).cast("string").alias("band")).agg(F.count("*").alias("n"))
    rows = bands.agg(F.array_sort(F.collect_list(F.struct("band", "n"))).alias("counts"))
    return rows.select(F.explode(D.merge_small_bands(F.col("counts"), 200)).alias("g")).select(F.array_join("g.bands", "|").alias("bands"), "g.n")


@query("""
WITH s AS (SELECT vec_id, t, list_transform(list_slice(embedding, t * 8 + 1, t * 8 + 8), lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings, range(8) steps(t)),
b AS (SELECT vec_id, t, list_position(x, m) - 1 AS i, 1 / list_sum(list_transform(x, lambda v: exp(v - m))) AS p FROM (SELECT *, list_max(x) AS m FROM s)),
k AS (SELECT *, i <> 7 AND i IS DISTINCT FROM lag(i) OVER (PARTITION BY vec_id ORDER BY t) AS emitted FROM b)
SELECT vec_id, coalesce(string_agg(substr('ABCDEFG', CAST(i + 1 AS INTEGER), 1), '' ORDER BY t) FILTER (emitted), '') AS text, round(coalesce(avg(p) FILTER (emitted), 0), 6) AS conf FROM k GROUP BY 1""")
def ctc_decode(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform(F.slice("embedding", t * 8 + 1, 8), lambda x: x.cast("double")))
    return table(spark, d, "embeddings").withColumn("r", D.ctc_decode(rows, "ABCDEFG")).select("vec_id", "r.text", F.round("r.conf", 6).alias("conf"))


@query("SELECT vec_id, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS best FROM (SELECT vec_id, list_transform(range(1, 33), lambda i: (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 2) AS m FROM embeddings)")
def tta_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", D.argmax(D.mean_of_two(_half(1), _half(33))).alias("best"))


def _half(start):
    return F.transform(F.slice("embedding", start, 32), lambda x: x.cast("double"))


_COLOR_CLASSES = [f"class-{k}" for k in range(8)]


@query("""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY sha256('42:' || vec_id), vec_id) AS pos FROM (SELECT vec_id, 'class-' || (label % 8) AS t, embedding FROM embeddings)),
x AS (SELECT t, 'class-' || ((list_position(p, list_max(p)) - 1) % 8) AS p, 'class-' || ((list_position(m, list_max(m)) - 1) % 8) AS g FROM (
  SELECT t, list_transform(range(1, 33), lambda i: CAST(embedding[i] AS DOUBLE)) AS p, list_transform(range(1, 33), lambda i: (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 2) AS m
  FROM c WHERE pos > greatest(1, floor(n * CAST(0.70 AS DOUBLE))) + greatest(1, floor(n * CAST(0.15 AS DOUBLE))))),
k AS (SELECT 'class-' || unnest(range(8)) AS class),
s AS (SELECT class, h, (SELECT count(*) FROM x WHERE t = class) AS s, (SELECT count(*) FROM x WHERE CASE WHEN h = 'plain' THEN p ELSE g END = class) AS q, (SELECT count(*) FROM x WHERE t = class AND CASE WHEN h = 'plain' THEN p ELSE g END = class) AS k FROM k, (SELECT unnest(['plain', 'tta']) AS h)),
r AS (SELECT class, h, CASE WHEN q = 0 THEN 0 ELSE k / CAST(q AS DOUBLE) END AS precision, CASE WHEN s = 0 THEN 0 ELSE k / CAST(s AS DOUBLE) END AS recall, CASE WHEN q + s = 0 THEN 0 ELSE 2 * k / CAST(q + s AS DOUBLE) END AS f1 FROM s)
SELECT 'n_total' AS metric, CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS value UNION ALL SELECT 'n_test', CAST((SELECT count(*) FROM x) AS DOUBLE)
UNION ALL SELECT 'accuracy.plain', count(*) FILTER (t = p) / CAST(count(*) AS DOUBLE) FROM x UNION ALL SELECT 'accuracy.tta', count(*) FILTER (t = g) / CAST(count(*) AS DOUBLE) FROM x
UNION ALL SELECT 'macro_f1.' || h, round(avg(f1), 9) FROM r GROUP BY h
UNION ALL SELECT 'precision.' || class, precision FROM r WHERE h = 'tta' UNION ALL SELECT 'recall.' || class, recall FROM r WHERE h = 'tta'""")
def deployed_color_report(spark, d):
    """Split, predictions with and without averaging, and the report of the test split, as one chain."""
    rows = table(spark, d, "embeddings").withColumn("true", F.concat(F.lit("class-"), (F.col("label") % 8).cast("string")))
    name = lambda values: F.concat(F.lit("class-"), (D.argmax(values) % 8).cast("string"))
    split = C.class_split(rows.select("vec_id", "true", name(_half(1)).alias("plain"), name(D.mean_of_two(_half(1), _half(33))).alias("tta")), "true", "vec_id")
    return E.color_report(split, _COLOR_CLASSES).select("metric", F.when(F.startswith("metric", F.lit("macro")), F.round("value", 9)).otherwise(F.col("value")).alias("value"))


_LINES = [("concat('30', substr(p_name, 1, 2), '-')", "0.5D", 2), ("CASE WHEN p_partkey % 3 = 0 THEN '--' WHEN p_partkey % 3 = 1 THEN '  ' ELSE 'A1' END", "0.7D", 1), ("cast(p_partkey as string)", "(p_partkey % 10) / 10D", 3)]


@query(r"""
WITH l AS (SELECT p_partkey, unnest([1, 2, 3]) AS y, unnest([CASE p_partkey % 3 WHEN 0 THEN '--' WHEN 1 THEN '  ' ELSE 'A1' END, '30' || substr(p_name, 1, 2) || '-', CAST(p_partkey AS VARCHAR)]) AS text, unnest([CAST(0.7 AS DOUBLE), CAST(0.5 AS DOUBLE), (p_partkey % 10) / CAST(10 AS DOUBLE)]) AS conf FROM part),
c AS (SELECT *, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS clean FROM l)
SELECT p_partkey, string_agg(clean, '' ORDER BY y) AS text, round(avg(conf) FILTER (trim(text) <> ''), 6) AS conf_raw, round(avg(conf) FILTER (clean <> ''), 6) AS conf_clean FROM c GROUP BY 1""")
def reader_lines(spark, d):
    """Lines of both readers: one counts those with any character, the other those with a letter or digit."""
    lines = F.expr("array(" + ", ".join(f"named_struct('text', {t}, 'conf', {c}, 'y_min', {y})" for t, c, y in _LINES) + ")")
    rows = table(spark, d, "part").select("p_partkey", D.lines_by_height(lines, raw=True).alias("r"), D.lines_by_height(lines).alias("c"))
    return rows.select("p_partkey", "r.text", F.round("r.conf", 6).alias("conf_raw"), F.round("c.conf", 6).alias("conf_clean"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE (l_partkey % 100) / CAST(100 AS DOUBLE) >= CASE WHEN l_orderkey % 3 = 0 THEN 0.6 ELSE 0.25 END GROUP BY 1")
def detector_threshold(spark, d):
    """Some calls bring a threshold of their own, which replaces the detector's."""
    from tallyline.operators import frames

    boxes = table(spark, d, "lineitem").selectExpr("l_orderkey", "(l_partkey % 100) / 100D AS conf", "CASE WHEN l_orderkey % 3 = 0 THEN 0.6D END AS override")
    return frames.detected(boxes, 0.25).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE p AS (SELECT p_partkey, i, i || substr(p_name, 1, 3) AS text, (p_partkey * (i + 3)) % 17 AS cx, ((p_partkey * (i + 1)) % 3) * 20 AS cy FROM part, range(6) parts(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY cy, i) AS j, (max(cy) OVER (PARTITION BY p_partkey) - min(cy) OVER (PARTITION BY p_partkey)) / CAST(3 AS DOUBLE) AS lim FROM p),
r(p_partkey, j, anchor, line) AS (SELECT p_partkey, j, cy, 0 FROM o WHERE j = 1
  UNION ALL SELECT o.p_partkey, o.j, CASE WHEN o.cy - r.anchor > lim THEN o.cy ELSE r.anchor END, r.line + CASE WHEN o.cy - r.anchor > lim THEN 1 ELSE 0 END FROM r JOIN o ON o.p_partkey = r.p_partkey AND o.j = r.j + 1)
SELECT p_partkey, string_agg(text, '' ORDER BY line, cx, i) AS text FROM r JOIN o USING (p_partkey, j) GROUP BY 1""")
def reading_order(spark, d):
    parts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.substring(F.col("p_name"), 1, 3).alias("text"), (F.pmod(F.col("p_partkey") * (i + 3), F.lit(17))).cast("double").alias("cx"), (F.pmod(F.col("p_partkey") * (i + 1), F.lit(3)) * 20).cast("double").alias("cy")))
    named = F.transform(parts, lambda p, i: F.struct(F.concat(i.cast("string"), p["text"]).alias("text"), p["cx"].alias("cx"), p["cy"].alias("cy")))
    return table(spark, d, "part").select("p_partkey", D.reading_order(named).alias("text"))


@query("SELECT p_partkey, CAST(length(p_name) + (SELECT count(*) FROM range(1, length(p_name)) t(i) WHERE substr(p_name, CAST(i AS INTEGER), 1) = substr(p_name, CAST(i + 1 AS INTEGER), 1)) AS INTEGER) AS steps FROM part")
def ctc_timesteps(spark, d):
    return table(spark, d, "part").select("p_partkey", D.ctc_timesteps(F.col("p_name")).cast("int").alias("steps"))


@query(I.GATE_REPLAY)
def stream_gate_replay(spark, d):
    from tallyline.streaming import gate

    return gate.replay(spark, gate.frames_of_events(table(spark, d, "events")), I.plate_registry(spark, d))


@query(I.LIFE_REPLAY)
def session_lifecycle_replay(spark, d):
    """Resets, passing generations and idle expiry, measured from completion."""
    from tallyline.streaming import gate

    return gate.replay(spark, gate.frames_of_events(table(spark, d, "events"), **I.LIFE_EXPR), I.plate_registry(spark, d), idle_ms=300_000)


@query(I.SINGLE_FLIGHT)
def single_flight_samples(spark, d):
    from tallyline.streaming import sessions

    return sessions.sampled(I.offers(spark, d))


def _reads(spark, d):
    first = W.partitionBy("user_id")
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), ((F.sqrt("event_id") - F.min(F.sqrt("event_id")).over(first)) / 40).alias("elapsed_s"))


@query(I.PACED)
def paced_frames(spark, d):
    from tallyline.streaming import sessions

    return sessions.paced(_reads(spark, d), 25, 0.5).select("session_id", "seq", "frame", "skipped")


@query(f"SELECT session_id, count(*) AS n_frames, count(*) FILTER (displayed) AS n_displayed, CAST(sum(hash) AS BIGINT) AS checksum FROM (SELECT session_id, f = frame AS displayed, f * seq % 1009 AS hash FROM (SELECT *, unnest(range(frame - skipped, frame + 1)) AS f FROM ({I.PACED}))) GROUP BY 1")
def paced_evidence(spark, d):
    """Skipped frames go on as evidence beside those displayed."""
    from tallyline.streaming import sessions

    rows = sessions.with_skipped(sessions.paced(_reads(spark, d), 25, 0.5), "session_id", "seq")
    return rows.groupBy("session_id").agg(F.count("*").alias("n_frames"), F.count_if("displayed").alias("n_displayed"), F.sum(F.col("frame") * F.col("seq") % 1009).alias("checksum"))


# frames


@query(f"SELECT session_id, CAST(least(2, coalesce(max(n) FILTER (p <> ''), 0)) AS INTEGER) AS votes, 2 AS target FROM (SELECT session_id, trim(plate_text) AS p, count(*) FILTER (plate_conf >= 0.5) AS n FROM ({I.PLATES}) GROUP BY 1, 2) GROUP BY 1")
def vote_progress(spark, d):
    from tallyline.operators import frames

    return frames.vote_progress(I.plates(spark, d))


@query("""
WITH e AS (SELECT *, event_type = 'purchase' AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, count(*) AS total, CAST(sum(event_id % 89 + 1) FILTER (n <= 100) AS DOUBLE) / count(*) FILTER (n <= 100) AS avg_ms, count(*) FILTER (s AND NOT coalesce(b, false) AND value > 50) AS alerts FROM e GROUP BY 1""")
def dashboard_kpis(spark, d):
    from tallyline.operators import frames

    rows = table(spark, d, "events").withColumn("ms", F.col("event_id") % 89 + 1).withColumn("state", F.when(F.col("event_type") == "purchase", "DECIDED").otherwise("IDLE"))
    return frames.kpis(rows, "user_id", "event_id", "ms", "state", F.col("value") > 50).select("user_id", "total", "avg_ms", "alerts")


@query("SELECT CAST(l_partkey % 9 AS INTEGER) AS cls, count(*) AS n FROM lineitem GROUP BY 1")
def class_histogram(spark, d):
    from tallyline.operators import frames

    return frames.class_histogram(table(spark, d, "lineitem").select((F.col("l_partkey") % 9).cast("int").alias("cls")))


@query("SELECT split, count(DISTINCT o_orderkey) AS images, count(l_orderkey) AS labels, count(DISTINCT l_orderkey) AS paired FROM (SELECT o_orderkey, o_orderstatus AS split FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def pair_inventory(spark, d):
    from tallyline.operators import frames

    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("stem"))
    labels = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem")).join(orders, "stem").select("split", "stem")
    return frames.inventory(orders, labels)


_FRAMES = "SELECT o_orderkey AS frame, CASE o_orderkey % 3 WHEN 0 THEN 'White' WHEN 1 THEN 'Red' ELSE 'Blue' END AS color, (o_orderkey % 100) / CAST(100 AS DOUBLE) AS color_conf FROM orders"


@query(f"""
WITH v AS (SELECT l_orderkey AS frame, l_linenumber AS o, l_partkey AS pk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS n FROM lineitem WHERE l_partkey % 9 IN (2, 5, 7)),
c AS (SELECT frame, o FROM v WHERE n = 1),
q AS (SELECT l.l_orderkey AS frame, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_linenumber END AS vo, l_discount AS conf, l_linenumber AS o, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE CAST(l_suppkey * 3 AS VARCHAR) END AS plate, l_partkey AS pk FROM lineitem l),
r AS (SELECT * FROM (SELECT q.frame, q.plate, row_number() OVER (PARTITION BY q.frame ORDER BY q.conf DESC, q.o, q.pk) AS n FROM q LEFT JOIN c ON c.frame = q.frame WHERE q.vo IS NOT DISTINCT FROM c.o) WHERE n = 1)
SELECT f.frame, CASE WHEN coalesce(r.plate, '') = '' THEN 'NO_PLATE' WHEN g.license_plate IS NULL THEN 'UNREGISTERED' ELSE 'AUTHORIZED' END AS status,
  CASE WHEN coalesce(r.plate, '') = '' THEN 'LOG' WHEN g.license_plate IS NULL THEN 'DENY_ALERT' WHEN upper(f.color) = g.car_color OR (upper(f.color) IN {I.NEUTRAL} AND g.car_color IN {I.NEUTRAL}) OR f.color_conf < 0.4 THEN 'ALLOW' ELSE 'ALLOW_WARN' END AS action
FROM ({_FRAMES}) f LEFT JOIN r ON r.frame = f.frame LEFT JOIN ({I.REGISTRY}) g ON g.license_plate = r.plate""")
def single_frame_verdict(spark, d):
    from tallyline.operators import frames

    items = table(spark, d, "lineitem")
    shot = table(spark, d, "orders").selectExpr("o_orderkey AS frame", "CASE o_orderkey % 3 WHEN 0 THEN 'White' WHEN 1 THEN 'Red' ELSE 'Blue' END AS color", "(o_orderkey % 100) / 100D AS color_conf")
    order = "struct(l_linenumber, l_partkey, l_suppkey) AS det_ord"
    vehicles = items.selectExpr("l_orderkey AS frame", order, "l_partkey % 9 AS cls", "l_quantity AS area", "l_linenumber")
    # vehicles are named by their line, as plates refer to it
    named = C.top_per_group(vehicles.filter("cls IN (2, 5, 7)"), ["frame"], [F.desc("area"), F.asc("det_ord")]).select("frame", F.col("l_linenumber").cast("long").alias("det_ord"), "cls", "area")
    plates = items.selectExpr("l_orderkey AS frame", "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS vehicle_ord", order, "l_discount AS conf", "CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE CAST(l_suppkey * 3 AS STRING) END AS plate_text")
    return frames.single_frame(shot, named, plates, I.registry(spark, d)).select("frame", "status", "action")


# chains

_FOUND_SQL = f"""
WITH b AS ({I.BOXES}), k AS ({I.RESERVED}), lab AS (SELECT DISTINCT label FROM k WHERE label <> ''), own AS (SELECT DISTINCT label FROM b WHERE label IS NOT NULL),
near AS (SELECT own.label, min(CASE WHEN own.label = lab.label THEN 0 ELSE 1 END) AS near FROM own, lab
  WHERE own.label = lab.label OR ((starts_with(own.label, lab.label) AND length(lab.label) >= {{guard}}) OR (starts_with(lab.label, own.label) AND length(own.label) >= {{guard}})) OR levenshtein(own.label, lab.label) <= 1 GROUP BY 1),
px AS (SELECT b.*, c - a AS w, e - t AS h, c > a AND e > t AS ok, near, source_sha256 IN (SELECT source_sha256 FROM k WHERE source_sha256 <> '') AS rs, crop_sha256 IN (SELECT crop_sha256 FROM k WHERE crop_sha256 <> '') AS rc
  FROM (SELECT *, CAST(greatest(0, least(width, round_even((cx - bw / 2) * width, 0))) AS INTEGER) AS a, CAST(greatest(0, least(height, round_even((cy - bh / 2) * height, 0))) AS INTEGER) AS t,
    CAST(greatest(0, least(width, round_even((cx + bw / 2) * width, 0))) AS INTEGER) AS c, CAST(greatest(0, least(height, round_even((cy + bh / 2) * height, 0))) AS INTEGER) AS e FROM b) b LEFT JOIN near ON near.label = b.label),
judged AS (SELECT *, CASE WHEN image LIKE '%Gen%' THEN 'excluded-source' WHEN rs THEN 'reserved-source-hash' WHEN height IS NULL THEN 'unreadable' WHEN NOT ok OR {{wrong}} THEN '{{shape}}' WHEN kind = 0 THEN 'unreadable' WHEN label IS NULL THEN 'invalid-format'
  WHEN near = 0 THEN 'reserved-label' WHEN near = 1 THEN '{{near}}' WHEN rc THEN 'reserved-crop-hash' ELSE 'kept' END AS reason FROM px)"""
_PSEUDO_SQL = _FOUND_SQL.format(guard=1, wrong="h < 24", shape="too-small", near="reserved-label")
_CAR_SQL = _FOUND_SQL.format(guard=5, wrong="least(w, h) < 20 OR w / CAST(h AS DOUBLE) < 2.2", shape="low-aspect", near="near-reserved-label")
_NAME_SQL = "'{p}_' || substr(source_sha256, 1, 16) || '_' || substr(sha256(rel_path), 1, 12) || '_' || printf('%02d', box_index) || '.jpg'"


@query(f"{_PSEUDO_SQL} SELECT reason, count(*) AS n FROM judged GROUP BY 1")
def pseudo_label_funnel(spark, d):
    return H.funnel_counts(H.pseudo_labels(I.boxes(spark, d), I.reserved(spark, d)))


@query(f"""
{_PSEUDO_SQL} SELECT 'images/' || {_NAME_SQL.format(p="pseudo")} AS image_path, label, 'source:' || substr(sha256(split_part(regexp_replace(image, '\\.[^.]*$', ''), '.rf.', 1)), 1, 16) AS group_id, source_sha256, ocr_confidence FROM judged WHERE reason = 'kept'""")
def pseudo_label_manifest(spark, d):
    return H.pseudo_manifest(H.pseudo_labels(I.boxes(spark, d), I.reserved(spark, d))).select("image_path", "label", "group_id", "source_sha256", "ocr_confidence")


@query(f"""
WITH RECURSIVE m AS ({_PSEUDO_SQL} SELECT 'images/' || {_NAME_SQL.format(p="pseudo")} AS image_path, ocr_confidence, CASE WHEN ocr_confidence >= 1 THEN 10 ELSE CAST(floor(ocr_confidence * 10) AS INTEGER) END AS i FROM judged WHERE reason = 'kept'),
n AS (SELECT CAST(b.i AS INTEGER) AS i, CASE WHEN b.i = 10 THEN '1.0' ELSE printf('%.1f-%.1f', b.i / 10.0, (b.i + 1) / 10.0) END AS band, count(m.i) AS n FROM range(11) b(i) LEFT JOIN m ON m.i = b.i GROUP BY b.i),
r(i, g, total) AS (SELECT i, 1, n FROM n WHERE i = 0 UNION ALL SELECT n.i, CASE WHEN r.total < 10 THEN r.g ELSE r.g + 1 END, CASE WHEN r.total < 10 THEN r.total + n.n ELSE n.n END FROM r JOIN n ON n.i = r.i + 1),
j AS (SELECT i, string_agg(band, '+') OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS band FROM r JOIN n USING (i)),
s AS (SELECT * FROM (SELECT m.*, j.band, row_number() OVER (PARTITION BY j.band ORDER BY sha256('{H.AUDIT_SEED}:' || image_path), image_path) AS k FROM m JOIN j USING (i)) WHERE k <= 30),
o AS (SELECT *, row_number() OVER (ORDER BY i, ocr_confidence, image_path) - 1 AS place FROM s)
SELECT CAST(place // 30 + 1 AS INTEGER) AS sheet, CAST(place + 1 AS INTEGER) AS cell, image_path, ocr_confidence, band FROM o""")
def pseudo_label_audit(spark, d):
    return H.audit(H.pseudo_manifest(H.pseudo_labels(I.boxes(spark, d), I.reserved(spark, d))))


@query(f"{_CAR_SQL} SELECT reason, count(*) AS n FROM judged GROUP BY 1")
def car_review_funnel(spark, d):
    return H.funnel_counts(H.car_boxes(I.boxes(spark, d), I.reserved(spark, d)))


@query(f"""
{_CAR_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY label, source_sha256 ORDER BY ocr_confidence DESC, crop_sha256) AS n FROM (SELECT DISTINCT ON (label, source_sha256, crop_sha256) * FROM judged WHERE reason = 'kept'))
SELECT {_NAME_SQL.format(p="car")} AS crop_name, label AS label_draft, ocr_confidence, '[' || a || ',' || t || ',' || c || ',' || e || ']' AS box_json, w / CAST(h AS DOUBLE) AS aspect_ratio
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n > 1, ocr_confidence DESC, source_sha256, crop_sha256) AS k FROM s) WHERE k <= 3""")
def car_review_export(spark, d):
    return H.review(H.car_boxes(I.boxes(spark, d), I.reserved(spark, d))).select("crop_name", "label_draft", "ocr_confidence", "box_json", "aspect_ratio")


_EXTERNAL_SQL = f"""
WITH k AS ({I.RESERVED}), lab AS (SELECT DISTINCT label FROM k WHERE label <> ''),
b AS (SELECT *, least(a + 8 * (1 + box_index % 40), width) - a AS w, least(t + 4 * (1 + box_index % 30), height) - t AS h FROM (SELECT *, CAST(box_index % 600 AS INTEGER) AS a, CAST(box_index % 450 AS INTEGER) AS t FROM ({I.BOXES}))),
near AS (SELECT own.label, min(CASE WHEN own.label = lab.label THEN 0 ELSE 1 END) AS near FROM (SELECT DISTINCT label FROM b WHERE label IS NOT NULL) own, lab WHERE own.label = lab.label OR levenshtein(own.label, lab.label) <= 1 OR starts_with(own.label, lab.label) OR starts_with(lab.label, own.label) GROUP BY 1),
judged AS (SELECT *, CASE WHEN source_sha256 IN (SELECT source_sha256 FROM k WHERE source_sha256 <> '') THEN 'reserved-source-hash' WHEN height IS NULL OR w <= 0 OR h <= 0 OR least(w, h) < 20 OR w / CAST(h AS DOUBLE) < 2.2 THEN 'low-aspect' WHEN kind = 0 THEN 'unreadable'
  WHEN b.label IS NULL THEN 'invalid-format' WHEN near = 0 THEN 'reserved-label' WHEN near = 1 THEN 'near-reserved-label' WHEN crop_sha256 IN (SELECT crop_sha256 FROM k WHERE crop_sha256 <> '') THEN 'reserved-crop-hash' ELSE 'kept' END AS reason FROM b LEFT JOIN near ON near.label = b.label)"""


def _external(spark, d):
    rows = I.boxes(spark, d)
    left, top = F.pmod("box_index", F.lit(600)), F.pmod("box_index", F.lit(450))
    found = rows.select("rel_path", "box_index", "parts", "crop_sha256", left.alias("x1"), top.alias("y1"), (left + 8 * (1 + F.pmod("box_index", F.lit(40)))).alias("x2"), (top + 4 * (1 + F.pmod("box_index", F.lit(30)))).alias("y2"), (F.pmod("box_index", F.lit(100)) / 100).alias("conf"))
    return H.car_boxes(H.external_boxes(I.images(spark, d), found), I.reserved(spark, d), detector=True)


@query(f"{_EXTERNAL_SQL} SELECT reason, CASE WHEN reason = 'reserved-source-hash' THEN count(DISTINCT rel_path) ELSE count(*) END AS n FROM judged GROUP BY 1")
def external_review_funnel(spark, d):
    return H.funnel_counts(_external(spark, d), per_image=True)


@query(f"""
{_EXTERNAL_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY label, source_sha256 ORDER BY ocr_confidence DESC, crop_sha256) AS n FROM (SELECT DISTINCT ON (label, source_sha256, crop_sha256) * FROM judged WHERE reason = 'kept'))
SELECT {_NAME_SQL.format(p="car")} AS crop_name, label AS label_draft, printf('detector:%.4f', (box_index % 100) / CAST(100 AS DOUBLE)) AS filter_notes
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n > 1, ocr_confidence DESC, source_sha256, crop_sha256) AS k FROM s) WHERE k <= 3""")
def external_review_export(spark, d):
    return H.review(_external(spark, d), notes=F.col("filter_notes")).select("crop_name", "label_draft", "filter_notes")


@query(f"""
{_PSEUDO_SQL}, f AS (SELECT *, split_part(regexp_replace(image, '\\.[^.]*$', ''), '.rf.', 1) AS stem FROM judged WHERE ok AND image NOT LIKE '%Gen%' AND NOT rs),
g AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY (w >= 80 AND h >= 24) DESC, focus DESC, w * h DESC, rel_path DESC, box_index) AS n FROM f)
SELECT printf('candidate-%04d', row_number() OVER (ORDER BY (w >= 80 AND h >= 24) DESC, focus DESC, w * h DESC, rel_path DESC, box_index) - 1) AS candidate_id, 'det:' || stem AS group_id, w AS crop_width, h AS crop_height
FROM g WHERE n = 1 AND NOT rc QUALIFY row_number() OVER (ORDER BY (w >= 80 AND h >= 24) DESC, focus DESC, w * h DESC, rel_path DESC, box_index) <= 400""")
def review_candidates(spark, d):
    return H.review_candidates(I.boxes(spark, d), I.reserved(spark, d), ("*Gen*",)).select("candidate_id", "group_id", "crop_width", "crop_height")


@query("""
WITH RECURSIVE p AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'web_' ELSE 'own_' END || vec_id AS name, label, vec_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) AS seen,
  list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS h FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY name) AS n FROM p WHERE seen),
r(label, n, name, kept, held) AS (SELECT label, n, name, true, [h] FROM o WHERE n = 1
  UNION ALL SELECT label, n, name, ok, CASE WHEN ok THEN list_append(held, h) ELSE held END FROM (SELECT o.*, r.held, len(list_filter(r.held, lambda x: hamming(x, o.h) <= 14)) = 0 AS ok FROM r JOIN o ON o.label = r.label AND o.n = r.n + 1)),
c AS (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN starts_with(name, 'own_') THEN 0 ELSE 1 END, name) AS k FROM r WHERE kept),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || name), name) AS pos, round_even(count(*) OVER (PARTITION BY label) * CAST(0.15 AS DOUBLE), 0) AS t FROM c WHERE k <= 20)
SELECT name, label, CASE WHEN pos <= t THEN 'test' WHEN pos <= 2 * t THEN 'val' ELSE 'train' END AS fate FROM f
UNION ALL SELECT name, label, 'no-vehicle' FROM p WHERE NOT seen UNION ALL SELECT name, label, 'near-duplicate' FROM r WHERE NOT kept UNION ALL SELECT name, label, 'overflow' FROM c WHERE k > 20""")
def curation_chain(spark, d):
    bits = F.aggregate(F.slice("embedding", 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), "label", bits.alias("phash"), "vec_id")
    name = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "web_").otherwise("own_"), F.col("l_orderkey").cast("string"))
    vehicles = table(spark, d, "lineitem").filter("l_quantity > 30").select(name.alias("name"))
    parts = {"web": rows.filter("vec_id % 2 = 0").drop("vec_id"), "own": rows.filter("vec_id % 2 = 1").drop("vec_id")}
    return H.curate_images(parts, vehicles, 20, ["own_"], 14)
