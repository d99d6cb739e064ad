"""The engine's tables made from the shared test tables, each as a DataFrame and as SQL.

reading = event (user -> plate key, type -> colour, event_id -> order); registry = customers, two of three; manifest = documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the names that differ between the engines
_SPARK, _DUCK = {"s": "string", "sha": "sha2", "bits": ", 256"}, {"s": "VARCHAR", "sha": "sha256", "bits": ""}

# The colour that an event type or a market segment stands for.
TYPE_COLOR = {"click": "Black", "error": "Red", "purchase": "White", "signup": "Blue", "view": "Silver"}
SEGMENT_COLOR = {"AUTOMOBILE": "WHITE", "BUILDING": "RED", "FURNITURE": "BLACK", "HOUSEHOLD": "BLUE", "MACHINERY": "YELLOW"}


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


READINGS_EXPR = {
    "event_id": "event_id",
    "session_id": "concat('gate-', lpad(cast(user_id as {s}), 6, '0'))",
    "seq": "event_id",
    "plate_text": "concat(cast(user_id as {s}), CASE WHEN event_id % 5 = 0 THEN '-' ELSE '' END)",
    "color": _case("event_type", TYPE_COLOR),
    "color_conf": "CASE WHEN event_id % 10 = 3 THEN NULL ELSE (event_id % 100) / cast(100 as double) END",
}
REGISTRY_EXPR = {"license_plate": "cast(c_custkey as {s})", "car_color": _case("c_mktsegment", SEGMENT_COLOR), "row_ord": "c_custkey"}
# near-duplicate plate readings: one digit of some readings is misread, some are blank, some short
PLATES_EXPR = {
    "session_id": "cast(user_id as {s})",
    "seq": "event_id",
    "plate_text": "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '30K' ELSE concat('30A-', lpad(cast(10000 + (user_id * 37 + CASE WHEN event_id % 7 = 0 THEN event_id % 10 ELSE 0 END) % 80000 as {s}), 5, '0')) END",
    "plate_conf": "(event_id % 100) / cast(100 as double)",
    "color": _case("event_type", TYPE_COLOR),
    "color_conf": "((event_id * 7) % 100) / cast(100 as double)",
}


# boxes of images with what a reader found in them: nothing, no plate, a plate beside a mark, or a plate in two parts
_DIGITS = "lpad(cast(10000 + ({k} * 13) % 80000 as {{s}}), 5, '0')"
_CONF = "(l_partkey * 7 % 101) / cast(100 as double)"
_IMAGE = "concat('car', cast(l_orderkey as {s}), CASE WHEN l_orderkey % 11 = 4 THEN '_Gen' ELSE '' END, CASE WHEN l_orderkey % 10 = 3 THEN '.rf.1' ELSE '' END, '.jpg')"
BOXES_EXPR = {
    "image": _IMAGE,
    "rel_path": f"concat('set/', {_IMAGE})",
    "source_sha256": "{sha}(concat('src', cast(l_orderkey % 20011 as {s})){bits})",
    "width": "640",
    "height": "CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE 480 END",
    "box_index": "cast(l_linenumber as bigint) * 100000000 + l_partkey * 100 + l_suppkey % 100",
    "cx": "(l_partkey % 64) / cast(64 as double)",
    "cy": "(l_suppkey % 32) / cast(32 as double)",
    "bw": "(1 + (l_partkey * 3) % 50) / cast(64 as double)",
    "bh": "l_linenumber / cast(32 as double)",
    "crop_sha256": "{sha}(concat('crop', cast(l_partkey as {s}), ':', cast(l_linenumber as {s})){bits})",
    "focus": "cast((l_partkey * 31) % 1009 as double)",
    "kind": "l_partkey % 7",
}
_FULL = f"concat('30A', {_DIGITS.format(k='l_partkey')})"
#: what the reader's parts come to
FOUND_EXPR = {
    "label": f"CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE {_FULL} END",
    "ocr_confidence": f"CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN {_CONF} ELSE least({_CONF}, cast(0.97 as double)) END",
}
_PART = "named_struct('text', {t}, 'conf', {c}, 'y', {y})"
PARTS = f"""CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN array({_PART.format(t="'x'", c="0.5D", y="0.1D")})
  WHEN 2 THEN array({_PART.format(t=_FULL, c=_CONF, y="0.2D")}, {_PART.format(t="'zz!'", c="0.4D", y="0.7D")})
  ELSE array({_PART.format(t=_DIGITS.format(k="l_partkey"), c="0.97D", y="0.2D")}, {_PART.format(t="'30a-'", c=_CONF, y="0.8D")}) END"""
RESERVED_EXPR = {
    "label": f"CASE WHEN p_partkey % 97 = 5 THEN concat('30A', {_DIGITS.format(k='p_partkey')}, CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '' END) ELSE '' END",
    "source_sha256": "CASE WHEN p_partkey % 97 = 5 THEN {sha}(concat('src', cast(p_partkey * 7 as {s})){bits}) ELSE NULL END",
    "crop_sha256": "CASE WHEN p_partkey % 89 = 4 THEN {sha}(concat('crop', cast(p_partkey as {s}), ':3'){bits}) ELSE NULL END",
}


def _sql(exprs: dict[str, str], source: str, where: str = "") -> str:
    return "SELECT " + ", ".join(f"{v.format(**_DUCK)} AS {k}" for k, v in exprs.items()) + f" FROM {source} {where}"


def _df(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{v.format(**_SPARK)} AS {k}" for k, v in exprs.items()])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _df(table(spark, sf_dir, "events"), READINGS_EXPR)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _df(table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0"), REGISTRY_EXPR)


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _df(table(spark, sf_dir, "events"), PLATES_EXPR)


def plate_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of users that are customers of the registry."""
    rows = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    return rows.select(F.concat(F.lit("30A"), F.lpad((10000 + (F.col("c_custkey") * 37) % 80000).cast("string"), 5, "0")).alias("license_plate"), F.expr(REGISTRY_EXPR["car_color"]).alias("car_color"), F.col("c_custkey").alias("row_ord"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of the images that orders stand for, each once.

    Equal boxes are those of equal keys, as far as a box shows them, so that only keys are shuffled. 800 is the least that 100 and 32, the
    shares of l_suppkey in a box, divide.
    """
    keys = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey % 800 AS l_suppkey", "l_linenumber").distinct()
    return _df(keys, BOXES_EXPR | {"parts": PARTS}).drop("kind")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the boxes, each once."""
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return _df(orders, {k: BOXES_EXPR[k] for k in ("image", "rel_path", "source_sha256", "width", "height")})


def reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _df(table(spark, sf_dir, "part").filter("p_partkey % 97 = 5 OR p_partkey % 89 = 4"), RESERVED_EXPR)


BOXES = _sql(BOXES_EXPR | FOUND_EXPR, "lineitem").replace("SELECT", "SELECT DISTINCT", 1)
RESERVED = _sql(RESERVED_EXPR, "part", "WHERE p_partkey % 97 = 5 OR p_partkey % 89 = 4")
READINGS = _sql(READINGS_EXPR, "events")
REGISTRY = _sql(REGISTRY_EXPR, "customer", "WHERE c_custkey % 3 <> 0")
PLATES = _sql(PLATES_EXPR, "events")
NEUTRAL = "('BLACK', 'GREY', 'SILVER', 'WHITE')"
VERIFIED = f"""
  SELECT r.event_id, r.plate_text, r.color, r.color_conf, g.car_color AS registered,
    CASE WHEN g.license_plate IS NULL THEN 'UNREGISTERED' ELSE 'AUTHORIZED' END AS status,
    CASE WHEN g.license_plate IS NULL THEN 'DENY_ALERT'
         WHEN upper(r.color) = g.car_color OR (upper(r.color) IN {NEUTRAL} AND g.car_color IN {NEUTRAL}) THEN 'ALLOW'
         WHEN r.color_conf IS NOT NULL AND r.color_conf < 0.4 THEN 'ALLOW' ELSE 'ALLOW_WARN' END AS action
  FROM ({READINGS}) r LEFT JOIN ({REGISTRY}) g ON replace(r.plate_text, '-', '') = g.license_plate
"""
PLATE_REGISTRY = f"""
  SELECT license_plate AS key, arg_min(car_color, row_ord) AS listed FROM (
    SELECT '30A' || lpad(cast(10000 + (c_custkey * 37) % 80000 AS VARCHAR), 5, '0') AS license_plate, {REGISTRY_EXPR["car_color"]} AS car_color, c_custkey AS row_ord FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1
"""


def vote_sql(evidence: str) -> str:
    """CTEs whose last, `voted` (k, plate, color, n_frames, status, action, color_warning, agree), is the vote on evidence (k, seq, plate_text, plate_conf, color, color_conf, soft); start them with WITH RECURSIVE."""
    return rf"""
reg AS ({PLATE_REGISTRY}),
ev AS ({evidence}),
fit AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{5,6}}') THEN x END AS e FROM (SELECT *, upper(regexp_replace(coalesce(plate_text, ''), '[^A-Za-z0-9]', '', 'g')) AS x FROM ev)),
tier(t, least) AS (VALUES (1, 0.5), (2, 0.4), (3, 0.85)),
fr AS (SELECT k, t, e, seq, coalesce(plate_conf, 0) AS c, upper(trim(coalesce(color, ''))) AS u, coalesce(color_conf, 0) AS uc FROM fit JOIN tier ON coalesce(plate_conf, 0) >= least AND (t = 1 OR soft) WHERE e IS NOT NULL),
v AS (SELECT k, t, e, count(*) AS n, fsum(c) AS c, max(c) AS m, min(seq) AS f FROM fr GROUP BY ALL),
pr AS (SELECT a.k, a.t, a.e AS a, b.e AS b, b.n FROM v a JOIN v b ON a.k = b.k AND a.t = b.t AND levenshtein(a.e, b.e) <= 1),
r AS (SELECT k, t, a AS node, a AS seen FROM pr UNION SELECT r.k, r.t, r.node, pr.b FROM r JOIN pr ON r.k = pr.k AND r.t = pr.t AND r.seen = pr.a),
cl AS (SELECT k, t, node AS e, min(seen) AS root FROM r GROUP BY ALL),
sup AS (SELECT k, t, a AS e, sum(n) AS s FROM pr GROUP BY ALL),
w AS (SELECT v.*, cl.root, sup.s, reg.key IS NOT NULL AS known FROM v JOIN cl USING (k, t, e) JOIN sup USING (k, t, e) LEFT JOIN reg ON reg.key = v.e),
c AS (SELECT k, t, root, sum(n) AS n, max(m) AS m, first(e ORDER BY s DESC, c DESC, n DESC, e DESC) AS rep, first(e ORDER BY s DESC, c DESC, n DESC, e DESC) FILTER (known) AS own FROM w GROUP BY ALL),
cc AS (SELECT c.*, z.c FROM c JOIN (SELECT k, t, root, fsum(c) AS c FROM fr JOIN cl USING (k, t, e) GROUP BY ALL) z USING (k, t, root)),
chosen AS (SELECT k, t, root, coalesce(own, rep) AS plate FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, CASE WHEN t < 3 THEN n ELSE m END DESC, c DESC, rep DESC) AS i FROM cc WHERE t = 3 OR n >= 2) WHERE i = 1),
rows_of AS (SELECT h.k, fr.u, fr.uc, v.f, fr.seq FROM chosen h JOIN cl USING (k, t, root) JOIN fr USING (k, t, e) JOIN v USING (k, t, e) WHERE h.t < 3 OR e = h.plate),
top AS (SELECT k, u FROM (SELECT k, u, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(CAST(f AS HUGEINT) * 1000000000000 + seq)) AS i FROM rows_of WHERE u <> '' GROUP BY k, u) WHERE i = 1),
shade AS (SELECT rows_of.k, coalesce(top.u, '') AS color, fsum(uc) / count(*) AS conf FROM rows_of LEFT JOIN top ON top.k = rows_of.k WHERE rows_of.u = coalesce(top.u, '') GROUP BY ALL),
agree AS (SELECT h.k, count(*) AS agree FROM chosen h JOIN fit USING (k) WHERE levenshtein(fit.e, h.plate) <= 1 GROUP BY 1),
voted AS (
  SELECT s.k, coalesce(h.plate, '') AS plate, coalesce(shade.color, '') AS color, s.n_frames,
    CASE WHEN blank THEN 'NO_PLATE' WHEN h.plate IS NULL THEN 'UNCERTAIN' WHEN listed IS NULL THEN 'UNREGISTERED' ELSE 'AUTHORIZED' END AS status,
    CASE WHEN h.plate IS NULL THEN 'LOG' WHEN listed IS NULL THEN 'DENY_ALERT' WHEN same OR conf < 0.4 THEN 'ALLOW' ELSE 'ALLOW_WARN' END AS action,
    h.plate IS NOT NULL AND listed IS NOT NULL AND NOT (same OR conf < 0.4) AS color_warning, coalesce(agree, 0) AS agree
  FROM (SELECT k, CAST(count(*) AS INTEGER) AS n_frames, bool_and(trim(coalesce(plate_text, '')) = '') AS blank FROM ev GROUP BY 1) s LEFT JOIN chosen h ON h.k = s.k LEFT JOIN shade ON shade.k = s.k LEFT JOIN agree ON agree.k = s.k
  LEFT JOIN (SELECT key, listed FROM reg) g ON g.key = h.plate, LATERAL (SELECT color = listed OR (color IN {NEUTRAL} AND listed IN {NEUTRAL}) AS same)
)"""


LOCK_VOTE = f"WITH RECURSIVE {vote_sql(f'SELECT *, session_id AS k, true AS soft FROM ({PLATES}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 50')} SELECT k AS session_id, plate, color, n_frames, status, action, color_warning FROM voted"
#: what sessions live through besides frames: resets, generations that pass, older ones that come late, and idle times
LIFE_EXPR = {
    "kind": "CASE WHEN event_id % 37 = 5 THEN 'reset' ELSE 'frame' END",
    "generation": "cast(CASE WHEN event_id % 23 = 4 THEN 0 ELSE floor(sqrt(event_id) / 20) END as int)",
    "arrived_ms": "cast(floor(sqrt(event_id) * 100000) as bigint)",
    "done_ms": "cast(floor(sqrt(event_id) * 100000) as bigint) + event_id % 7 * 1000",
}
#: requests of a sampler: offers, completions and resets, about 100 ms apart
OFFERS_EXPR = {
    "session_id": "cast(user_id as {s})",
    "seq": "event_id",
    "t_ms": "sqrt(event_id) * 100",
    "kind": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'done' WHEN event_id % 31 = 3 THEN 'reset' ELSE 'offer' END",
}
OFFERS = _sql(OFFERS_EXPR, "events")
_PLAIN = f"SELECT p.*, p.session_id AS own, e.value < 300 AS target, CAST(event_id AS DOUBLE) / 10 AS source_time_s FROM ({PLATES}) p JOIN events e ON e.event_id = p.seq"
_LIVED = f"""
SELECT * REPLACE (own || '|' || life || '|' || epoch AS session_id) FROM (
  SELECT *, sum(CASE WHEN kind = 'reset' OR generation > before THEN 1 ELSE 0 END) OVER (PARTITION BY own, life ORDER BY seq) AS epoch FROM (
    SELECT *, greatest(0, coalesce(max(generation) OVER (PARTITION BY own, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM (
      SELECT *, sum(CASE WHEN arrived_ms - previous >= 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY own ORDER BY seq) AS life FROM (
        SELECT f.*, x.* EXCLUDE (id), lag(done_ms) OVER (PARTITION BY own ORDER BY seq) AS previous FROM ({_PLAIN}) f JOIN ({_sql({"id": "event_id", **LIFE_EXPR}, "events")}) x ON x.id = f.seq)))
  WHERE generation >= before) WHERE kind = 'frame'
"""
_WINDOWS = """
SELECT f.session_id || ':' || f.seq AS k, g.seq, g.plate_text, g.plate_conf, g.color, g.color_conf, f.run - 2 >= 10 AS soft FROM frames f JOIN frames g
  ON f.session_id = g.session_id AND f.island IS NOT DISTINCT FROM g.island AND f.run >= 3 AND g.run BETWEEN greatest(3, f.run - 49) AND f.run
"""


def gate_sql(frames: str) -> str:
    """The replay of frames (session_id, which tells stays apart; own, the id to show; seq, ...): every frame is voted on with its own window of
    evidence, and the first that the guard or the time-out lets through decides its stay."""
    islands = f"SELECT *, max(CASE WHEN NOT target THEN seq END) OVER (PARTITION BY session_id ORDER BY seq) AS island FROM ({frames})"
    return f"""
WITH RECURSIVE frames AS (SELECT *, CASE WHEN target THEN CAST(row_number() OVER (PARTITION BY session_id, island, target ORDER BY seq) AS INTEGER) ELSE 0 END AS run FROM ({islands})),
{vote_sql(_WINDOWS)},
decided AS (
  SELECT session_id, island, min(run) AS run FROM frames JOIN voted ON voted.k = session_id || ':' || seq WHERE (status IN ('AUTHORIZED', 'UNREGISTERED') AND agree >= 2) OR run - 2 >= 300 GROUP BY 1, 2
),
d AS (SELECT x.session_id, x.island, x.run, f.source_time_s AS at, CASE WHEN v.status = 'NO_PLATE' THEN 'UNCERTAIN' ELSE v.status END AS status, v.action, v.plate, v.color_warning FROM decided x JOIN frames f ON f.session_id = x.session_id AND f.island IS NOT DISTINCT FROM x.island AND f.run = x.run JOIN voted v ON v.k = f.session_id || ':' || f.seq)
SELECT f.own AS session_id, f.seq, CASE WHEN NOT target THEN 'IDLE' WHEN f.run < 3 THEN 'TRACKING' WHEN f.run >= d.run THEN 'DECIDED' ELSE 'READY_TO_DECIDE' END AS state,
  CAST(CASE WHEN f.run >= d.run THEN d.run ELSE f.run END AS INTEGER) AS run, CAST(greatest(0, CASE WHEN f.run >= d.run THEN d.run ELSE f.run END - 2) AS INTEGER) AS ready,
  CASE WHEN f.run >= d.run THEN d.status END AS status, CASE WHEN f.run >= d.run THEN d.action END AS action, CASE WHEN f.run >= d.run THEN d.plate END AS plate, coalesce(f.run >= d.run AND d.color_warning, false) AS color_warning,
  CASE WHEN f.run >= d.run THEN d.at END AS decided_at
FROM frames f LEFT JOIN d ON target AND d.session_id = f.session_id AND d.island IS NOT DISTINCT FROM f.island
"""


GATE_REPLAY, LIFE_REPLAY = gate_sql(_PLAIN), gate_sql(_LIVED)
SINGLE_FLIGHT = f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ({OFFERS})),
r(session_id, n, busy, waiting, waiting_ms, last_ms, offer_seq, sent_seq, offered_ms, sent_ms) AS (
  SELECT session_id, CAST(0 AS BIGINT), false, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT session_id FROM o)
  UNION ALL
  SELECT session_id, n, CASE kind WHEN 'done' THEN busy AND waiting IS NOT NULL WHEN 'reset' THEN false ELSE busy OR fits END,
    CASE WHEN kind <> 'offer' THEN NULL WHEN fits AND busy THEN seq ELSE waiting END, CASE WHEN kind <> 'offer' THEN NULL WHEN fits AND busy THEN t_ms ELSE waiting_ms END,
    CASE WHEN kind = 'reset' THEN NULL WHEN kind = 'offer' AND fits THEN t_ms ELSE last_ms END,
    CASE WHEN sends AND kind = 'offer' THEN seq WHEN sends THEN waiting END, CASE WHEN sends THEN seq END, CASE WHEN sends AND kind = 'offer' THEN t_ms WHEN sends THEN waiting_ms END, CASE WHEN sends THEN t_ms END
  FROM (SELECT *, (kind = 'offer' AND fits AND NOT busy) OR (kind = 'done' AND busy AND waiting IS NOT NULL) AS sends FROM (
    SELECT o.*, r.busy, r.waiting, r.waiting_ms, r.last_ms, r.last_ms IS NULL OR o.t_ms - r.last_ms >= 100 AS fits FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1)))
SELECT session_id, offer_seq, sent_seq, offered_ms, sent_ms FROM r WHERE sent_seq IS NOT NULL
"""
PACED = """
SELECT session_id, seq, frame, frame - coalesce(lag(frame) OVER (PARTITION BY session_id ORDER BY seq), -1) - 1 AS skipped FROM (
  SELECT session_id, seq, CAST(i + greatest(0, max(CAST(floor(greatest(0, elapsed_s - 0.5) * 25) AS BIGINT) - i) OVER (PARTITION BY session_id ORDER BY seq)) AS BIGINT) AS frame FROM (
    SELECT user_id AS session_id, event_id AS seq, (sqrt(event_id) - min(sqrt(event_id)) OVER (PARTITION BY user_id)) / 40 AS elapsed_s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events))
"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _df(table(spark, sf_dir, "events"), OFFERS_EXPR)
