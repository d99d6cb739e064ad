"""Secret scans over an incremental, content-addressed blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A ledger row is (blob, rules_version, spans): a pair
that is in the ledger isn't scanned again, and findings join back from blobs to all the paths and versions that hold them.

Positions come from split(): the pieces between matches and the matches themselves alternate, so a running sum of their
lengths (code points) gives start and end of each. A text is read once for all rules.

Defined cases: a null text is the empty text; copies of a text share one scan; matches whose group is too short are dropped
after matching, as they still take up their characters; an empty table gives no rows; a text without findings keeps an
empty span list; ids play no part but in op4's query, where they may be of any type; columns of the input are kept, but that findings() replaces those named blob and spans.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm.common import clash_free, table, text_of, written


@dataclass(frozen=True)
class Rule:
    """kind; the pattern that takes up characters; the group whose length counts; its least length; what a text with a finding has: a pattern, or one of some literals."""

    kind: str
    pattern: str
    group: int
    least: int
    needs: str = ""
    literals: tuple[str, ...] = ()

    def may_hold(self, text: Column) -> Column:
        hit = text.rlike(self.needs) if self.needs else F.lit(True)
        return hit & reduce(or_, [F.contains(text, F.lit(x)) for x in self.literals]) if self.literals else hit


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# access and hex match whole runs, so their least lengths can stand in the pattern; for assign a short value still takes up its characters.
BASE = (
    Rule("assign", _ASSIGN, 2, 8, _ASSIGN.replace("-]+)", "-]{8})")),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, literals=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
# Published formats of keys and tokens, beyond the base kinds, of any length. A token's first part is tried once a run of its characters, and
# runs are never given back, so that a scan stays linear; the span is the whole run.
_TOKEN = "[A-Za-z0-9_-]"
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, literals=("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 39, literals=("AIza",)),
    Rule("jwt", rf"(?<!{_TOKEN})(?>{_TOKEN}*?eyJ){_TOKEN}{{8,}}+\.eyJ{_TOKEN}{{8,}}+\.{_TOKEN}{{8,}}+", 0, 30, literals=("eyJ",)),
    Rule("private", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]*", 0, 27, literals=("PRIVATE KEY-----",)),
    Rule("login", r"(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20:/@]++:[^\x00-\x20:/@]++@", 0, 10, literals=("://",)),
)
RULES = BASE + MORE
_SPANS = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _pieces(rule: Rule, order: int) -> Column:
    """array<struct(kind, ord, gap, len, fits)>: for each match, characters since the last, its own, and whether its counted group is long enough."""
    p, text = F.lit(rule.pattern), F.col("text")
    whole = F.regexp_extract_all(text, p, F.lit(0))
    counted = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(gaps.alias("g"), whole.alias("w"), counted.alias("c"))
    found = F.transform(
        zipped,
        lambda x: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(order).alias("ord"), F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("len"), (F.length(x["c"]) >= rule.least).alias("fits")
        ),
    )
    return F.when(rule.may_hold(text), found).otherwise(F.array().cast("array<struct<kind:string,ord:int,gap:int,len:int,fits:boolean>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs (blob, text) to (blob, spans), one row a blob: all findings by start, and of equal starts as the rules are listed."""
    # matches of all rules in one array, that the text is read in one place; an outer explode, as another would compute the array twice to filter on it
    all_rules = F.concat(*[_pieces(rule, k) for k, rule in enumerate(rules)])
    match = blobs.select("blob", F.posexplode_outer(all_rules).alias("at", "m"))
    upto = W.partitionBy("blob", "m.ord").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    found = match.select("blob", "m", end.alias("end"))
    span = F.when(F.col("m.fits"), F.struct((F.col("end") - F.col("m.len")).alias("start"), F.col("m.ord").alias("ord"), F.col("m.kind").alias("kind"), "end"))
    return found.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(_SPANS).alias("spans"))


def _addressed(versions: DataFrame, text: str) -> DataFrame:
    return versions.select(blob_of(text_of(text)).alias("blob"), text_of(text).alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """One row (blob, text) for each blob of versions (blob, text) that the ledger lacks under these rules.

    Copies meet in the partial aggregation, before the shuffle; the ledger is joined on the address by which blobs are dealt already.
    """
    once = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return once
    return once.join(ledger.filter(F.col("rules_version") == version).select("blob"), "blob", "left_anti")


def entries(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rules_version, spans) to add: one for each blob that the ledger lacks, with or without findings."""
    version = rules_version(rules)
    return scan_blobs(unseen(_addressed(versions, text), ledger, version), rules).select("blob", F.lit(version).alias("rules_version"), "spans")


def findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions, all columns but the text, with blob and spans (empty where the ledger has none)."""
    keep = [c for c in versions.columns if c.lower() not in {text.lower(), "blob", "spans"}]
    known = ledger.filter((F.col("rules_version") == rules_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    back = versions.select(*[F.col(f"`{c}`") for c in keep], blob_of(text_of(text)).alias("blob")).join(known, "blob", "left")
    return back.select(*[F.col(f"`{c}`") for c in keep], "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def scan_versions(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(ledger rows added, as a table; findings by version, from these and the ledger)."""
    new = written(entries(versions, text, ledger, rules), "ledger")
    return new, findings(versions, new if ledger is None else ledger.unionByName(new), text, rules)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, all columns, with each character of a finding replaced by an asterisk.

    Findings come from the ledger scan of distinct texts, by blob; texts without any stay as they are. Spans that overlap are one.
    """
    new = written(entries(docs, text, ledger, rules), "ledger")
    known = new if ledger is None else ledger.filter(F.col("rules_version") == rules_version(rules)).unionByName(new)
    blob, spans = clash_free(docs.columns, "__blob"), clash_free(docs.columns, "__spans")
    found = known.filter(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(blob, blob_of(text_of(text))).join(found, blob, "left")
    # (text so far, end so far): spans are in the order of their starts
    zero = F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("e"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["e"], s["start"])
        gap = F.substring(F.col(text), (acc["e"] + 1).cast("int"), (start - acc["e"]).cast("int"))
        end = F.greatest(acc["e"], s["end"])
        return F.struct(F.concat(acc["t"], gap, F.repeat(F.lit("*"), (end - start).cast("int"))).alias("t"), end.alias("e"))

    masked = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["t"], F.substring(F.col(text), (acc["e"] + 1).cast("int"), F.length(F.col(text)))))
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(masked)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a history in two commits, halves by a hash of doc_id of any type: the earlier fills the ledger, and of the later only unseen blobs are scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    later = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2)) == 1
    first = written(entries(docs.filter(~later)), "ledger")
    ledger = first.unionByName(written(entries(docs.filter(later), ledger=first), "ledger"))
    back = findings(docs, ledger)
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return back.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
_ASSIGN_SQL = _ANY_CASE + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
# the same runs without look-behind and possessive repeats
_SQL_FORM = {"jwt": rf"{_TOKEN}*eyJ{_TOKEN}{{8,}}\.eyJ{_TOKEN}{{8,}}\.{_TOKEN}{{8,}}", "login": next(r.pattern for r in MORE if r.kind == "login").replace("++", "+")}
_FOUND_SQL = " UNION ALL ".join(
    f"SELECT r, {o} AS o, '{k}' AS k, regexp_split_to_array(x, '{p}') AS g, regexp_extract_all(x, '{p}', 0) AS w, regexp_extract_all(x, '{p}', {c}) AS c, {n} AS least FROM t WHERE regexp_matches(x, '{p}')"
    for o, (k, p, c, n) in enumerate([("assign", _ASSIGN_SQL, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32), *[(r.kind, _SQL_FORM.get(r.kind, r.pattern), r.group, r.least) for r in MORE]])
)
OP4_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({_FOUND_SQL}),
p AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f),
s AS (
  SELECT r, o, k, length(w[i]) AS n,
    list_sum(list_transform(list_slice(g, 1, i), lambda z: length(z))) + coalesce(list_sum(list_transform(list_slice(w, 1, i - 1), lambda z: length(z))), 0) AS a
  FROM p WHERE length(c[i]) >= least
),
j AS (SELECT r, string_agg(k || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, o) AS spans, string_agg(k || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, o) FILTER (o < 3) AS base, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS k, count(*) FILTER (o = 2) AS h FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN j ON t.r = j.r
"""
