"""Every registered query against its SQL on DuckDB, over the smallest shared tables."""

import math
import os

import duckdb
import pytest

from tallyline.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="shared tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 12)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    assert sql is not None, "an engine query without SQL"
    res = duck.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    types = {x[0]: str(x[1]) for x in res.description}
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == types
    want = [tuple(_plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    assert _sorted(got) == _sorted(want)


def test_greedy_dedup_takes_all_bits(spark, tmp_path):
    at = [1.0] * 64
    rows = [(0, at, 1), (1, [-1.0] * 12 + at[12:63] + [-1.0], 1), (2, at[:63] + [-1.0], 2), (3, [-1.0] * 12 + at[12:63] + [-1.0], 2)]  # 13 bits apart, then 12
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.vec_id: r.kept for r in catalog.queries()["greedy_dedup"](spark, str(tmp_path)).collect()} == {0: True, 1: True, 2: True, 3: False}


def test_single_frame_verdict_takes_any_part_key(spark, tmp_path):
    """The second line has the smaller part key by more than a million."""
    rows = [(1, 1999998, 4, 1, 1.0, 0.5), (1, 0, 28, 2, 1.0, 0.5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(12, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    assert [tuple(r) for r in catalog.queries()["single_frame_verdict"](spark, str(tmp_path)).collect()] == [(1, "UNREGISTERED", "DENY_ALERT")]
