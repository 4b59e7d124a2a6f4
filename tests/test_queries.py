"""The registered queries against their SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from lumisieve import sql
from lumisieve.plans import oracles, plane_oracles, plane_queries, queries

DATA = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "part", "events", "documents", "embeddings")
ORACLES, QUERIES = {**oracles.ORACLES, **plane_oracles.ORACLES}, {**queries.QUERIES, **plane_queries.QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    same = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy().tolist()))
    assert same(got) == same(want)


def test_every_query_without_sql_has_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, DATA).count() > 0


def test_sql_functions(spark):
    from test_sources import RNG, bmp24

    assert "image_segments" in sql.register(spark)
    data = bmp24(RNG.integers(0, 256, (40, 60, 3), dtype="uint8"))
    spark.createDataFrame([(bytearray(data), "bmp"), (None, "bmp"), (bytearray(b"BM"), "bmp")], "content binary, kind string").createOrReplaceTempView("files")
    got = spark.sql("SELECT image_phash(content, kind, 8) AS h, image_colour(content, kind, 3) AS c FROM files").collect()
    assert len(got[0]["h"]) == 16 and len(got[0]["c"]) == 11 and [r["h"] for r in got[1:]] == [None, None]
    assert spark.sql("SELECT s.* FROM files f, LATERAL image_segments(f.content, f.kind) s").count() >= 1
