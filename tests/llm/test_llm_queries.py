"""The registered corpus queries over the smallest tables: whole tables, and the SQL that there is."""

import os

import duckdb
import pytest

from lumisieve.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    same = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy().tolist()))
    assert same(got) == same(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op4_packing", "op7_transcripts"}))
def test_a_row_for_each_row(spark, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op3") else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
    assert sorted(r[0] for r in QUERIES[name](spark, DATA).select(key).collect()) == sorted(ids)


def test_every_conversation_is_parsed(spark):
    got = QUERIES["op7_transcripts"](spark, DATA)
    truth = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        truth[r["conv_id"]] = truth.get(r["conv_id"], "") + r["role"][0]
    found = {r["conv_id"]: r["roles"] for r in got.collect()}
    assert found.keys() == truth.keys() and sum(found[c] == truth[c] for c in truth) >= 0.9 * len(truth)
