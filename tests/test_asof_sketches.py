"""As-of joins against a scan, and sketches against exact counts."""

import random
from datetime import datetime, timedelta

import pytest

from lumisieve.operators import asof, sketches

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("keys", [["a", "b", "c", None], ["one"]])
def test_latest_reference(spark, keys):
    rng = random.Random(len(keys))
    at = lambda: None if rng.random() < 0.03 else START + timedelta(seconds=rng.randrange(400))
    rows = [(k, rng.choice(keys), at(), "x") for k in range(300)]
    rows += rows[:3]
    refs = [(rng.choice(keys), at(), rng.choice([None, k])) for k in range(120)]
    left, right = spark.createDataFrame(rows, "id long, k string, ts timestamp, note string"), spark.createDataFrame(refs, "k string, ts timestamp, ref long")
    got = sorted(((r["id"], r["ref"]) for r in asof.latest(left, right, ["k"], "ts").collect()), key=str)
    want = []
    for i, k, t, _ in rows:
        before = [(u, v is not None, v or 0, v) for g, u, v in refs if g == k and k is not None and t is not None and u is not None and u <= t]
        want.append((i, max(before)[-1] if before else None))
    assert got == sorted(want, key=str)


def test_long_series_are_many_ranges(spark):
    """One key's rows, of which only the first is a reference: it is carried over all ranges."""
    rows = spark.range(2000).selectExpr("id", "'k' AS k", "timestamp_seconds(id + 10) AS ts")
    refs = spark.createDataFrame([("k", 7, "first")], "k string, s long, ref string").selectExpr("k", "timestamp_seconds(s) AS ts", "ref")
    assert asof.latest(rows, refs, ["k"], "ts").where("ref = 'first'").count() == 2000


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, "k", START)], "id long, k string, ts timestamp")
    refs = spark.createDataFrame([("k", START, 5)], "k string, ts timestamp, ref long")
    assert [tuple(r)[-1] for r in asof.latest(rows, refs.limit(0), ["k"], "ts").collect()] == [None]
    assert asof.latest(rows.limit(0), refs, ["k"], "ts").collect() == []
    assert [tuple(r)[-1] for r in asof.latest(rows, refs, ["k"], "ts").collect()] == [5]


def test_sketches_merge(spark):
    rng = random.Random(3)
    rows = [(g, p, f"{rng.randrange(3000)}") for g in ("a", "b") for p in range(6) for _ in range(800)] + [("c", 0, None)]
    parts = sketches.sketched(spark.createDataFrame(rows, "g string, p int, hex string"), ["g", "p"], "hex")
    got = {(r["g"], r["p"]): (r["n"], r["n_distinct"]) for r in sketches.merged(parts, ["g", "p"]).collect()}
    for g in ("a", "b", "c", None):
        for p in (None, 0, 5):
            own = [h for x, q, h in rows if g in (x, None) and p in (q, None)]
            if own:
                n, estimate = got[g, p]
                exact = len({h for h in own if h is not None})
                assert n == len(own) and abs(estimate - exact) <= max(1, exact * 0.065)
    assert {r["g"] for r in sketches.merged(parts, ["g"], subtotals=False).collect()} == {"a", "b", "c"}
