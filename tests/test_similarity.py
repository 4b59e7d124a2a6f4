"""Similarity joins against every pair."""

import random

import pytest

from lumisieve.operators import similarity as S


def hashes(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    rows = []
    for k in range(n):
        v = rng.choice(base)
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        rows.append((k, f"{v:016x}"))
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1])]


def apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


@pytest.mark.parametrize("within", [0, 3, 7, 20])
def test_pairs(spark, within):
    left, right = hashes(80, 1), hashes(60, 1)
    got = S.near_rows(spark.createDataFrame(left, "id long, hex string"), spark.createDataFrame(right, "id long, hex string"), 16, within).collect()
    assert sorted(map(tuple, got)) == sorted((i, j, apart(a, b)) for i, a in left for j, b in right if apart(a, b) <= within)


def test_groups_and_best_match(spark):
    rows = hashes(80, 2)
    df = spark.createDataFrame(rows, "id long, hex string")
    group = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if apart(a, b) <= 4 and group[i] < group[j]:
                    group[j], changed = group[i], True
    assert {r["id"]: r["group_id"] for r in S.near_groups(df, 16, 4).collect()} == group
    golden = [(k, h) for k, (_, h) in enumerate(hashes(10, 3))]
    got = {r["id"]: (r["distance"], r["ordinal"]) for r in S.best_match(df, spark.createDataFrame(golden, "ordinal long, hex string"), 16).collect()}
    assert got == {i: min((apart(a, g), o) for o, g in golden) for i, a in rows}


def test_other_lengths_nulls_and_blocks_of_golden(spark, monkeypatch):
    rows = [*hashes(40, 5), (900, None), (901, "0f"), (902, ""), (903, "zz" * 8), (904, "A" * 16)]
    df = spark.createDataFrame(rows, "id long, hex string")
    groups = {r["id"]: r["group_id"] for r in S.near_groups(df, 16, 4).collect()}
    assert len(groups) == len(rows) and all(groups[k] == k for k in range(900, 905))
    golden = [(k, h) for k, (_, h) in enumerate(hashes(50, 6))] + [(77, "ff"), (78, None)]
    for sent in (8 << 20, 0):
        monkeypatch.setattr(S, "GOLDEN_BLOCK", 8)
        monkeypatch.setattr(S, "GOLDEN_BYTES", sent)
        got = {r["id"]: (r["distance"], r["ordinal"]) for r in S.best_match(df, spark.createDataFrame(golden, "ordinal long, hex string"), 16).collect()}
        assert got == {i: min((apart(a, g), o) for o, g in golden[:-2]) if i < 900 else (None, None) for i, a in rows}
    none = S.best_match(df, spark.createDataFrame([], "ordinal long, hex string"), 16).collect()
    assert len(none) == len(rows) and all(r["ordinal"] is None for r in none)


def test_nearest_by_deeper_radii(spark, monkeypatch):
    """Every radius in turn, by keys only: the plan takes keys whatever they cost."""
    monkeypatch.setattr(S.hamming, "ROW_COST", 0)
    monkeypatch.setattr(S, "MEASURED", 0)
    rng = random.Random(11)
    golden = [(rng.randrange(1000), f"{rng.getrandbits(64):016x}") for _ in range(40)]
    golden += [(3, golden[0][1]), (2000, golden[1][1])]
    rows = []
    for k in range(150):
        v = int(rng.choice(golden)[1], 16)
        for b in rng.sample(range(64), k % 15):
            v ^= 1 << b
        rows.append((k, f"{v:016x}"))
    got = {r["id"]: (r["distance"], r["ordinal"]) for r in S.best_match(spark.createDataFrame(rows, "id long, hex string"), spark.createDataFrame(golden, "ordinal long, hex string"), 16).collect()}
    assert got == {i: min((apart(a, g), o) for o, g in golden) for i, a in rows}


def multi_score(own, other, limit):
    near = [min(apart(a, b) for b in other) for a in own]
    near = [d for d in near if d <= limit]
    return len(own) - (len(near) - sum(near) / (len(near) * 64)) if near else float(len(own))


@pytest.mark.parametrize("cost", [0, 1000])
def test_nearest_multi_hash(spark, monkeypatch, cost):
    monkeypatch.setattr(S.hamming, "ROW_COST", cost)
    monkeypatch.setattr(S, "MEASURED", 0)
    rng = random.Random(12)
    golden = [(k, [f"{rng.getrandbits(64):016x}" for _ in range(rng.randrange(1, 5))]) for k in range(60)]
    golden += [(90, golden[7][1]), (91, [])]

    def near(h):
        return f"{int(h, 16) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))):016x}"

    rows = [(k, [near(h) for h in rng.choice(golden[:60])[1]] + [f"{rng.getrandbits(64):016x}"] * (k % 3)) for k in range(80)]
    rows += [(200, []), (201, [f"{rng.getrandbits(64):016x}"]), (202, rows[5][1])]
    df, known = spark.createDataFrame(rows, "id long, own array<string>"), spark.createDataFrame(golden, "ordinal long, own array<string>")
    got = {r["id"]: (r["distance"], r["ordinal"]) for r in S.best_multi_match(df, known, cutoff=6.0).collect()}
    want = {i: min((multi_score(own, other, 6), o) for o, other in golden if other) if own else (None, None) for i, own in rows}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and (got[i][0] is None or abs(got[i][0] - want[i][0]) < 1e-12) for i in want)


@pytest.mark.parametrize("within, group", [(1, 4), (3, 2), (6, 4), (6, 40), (12, 16), (20, 30), (64, 8), (70, 1000)])
def test_keys_that_widen(spark, monkeypatch, within, group):
    """Small groups make many levels, and tiles where no level is left: all pairs once, of a left and a right value."""
    from lumisieve.operators import hamming

    monkeypatch.setattr(hamming, "GROUP", group)
    monkeypatch.setattr(hamming, "ROW_COST", 0)
    rng = random.Random(within * 100 + group)
    base = [rng.getrandbits(64) for _ in range(3)] + [0]
    values = {rng.choice(base) ^ sum(1 << b for b in rng.sample(range(24 if k % 3 else 64), rng.randrange(8))) for k in range(140)} | {rng.getrandbits(64) for _ in range(30)}
    rows = [(f"{v:016x}", rng.choice([1, 2, 3, 3])) for v in sorted(values)]
    left, right = ([h for h, s in rows if s & side] for side in (1, 2))
    frame = lambda t: spark.createDataFrame([(h,) for h in t] * 2, "hex string")
    got = [(r["a"], r["b"], r["distance"]) for r in S.near_values(frame(left), frame(right), 16, within).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b, apart(a, b)) for a in left for b in right if apart(a, b) <= within}
    same = frame(left)
    got = [(r["a"], r["b"]) for r in S.near_values(same, same, 16, within, ordered=True).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in left for b in left if a < b and apart(a, b) <= within}


def test_blocks_follow_the_number_of_values():
    from lumisieve.operators.hamming import plan

    for within in range(1, 17):
        cost = [plan(n, n * n / 2, 64, within)[1] / n for n in (10**5, 10**6, 10**7)]
        assert plan(10**6, 5e11, 64, within)[0] > within and cost[2] < cost[0] * 100
    assert plan(10**6, 5e11, 64, 40)[0] == 0


@pytest.mark.parametrize("digits", [14, 21, 64])
def test_pairs_of_other_sizes(spark, digits):
    rng = random.Random(digits)
    base = rng.getrandbits(4 * digits)
    rows = [(k, f"{base ^ sum(1 << b for b in rng.sample(range(4 * digits), k % 9)):0{digits}x}") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, hex string")
    got = {(r["a"], r["b"], r["distance"]) for r in S.near_values(df, df, digits, 7, ordered=True).collect()}
    assert got == {(a, b, apart(a, b)) for _, a in rows for _, b in rows if a < b and apart(a, b) <= 7}


def test_the_row_before(spark):
    rng = random.Random(8)
    rows = [(g, k, rng.choice([None, "x", "y"])) for g in ("a", "b", None) for k in rng.sample(range(-50, 200), 30)]
    got = {(r["g"], r["k"]): r["before"] for r in S.before(spark.createDataFrame(rows, "g string, k long, v string"), "g", "k", "v", span=16).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted([(k, v) for h, k, v in rows if h == g], key=lambda x: x[0])
        want |= {(g, k): own[i - 1][1] if i else None for i, (k, _) in enumerate(own)}
    assert got == want


def test_known_and_largest(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, None)], "id long, hex string")
    golden = spark.createDataFrame([("aa",), ("aa",)], "hex string")
    assert {r["id"] for r in S.known(df, golden).collect()} == {1, 3} and {r["id"] for r in S.known(df, golden, missing=True).collect()} == {2, 4}
    rows = spark.createDataFrame([("x", 5, 0), ("x", 7, 1), ("x", 7, 2), ("x", 1, 3), ("y", 1, 0)], "g string, size long, at long")
    assert sorted((r["g"], r["at"], r["rank"]) for r in S.largest(rows, ["g"], "size", "at", 2).collect()) == [("x", 1, 1), ("x", 2, 2), ("y", 0, 1)]


def test_pairs_use_an_equi_join(spark):
    df = spark.createDataFrame(hashes(2000, 4), "id long, hex string")
    plan = S.near_values(df, df, 16, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
