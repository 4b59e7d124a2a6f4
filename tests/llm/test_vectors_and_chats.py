"""Embeddings, transcripts and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.llm import near_vectors, transcripts

VECTORS = "vec_id long, embedding array<float>, label int, copies string"


@pytest.mark.parametrize("tile, leaf", [(16, 16), (8192, 8), (64, 5)])
def test_near_vectors(spark, monkeypatch, tile, leaf):
    monkeypatch.setattr(near_vectors, "TILE", tile)  # read by the driver's functions, which are sent to the tasks
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1, 1, 1, 2):
        for _ in range(12):
            base = rng.normal(size=24)
            for _ in range(rng.integers(1, 6)):
                v = base + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.3, 0.4])
                rows.append([len(rows), [float(x) for x in v.astype(np.float32)], label, "x"])
    rows += [[len(rows) + k, v, lab, "x"] for k, (v, lab) in enumerate([(None, 0), ([0.0] * 24, 0), ([1.0] * 23 + [float("nan")], 0), ([1.0] * 23 + [None], 0), ([float("inf")] * 24, 0), ([], 0), (rows[0][1], None), (rows[0][1], 5), (rows[0][1], rows[0][2]), ([1.0, 2.0], 0), ([2.0, 4.0], 0)])]
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    top, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return -1
        a, b = np.array(a), np.array(b)
        with np.errstate(all="ignore"):
            c = (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b))
        return c if np.isfinite(a).all() and np.isfinite(b).all() and np.isfinite(c) else -1

    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] == b[2] and a[2] is not None and cosine(a[1], b[1]) >= 0.93:
                links[a[0]] += 1
                links[b[0]] += 1
                x, y = find(a[0]), find(b[0])
                top[max(x, y)] = min(x, y)
    assert sum(links.values()) > 50
    for r in rows:
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (links[r[0]], find(r[0]), find(r[0]) == r[0]), r[0]
    assert near_vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_linked_tiles_by_parts(monkeypatch, same):
    monkeypatch.setattr(near_vectors, "LEAF", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12))
    x, y = (near_vectors.unit(centres[rng.integers(0, 9, n)] + 0.2 * rng.normal(size=(n, 12))) for n in (90, 70))
    y = x if same else y
    cx, cy = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    cy = cx if same else cy
    reach = float(np.sqrt(2 - 2 * 0.93)) + 1e-9
    assert sorted(np.concatenate(near_vectors.leaves(x)).tolist()) == list(range(len(x))) and max(map(len, near_vectors.leaves(x))) <= 7
    sums, i, j = near_vectors.tiles_linked(x, y, x, y, cx, cy, same, 0.93, reach)
    near = x @ y.T >= 0.93
    if same:
        np.fill_diagonal(near, False)
        want = (near * cy).sum(1)
    else:
        want = np.r_[(near * cy).sum(1), (near.T * cx).sum(1)]
    assert near.sum() > 100 and (sums == want).all()
    a, b = np.nonzero(near)
    b = b if same else b + len(x)
    assert (near_vectors.forest(len(want), i, j) == near_vectors.forest(len(want), a, b)).all()


def test_null_and_repeated_vectors(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(None, v, 1, "x"), (3, v, 1, "x"), (3, v, 1, "x"), (3, w, 1, "x"), (5, v, 1, "x"), (6, w, 1, "x")]
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == sorted([(-1, 0, None), (3, 2, 3), (3, 2, 3), (3, 1, 3), (5, 2, 3), (6, 1, 3)], key=str)


def test_rows_of_one_id_have_the_links_of_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [0.0, 1.0], 1, "x"), (2, [1.0, 0.05], 1, "x")]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("kind, labels", [("long", (5_000_000_000, 5_000_000_001)), ("string", ("a", "")), ("double", (0.5, float("nan"))), ("date", None)])
def test_labels_of_other_types(spark, kind, labels):
    from datetime import date

    a, b = labels or (date(2024, 1, 1), date(2024, 1, 2))
    rows = [(1, [1.0, 0.0, 0.1], a), (2, [1.0, 0.01, 0.1], a), (3, [1.0, 0.0, 0.1], b), (4, [1.0, 0.01, 0.1], b), (5, [1.0, 0.0, 0.1], None)]
    got = [tuple(r)[:3] for r in near_vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).orderBy("vec_id").collect()]
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_tiles_that_are_far_apart_never_travel(spark):
    """Boxes of tiles: pairs that come within reach are found by cells as by all pairs."""
    rng = np.random.default_rng(8)
    reach, rows = 0.37, []
    for k in range(150):
        lo = rng.uniform(-1, 0.9, 4)
        rows.append((k, int(rng.integers(0, 2)), 8, lo.tolist(), (lo + rng.uniform(0, rng.choice([0.05, 1.0]), 4)).tolist()))
    tiles = spark.createDataFrame(rows, "tile long, label int, dims int, lo array<double>, hi array<double>")
    got = [tuple(r) for r in near_vectors._near_tiles(tiles, reach).collect()]
    gap = lambda a, b: sum(max(0.0, p - y, x - q) ** 2 for x, y, p, q in zip(a[3], a[4], b[3], b[4]))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] <= b[0] and a[1] == b[1] and gap(a, b) <= reach**2}
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows) ** 2 / 4


def chats(n=80):
    rng = random.Random(2)
    say = lambda q: " ".join(rng.choice(["well", "then", "we", "see", "more", "note: x"]) for _ in range(rng.randrange(3, 30))) + ("?" if q else ".")
    rows = []
    for c in range(n):
        turns = ["system"] * (c % 4 == 0) + ["user", "assistant"] * rng.randrange(1, 5)
        rows += [(c, k, r, "\n".join(say(r == "user") for _ in range(rng.randrange(1, 3)))) for k, r in enumerate(turns)]
    return rows


def test_roles_are_recovered(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, states string").repartition(3)
    raw = transcripts.rendered_from(df)
    got = transcripts.parsed(raw, transcripts.fit(raw.where("conv_id % 2 = 0"))).where("conv_id % 2 = 1").collect()
    want = {c: "".join(r[2][0] for r in rows if r[0] == c) for c in range(80)}
    assert np.mean([r["roles"] == want[r["conv_id"]] for r in got]) > 0.9
    exact = next(r for r in got if r["roles"] == want[r["conv_id"]])
    assert exact["rendered"] == "".join(f"<|{r[2]}|>\n{r[3]}\n<|end|>\n" for r in rows if r[0] == exact["conv_id"])


def test_states_against_every_path():
    rng = np.random.default_rng(3)
    model = transcripts.Model(rng.integers(0, 9, 6), rng.integers(0, 9, (6, 6)), rng.integers(0, 9, (6, transcripts.N_SYMBOLS)))
    seen = rng.integers(0, transcripts.N_SYMBOLS, 5)
    best, score = None, -np.inf
    for path in np.ndindex(*[6] * 5):
        s = model.start[path[0]] + sum(model.moves[a, b] for a, b in zip(path, path[1:])) + sum(model.emits[p, o] for p, o in zip(path, seen))
        if s > score:
            best, score = path, s
    assert model.states(seen).tolist() == list(best)


def test_odd_transcripts(spark):
    rows = [(1, None, "user", "a"), (1, 2, None, None), (2, 0, "robot", ""), (None, 0, "user", "hi\n\nthere"), (3, 0, "user", "x" * 100_000), (4, 1, "user", "same"), (4, 1, "user", "same"), (5, 0, "user", "u"), (5, 600, "assistant", "v")]
    raw = transcripts.rendered_from(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = transcripts.parsed(raw, transcripts.fit(raw)).collect()
    assert sorted((r["conv_id"] or 0, r["part"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]
    empty = transcripts.rendered_from(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert transcripts.parsed(empty, transcripts.fit(empty)).count() == 0
    model = transcripts.fit(empty)
    assert [r for r, _ in transcripts.turns_of("User: hi\nAssistant: ho\nand more\n[system] x", model)] == ["user", "assistant", "system"]
    assert transcripts.turns_of(None, model) == transcripts.turns_of("", model) == []


def test_parts_are_bounded_whatever_the_keys(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "PART", 8)
    rows = [(None, None, "user", f"n{k % 30:02}") for k in range(100)] + [(None, k, "user", f"m{k}") for k in range(3)]
    rows += [(1, 5, "user", "same")] * 50 + [(1, 6, "assistant", f"t{k:02}") for k in range(21)] + [(1, 9, "user", "next")]
    rows += [(2, None, "user", f"o{k}") for k in range(8)] + [(3, k, "user", f"p{k:02}") for k in range(20)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    raw = transcripts.rendered_from(df).collect()
    found, want = {}, {}
    for r in sorted(raw, key=lambda r: (r["conv_id"] or 0, r["part"])):
        own = [line.split()[-1].split("]")[-1].split(">")[-1] for line in r["text"].split("\n") if line]
        assert len(own) == sum(s % 2 == 0 for s in r["states"]) <= 8
        found.setdefault(r["conv_id"], []).append(own)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2], r[3])):
        want.setdefault(c, []).append(text)
    assert {k: sum(v, []) for k, v in found.items()} == want
    assert all(len(x) == 8 for v in found.values() for x in v[:-1])
    got = transcripts.parsed(transcripts.rendered_from(df), transcripts.fit(transcripts.rendered_from(df)))
    assert got.count() == len(raw)


def test_cuts_change_no_state(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "PART", 3)
    monkeypatch.setattr(transcripts, "FAN", 2)
    rng = random.Random(9)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "x"]), "\n".join(rng.choice(["well?", "", "note: x", "we see", "Q: z"]) for _ in range(rng.randrange(1, 4)))) for c in range(25) for k in range(rng.randrange(1, 40))]
    df = spark.createDataFrame([(c if c else None, *r) for c, *r in rows], "conv_id long, turn long, role string, text string").repartition(4)
    raw = transcripts.rendered_from(df)
    model = transcripts.fit(raw.where("conv_id % 2 = 0"))
    whole, roles, texts, continued = {}, {}, {}, 0
    for r in sorted(raw.collect(), key=lambda r: r["part"]):
        whole.setdefault(r["conv_id"], []).append(r["text"])
    for r in sorted(transcripts.parsed(raw, model).collect(), key=lambda r: r["part"]):
        roles[r["conv_id"]] = roles.get(r["conv_id"], "") + r["roles"]
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["rendered"]
        continued += not r["rendered"].startswith("<|")
    assert max(map(len, whole.values())) > 8 and continued > 3
    packed = lambda t: "".join(t.split())
    for c, parts in whole.items():
        turns = transcripts.turns_of("\n".join(parts), model)
        assert roles[c] == "".join(r[0] for r, _ in turns), c
        assert packed(texts[c]) == packed(transcripts.canonical(turns))


def test_repeated_ids_stay_by_their_own_texts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    x, y, a, z = text(), text(), text(), text()
    rows = [(3, x), (7, x + " more"), (7, y), (7, y), (8, a), (8, a + " more"), (9, z), (9, None), (9, ""), (9, z.upper()), (10, y + " more"), (None, x), (None, x)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    kept = lambda i: sorted(t or "" for d, t in got if d == i)
    assert kept(3) == [x] and kept(7) == [y] and kept(10) == [] and kept(None) == [x, x]
    assert len(kept(8)) == 1 and kept(8)[0] in (a, a + " more")
    assert len(kept(9)) == 2 and kept(9)[0] == "" and kept(9)[1].lower() == z
    assert len(got) == 7
    found = corpus_pipeline.ngram_join.near_copies(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and found.count() == len(rows)
    assert sorted(r["component_id"] for r in found.where("doc_id = 7").collect()) == [3, 7, 7]


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    vocab = [f"v{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000)]
    rows, labels = [], []
    for k in range(240):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        bad = k % 6 == 0
        if bad:
            w.insert(3, rng.choice(["nastyword", "foulword"]))
        text = " ".join(w) + "\nThis line is common to many documents" * (k % 5 == 0)
        rows.append([k, text, "en", ["s", "t", None][k % 3], len(text), 1])
        labels.append((k, int(bad)))
    rows += [[300, rows[1][1], "en", "s", 1, 1], [301, rows[2][1] + " one more word", "en", "t", 1, 1], [302, None, "en", "s", 0, 1], [303, "", "en", None, 0, 1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rs} for n, rs in seen.items()}
    assert ids["toxicity"] == {r[0] for r in rows} - {k for k, bad in labels if bad}
    assert ids["line_dedup"] == ids["toxicity"] and sum("common to many" in r["text"] for r in seen["line_dedup"]) == 1
    assert ids["line_dedup"] - ids["ngram_jaccard_join"] == {300, 301}
    assert ids["mixing"] <= ids["ngram_jaccard_join"] and len(ids["packing"]) == len(ids["mixing"])
    assert sum(r["length"] for r in seen["packing"]) > sum(len(r["text"].split()) for r in seen["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(r["length"] for r in seen["packing"])


def water_filled(sizes, weights, share=1.5, most=2.0):
    """Targets of sources by plain rounds: what is above the cap is clamped, the rest is shared again by weight."""
    rest, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / total > most * sizes[s]}
        if not over:
            return out | {s: rest * weights[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def test_pipeline_against_brute_force_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty and long texts, other columns: each stage on what the one before has kept."""
    from collections import Counter

    from lumisieve.llm import tokens

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(15)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    common = "A line of the footer that very many share"
    rows = []
    for k in range(90):
        w = say(rng.randrange(8, 60)) + (" foulword" if k % 9 == 0 else "")
        rows.append((k, w + (f"\n{common}" if k % 4 == 0 else ""), ["s", "t", "u", None][k % 4]))
    near = rows[5][1].split(" ")
    rows += [(200, " ".join([*near, "tail"]), "s"), (201, rows[6][1], "t"), (202, rows[6][1].upper(), "u")]
    rows += [(None, say(30), "s"), (None, rows[7][1], None), (None, None, "t"), (7, say(25), "s"), (7, rows[7][1], "s"), (8, rows[8][1], None), (8, rows[8][1], None)]
    rows += [(300, None, "s"), (301, "", None), (302, " \n ", "u"), (303, say(30_000), "t")]
    spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, source string, size double, component_id string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([r.asDict() for r in docs.collect()])
    plain = lambda rs: Counter((r["doc_id"], r["text"], r["source"]) for r in rs)
    assert plain(seen[0]) == Counter(r for r in rows if "foulword" not in (r[1] or ""))

    # Lines: what is left of each text.
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for r in seen[0]:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    lost = {k: top(ids) for k, ids in holders.items() if len(ids) >= 3}
    assert common.lower() in lost
    kept = lambda r: "\n".join(x for x in (r["text"] or "").split("\n") if key(x) not in lost or lost[key(x)] == r["doc_id"])
    assert plain(seen[1]) == Counter((r["doc_id"], kept(r), r["source"]) for r in seen[0])

    # Near copies: of each group the texts of its smallest id, one row of each; rows without an id stay.
    def shingles(text):
        w = [x for x in text.lower().replace("\n", " ").split(" ") if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r["text"]) for r in seen[1]]
    group = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(group)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    want = Counter()
    for g in set(group):
        own = [r for r, x in zip(seen[1], group) if x == g]
        named = [r for r in own if r["doc_id"] is not None]
        want.update(r["doc_id"] for r in own if r["doc_id"] is None)
        if named:
            least = min(r["doc_id"] for r in named)
            want[least] += 1 if shingles(named[0]["text"]) else 0
            want.update(r["doc_id"] for r in named if not shingles(r["text"]))
    assert Counter(r["doc_id"] for r in seen[2]) == want and plain(seen[2]) <= plain(seen[1])

    # The mix: each source's words.
    words = lambda t: len([x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x])
    sizes = Counter()
    for r in seen[2]:
        sizes[r["source"]] += words(r["text"])
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    targets = water_filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)})
    taken = Counter()
    for r in seen[3]:
        taken[r["source"]] += words(r["text"])
    assert {s: taken[s] for s in names} == {s: int(targets[s] + 1e-9) for s in names}

    # The pieces: all ids of all documents, and no padding.
    of = lambda t: len(tokens.encoder().library.encode(t or "", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in seen[4]) == sum(of(r["text"]) for r in seen[3])
    full = Counter()
    for r in seen[4]:
        full[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in full.values())


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
