"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lumisieve.llm import huffman, line_dedup, matroska, mixing, ngram_join, packing, token_counts, token_table, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n int, ids string, size int, key string"
EMPTY = "doc_id long, text string, source string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "naïve", "über", "don't", "x1", "42", "--", "中文", "ok."]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t", " \n"]) for _ in range(k))
    rows = [text(rng.choice([1, 4, 9, 40, 200])) for _ in range(n)]
    rows += [None, "", "   ", "\n", rows[0], rows[0], rows[1] + " tail", text(6000), "word " * 3000, "<|endoftext|> a", "A shared line of some length\nown " + rows[2], "a shared LINE of some length \nother", "A shared line of some length"]
    return [(k, t, "xx", rng.choice(["a", "b", "b", "b", None]), 1, "clash", 2, "clash") for k, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def ids_of(text):
    return tokens.encoder().library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_are_the_librarys():
    rng = random.Random(3)
    parts = [" ", " ", "  ", "\n", "\t", "'s", "'t", "ab", "S", "12", ".", ",", "é", "中", "\xa0", "\x1c", "\x85", "　", "<|endoftext|>", "﻿", "ª", "xyz"]
    e = tokens.encoder()
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(e.encode_one(t), e.dtype).tolist() == ids_of(t), t


def test_new_stems_are_placed_together():
    """A batch's new stems become letters of bytes at once and get places in one store, but for long ones."""
    e = tokens.Encoder(tokens.vocabulary(), stored=60)
    split = e.library.pre_tokenizer.pre_tokenize_str
    words = [" alpha", "Épée", " ÿ", ""]
    assert e._letters_of(words) == [split(w)[0][0] if w else "" for w in words]
    batches = [["alpha beta, x1!\nbeta\nd'or " + "é" * 50 + ".", "", None, "," * 60 + " a"], ["beta alpha\n--", "n" * 49 + " n"], [f"w{k} v{k}a" for k in range(40)], ["alpha beta"]]
    for texts in batches:
        assert e.encode_many(texts, b"!!").to_pylist() == [e.whole(t or "") + b"!!" for t in texts]
        assert len(e.places) <= len(e.ends) - 1 and max(e.places.values()) < len(e.ends) - 1 and e.ends[-1] == len(e.packed) and max(map(len, e.places)) <= tokens.LONGEST


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(4)
    for n, bits in ((1, 4), (2, 4), (5, 3), (8, 3), (40, 6), (300, 12)):
        counts = np.array([rng.choice([0, 1, 2, 5, 1000]) + (k < n) for k in range(n)])
        sizes = huffman.code_lengths(counts, bits)
        used = sizes[counts > 0].astype(int)
        assert used.max() <= bits and sum(2.0**-u for u in used) <= 1 and (sizes[counts == 0] == 0).all()
        codes = huffman.canonical_codes(sizes)
        texts = sorted(f"{codes[k]:0{sizes[k]}b}" for k in np.flatnonzero(sizes))
        assert all(not b.startswith(a) for a, b in zip(texts, texts[1:]))
        ids = np.array([rng.choice(np.flatnonzero(counts)) for _ in range(1000)])
        data, marks = huffman.encode_bits(ids, codes, sizes)
        assert (huffman.decode_bits(data, marks, 1000, huffman.decode_table(sizes)) == ids).all()


def test_pairs_of_terms_are_tested_in_blocks(monkeypatch):
    """Two words of which only both together are bad, among others; any size of a block finds the same."""
    rng = np.random.default_rng(6)
    docs = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(3000)]
    labels = np.array([float(({7, 21} <= set(d.tolist())) ^ (rng.random() < 0.02)) for d in docs])
    want = toxicity.interacting(docs, labels, 40)
    assert {7, 21} <= set(want.tolist()) and len(want) < 10
    for block in (1, 7, 16, 39):
        monkeypatch.setattr(toxicity, "PAIR_BLOCK", block)
        assert toxicity.interacting(docs, labels, 40).tolist() == want.tolist()


def test_codes_of_many_bits_are_read():
    counts = np.ones(1 << 19, np.int64)
    sizes = huffman.code_lengths(counts, 20)
    ids = np.random.default_rng(9).integers(0, len(counts), 5000)
    data, marks = huffman.encode_bits(ids, huffman.canonical_codes(sizes), sizes)
    assert (huffman.decode_bits(data, marks, len(ids), huffman.decode_table(sizes)) == ids).all()


def test_token_output(spark, docs):
    got = huffman.read_documents(spark, huffman.encode_table(docs, end_id=2)).orderBy("doc_id").collect()
    start = 0
    for row, own in zip(got, corpus(), strict=True):
        ids = ids_of(own[1]) + [2]
        assert tuple(row) == (own[0], start, len(ids), crc(ids))
        start += len(ids)


def test_long_documents_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 100)
    rows = corpus(5, 10)
    got = huffman.read_documents(spark, huffman.encode_table(spark.createDataFrame(rows, SCHEMA), end_id=2, shards=2)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(ids_of(r[1])) + 1, crc([*ids_of(r[1]), 2])) for r in rows]


def test_files_are_read_by_their_path_alone(spark, tmp_path):
    """Another session's read; null and repeated ids; an empty table."""
    rows = [(None, "a b"), (None, None), (3, "x y z"), (3, "x y z"), (3, "other"), (9, "")]
    path = huffman.encode_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), end_id=2, shards=3, path=str(tmp_path / "files"))
    got = sorted(map(tuple, huffman.read_documents(spark.newSession(), path).collect()), key=lambda r: r[1])
    want = sorted((len(ids_of(t)) + 1, crc([*ids_of(t), 2])) for _, t in rows)
    assert [r[0] for r in got] == [None, None, 3, 3, 3, 9] and sorted(r[2:] for r in got) == want
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    none = huffman.encode_table(spark.createDataFrame([], "doc_id long, text string"), end_id=2, path=str(tmp_path / "none"))
    assert huffman.read_documents(spark, none).count() == 0


def test_packing(spark, docs):
    pieces = packing.pack(docs).collect()
    own, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
    for row in corpus():
        ids = [*ids_of(row[1]), 0]
        at = 0
        for p in sorted(own.pop(row[0]), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not own
    for parts in seqs.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_hilbert_keys_are_a_path():
    cells = sorted(((x, y, z) for x in range(8) for y in range(8) for z in range(8)), key=lambda c: packing.hilbert_key(list(c), 3))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))


def test_token_counts(spark, docs, monkeypatch):
    for block, segment in ((1 << 16, 1024), (64, 4)):
        monkeypatch.setattr(token_counts, "BLOCK_IDS", block)
        monkeypatch.setattr(token_counts, "SEGMENT", segment)
        plain = docs.where("text is null or text not like '%endoftext%'")
        blocks, names, dtype = token_counts.flattened(plain)
        got = token_counts.counted(blocks, dtype).join(names, ["file", "ordinal"]).collect()
        want = {r[0]: len(ids_of(r[1])) for r in corpus() if "endoftext" not in (r[1] or "")}
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)


def test_token_counts_of_texts_that_name_the_separator(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_IDS", 64)
    rows = [(k, t) for k, t in enumerate(["a b", "<|endoftext|>", "x <|endoftext|> y", "ab<|endoftext|>c  d", None, "<|endoftext|><|endoftext|>\n", "last one"])]
    rows += [(100 + r[0], r[1]) for r in corpus()]
    library = tokens.Encoder(tokens.vocabulary(), plain=True).library
    blocks, names, dtype = token_counts.flattened(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = token_counts.counted(blocks, dtype)
    got = found.join(names, ["file", "ordinal"]).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(rows) == found.count() and all(r["ended"] for r in got)
    assert tokens.encoder().encode_one("<|endoftext|>") != tokens.encoder(plain=True).encode_one("<|endoftext|>")


def test_workers_that_read_flat_files_hold_no_encoder():
    tokens.encoder(plain=True, stored=10).encode_many(["a text", None])
    file = token_counts.pa.RecordBatch.from_arrays([["f"], [b"\1\0" * (token_counts.BLOCK_IDS + 1)]], names=["path", "content"])
    assert [b.column(1)[0].as_py() for b in token_counts.cut([file], 2 * token_counts.BLOCK_IDS)] == [0, 1]
    assert not tokens._ENCODERS


def test_few_texts_are_with_a_worker_at_once(spark):
    """What a task that makes flat files holds doesn't grow with the rows of a batch."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    sizes = lambda batches: (b.rename_columns(["n"]).slice(0, 1).set_column(0, "n", pa.array([b.num_rows])) for b in batches)
    with pytest.raises(ValueError), token_counts.sent_at_once(spark, 16):
        seen = [r["n"] for r in spark.range(100).coalesce(1).mapInArrow(sizes, "n long").collect()]
        raise ValueError
    assert max(seen) == 16 and sum(seen) == 100 and spark.conf.get(name) == before
    texts = pa.array(["some words " * 5] * 50 + [None, "word " * 200])
    ranges = [(lo, hi) for lo, hi, _ in token_table.encoded(texts, tokens.encoder(), 0, 300)]
    assert [lo for lo, _ in ranges] == [0, *(hi for _, hi in ranges[:-1])] and ranges[-1] == (51, 52)
    assert max(hi - lo for lo, hi in ranges) <= 6


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 6, token_counts.END_ID, token_counts.END_ID, 7], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.counted(token_counts.flat_files(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in got] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


def test_long_flat_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    for name, value in (("WHOLE", 1000), ("RANGE", 4096), ("BLOCK_IDS", 64), ("SEGMENT", 4)):
        monkeypatch.setattr(token_counts, name, value)
    rng, want = np.random.default_rng(7), {}
    for name, n in (("a,b.bin", 6400), ("c[1]{2}.bin", 5003), ("d.bin", 2 * 4003), ("e.bin", 77), ("c1.bin", 40), ("f.bin", 6000)):
        ids = rng.integers(0, 50000, n).astype("<u2")
        ids[rng.integers(0, n, n // 300 + 1)] = token_counts.END_ID
        (tmp_path / name).write_bytes(ids.tobytes())
        ends = [-1, *np.flatnonzero(ids == token_counts.END_ID).tolist(), n]
        want[name] = [(a + 1, b - a - 1) for a, b in zip(ends, ends[1:]) if b < n or b - a > 1]
    # Spark's own limit for a file in one row, lowered.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        blocks = token_counts.flat_files(spark, str(tmp_path))
        sizes = {(r["file"].split("/")[-1], r["block"]): len(r["ids"]) for r in blocks.collect()}
        got = {}
        for r in token_counts.counted(blocks).orderBy("file", "ordinal").collect():
            got.setdefault(r["file"].split("/")[-1], []).append((r["start"], r["n_tokens"]))
        assert got == want and max(sizes.values()) <= 128 and blocks.rdd.getNumPartitions() > len(want)
        (tmp_path / "odd.bin").write_bytes(b"x" * 2001)
        with pytest.raises(ValueError, match="whole number"):
            token_counts.flat_files(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_line_dedup(spark, docs):
    rows = corpus()
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(strip))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r[0])
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and r[0] != max(holders[key(x)]))]
        assert got[r[0]]["text"] == "\n".join(kept) and got[r[0]]["__ls_lines"] == len(lines) and got[r[0]]["__ls_dropped"] == len(lines) - len(kept)
        assert got[r[0]]["ids"] == "clash"


def words_of(text):
    return (text or "").encode().lower().split()


def near(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = [(r[0], r[1]) for r in corpus(seed)]
    for size in (1, 3, 5, 6, 8, 12, 20, 30, 64, 90, 130, 300, 520, 700, 1200, 2600):
        base = [rng.choice(vocab) for _ in range(size)]
        for edits in (0, 1, 1, 2, size // 40 + 1, size // 25 + 1, size // 18 + 1, size // 10 + 1):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            w = w[: len(w) - rng.choice([0, 0, len(w) // 6])]
            rows.append((len(rows), " ".join(w).upper() if edits == 2 else "  ".join(w)))
    # Passages that more than CROWD documents quote, also as nearly all that a document has.
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [(len(rows) + k, " ".join(rng.choice(vocab) for _ in range((90, 30, 12)[k % 3])) + " " + passage) for k in range(48)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.near_copies(frame, exact=seed == 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near(rows) and len(got) == len(rows)


def test_unequal_sets_with_one_hash_stay_apart(spark):
    rows = [(k, f"a{k // 2} b c d e f g h") for k in range(12)] + [(20, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", ngram_join.F.col("text").cast("binary").alias("text"))
    signed = texts.withColumn("text_hash", ngram_join.text_hash()).mapInArrow(ngram_join._signer(False), ngram_join.SIGNED)
    _, members, classes = ngram_join.told_apart(signed.withColumn("class", ngram_join.F.col("class") % 2))
    assert {r["first"] for r in classes.collect()} == {0, 2, 4, 6, 8, 10}
    assert len({(r["class"], r["doc_id"] // 2) for r in members.where("n > 0").collect()}) == 6 and members.count() == 13


def test_rare_shingles_first(spark):
    """Of a crowd with one passage, documents with enough of their own have no key from the passage."""
    own = [" ".join(f"o{k}x{j}" for j in range(40)) for k in range(30)]
    rows = [(k, " ".join(f"p{j}" for j in range(20)) + " " + t) for k, t in enumerate(own)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", ngram_join.F.col("text").cast("binary").alias("text"))
    signed, _, classes = ngram_join.signed_classes(texts, False)
    crowd = signed.groupBy("class").agg(ngram_join.F.collect_set("band").alias("bands"))
    keys = ngram_join.rarest_keys(crowd, classes, texts, False)
    assert keys.groupBy("key").count().agg({"count": "max"}).first()[0] == 1 and keys.select("class").distinct().count() == 30


def test_members_of_a_family_meet_once(spark, monkeypatch):
    """Of near copies of one text, those just under the threshold meet few of the others, and each of them once."""
    rng, tables = random.Random(5), {}
    written = ngram_join.scratch.written
    monkeypatch.setattr(ngram_join.scratch, "written", lambda df, name: tables.update({name: written(df, name)}) or tables[name])
    monkeypatch.setattr(ngram_join.scratch, "dropped", lambda *_: None)
    base, rows = [f"w{rng.randrange(3000)}" for _ in range(400)], []
    for k in range(160):
        w = list(base)
        for at in rng.sample(range(5, 395), 13 if k % 5 == 0 else 2):
            w[at] = f"n{rng.randrange(3000)}"
        rows.append((k, " ".join(w)))
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near(rows)
    pairs = tables["op6-pairs"].count()
    assert pairs < 3 * len(rows)  # 332; 3214 by the band's bound
    met = ngram_join.met_once(tables["op6-open"], False)
    assert met.distinct().count() <= met.count() <= 1.1 * met.distinct().count() + 5


def test_new_keys_of_one_component_are_dropped(spark, monkeypatch):
    """Near copies of one text in a crowd share rare shingles with each other only: these are no keys."""
    rng, tables = random.Random(7), {}
    written = ngram_join.scratch.written
    monkeypatch.setattr(ngram_join.scratch, "written", lambda df, name: tables.update({name: written(df, name)}) or tables[name])
    monkeypatch.setattr(ngram_join.scratch, "dropped", lambda *_: None)
    passage, rows = " ".join(f"p{j}" for j in range(60)), []
    for k in range(12):
        own = [f"o{k}x{j}" for j in range(60)]
        rows += [(2 * k, passage + " " + " ".join(own)), (2 * k + 1, passage + " " + " ".join([*own[:-1], "end"]))]
    got = ngram_join.near_copies(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near(rows) and len(got) == 27
    anew, parts = tables["op6-anew"], tables["op6-parts"].count()
    assert tables["op6-crowd"].count() == parts == 24
    assert anew.groupBy("key").agg(ngram_join.F.countDistinct("component").alias("n")).where("n < 2").count() == 0


def test_keys_of_one_component_take_up_places(spark):
    """With ``across`` the keys are those of the whole order that several components have, held against the definition."""
    rng = random.Random(11)
    passages = [[f"p{j}x{i}" for i in range(30)] for j in range(4)]
    rows = []
    for k in range(60):
        own = [f"o{k}x{j}" for j in range((4, 25, 60)[k % 3])]
        rows.append((k, " ".join(own + passages[k % 4] + passages[rng.randrange(4)])))
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", ngram_join.F.col("text").cast("binary").alias("text"))
    signed, _, classes = ngram_join.signed_classes(texts, False)
    crowd = signed.groupBy("class").agg(ngram_join.F.collect_set("band").alias("bands"))
    first = crowd.agg(ngram_join.F.min("class")).first()[0]
    crowd = crowd.withColumn("part", ngram_join.F.when(ngram_join.F.col("class") % 5 == 0, first)).collect()
    got = ngram_join.rarest_keys(spark.createDataFrame(crowd, "class bigint, bands array<int>, part bigint"), classes, texts, False, across=True)
    named, sets = {r["class"]: r for r in crowd}, {}
    for _, text in rows:
        x = ngram_join.shingles(text.encode())
        kind = ngram_join.class_of(x)
        for band in named[kind]["bands"]:
            taken, _, most = ngram_join.in_band(x, band)
            sets[kind, band] = {int(v) for v in ngram_join._marked(ngram_join.mixed(taken, 3), band).view(np.int64)}, min(most, len(x) // 4) + 1
    holders = {}
    for (kind, band), (keys, _) in sets.items():
        for key in keys:
            holders.setdefault(key, []).append(named[kind]["part"] if named[kind]["part"] is not None else kind)
    rank = {key: (len(set(h)) > 1, len(h) if len(h) >= ngram_join.COMMON_FROM else 0, key) for key, h in holders.items()}
    want = {(kind, band, key) for (kind, band), (keys, n) in sets.items() for key in sorted(keys, key=rank.get)[:n] if rank[key][0]}
    assert {(r["class"], r["band"], r["key"]) for r in got.collect()} == want and 0 < len(want) < sum(n for _, n in sets.values()) / 4


@pytest.mark.parametrize("named", [1_000_000, 1])
def test_each_set_gives_its_keys_once(spark, monkeypatch, named):
    monkeypatch.setattr(ngram_join, "NAMED", named)
    rows = [(k, " ".join(f"a{k // (9 if k < 45 else 1)}x{j}" for j in range(30))) for k in range(60)] + [(60, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", ngram_join.F.col("text").cast("binary").alias("text")).repartition(4)
    signed, _, classes = ngram_join.signed_classes(texts, False)
    got = [tuple(r) for r in ngram_join.keys_of(signed, classes).collect()]
    want = {(r["class"], key) for r in signed.where("n > 0").collect() for key in r["keys"]}
    assert classes.where("copies > 1").count() == 5 and len(got) == len(set(got)) and set(got) == want


def test_join_leaves_no_shuffle_files(spark):
    """What a job has shuffled goes once its table is written, without waiting for the driver to collect garbage."""
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name, None)
    out = ngram_join.near_copies(spark.createDataFrame(corpus(1), SCHEMA).select("doc_id", "text").repartition(4))
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(name, None) == kept
    assert out.count() == len(corpus(1))


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (10, 100, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 12 :], rng.integers(0, 1 << 63, n // 15).astype(np.uint64)])
        band = ngram_join.band_of(min(len(a), len(b)))
        (_, x, most), (_, y, _) = ngram_join.sketch(a, band), ngram_join.sketch(b, band)
        apart = sum(bin(int(p) & (1 << 64) - 1).count("1") for p in x ^ y)
        assert apart <= len(np.setxor1d(ngram_join.in_band(a, band)[0], ngram_join.in_band(b, band)[0])) and apart <= most


def test_mixing_places_null_and_repeated_ids(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"t{rng.randrange(50)}" for _ in range(rng.randrange(0, 9))), "x", src) for src in ("a", None, "b") for i in [None] * 90 + [7] * 40 + list(range(20))]
    table = spark.createDataFrame(rows, "doc_id long, text string, __ls_upto string, source string").repartition(5)
    measured = mixing.measured(table)
    found, n = mixing.shares(measured)
    one, two = (sorted(map(str, mixing.with_taken(m, found, n).select("source", "doc_id", "text", "__ls_taken").collect())) for m in (measured, measured.repartition(3)))
    got = mixing.with_taken(measured, found, n).collect()
    taken, target = Counter(), {}
    for r in got:
        assert r["whole"] * r["__ls_size"] <= r["__ls_taken"] <= (r["whole"] + 1) * r["__ls_size"]
        taken[r["source"]] += r["__ls_taken"]
        target[r["source"]] = int(r["target"])
    assert len(got) == len(rows) and dict(taken) == target and one == two
    words = Counter()
    for r in mixing.mix(table).collect():
        words[r["source"]] += len(words_of(r["text"]))
    assert dict(words) == target


def test_mixing(spark, docs):
    rows = corpus()
    size = {r[0]: len(words_of(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sums = Counter()
    for i, s in source.items():
        sums[s] += size[i]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sums.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 2 * sums[s] < level * weight[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sums[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    measured = mixing.measured(docs)
    found, n = mixing.shares(measured)
    got = mixing.with_taken(measured, found, n).collect()
    again = {r["doc_id"]: r["__ls_taken"] for r in mixing.with_taken(measured, *mixing.shares(measured.repartition(7))).collect()}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["__ls_size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["__ls_taken"] <= 2 * size[r["doc_id"]] and again[r["doc_id"]] == r["__ls_taken"]
        taken[s] += r["__ls_taken"]
    assert {s: taken[s] for s in order} == {s: int(target[s]) for s in order}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(words_of(r["text"]))
    assert words == Counter({s: int(t) for s, t in target.items()})
    salted = mixing.with_taken(measured, found, mixing.FEW_SOURCES + 1).collect()
    assert {r["doc_id"]: r["__ls_taken"] for r in salted} == again


def toxic_corpus(n=900):
    """An insult with a group's name is toxic; either alone is not, and neither is an insult with another word."""
    rng = random.Random(9)
    filler = [f"f{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        insult, group, slur = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.1
        w = [rng.choice(filler) for _ in range(rng.randrange(5, 80))]
        for flag, word in ((insult, "rotten"), (group, "martians"), (slur, "scumbag")):
            if flag:
                w.insert(rng.randrange(len(w)), word.upper() if rng.random() < 0.2 else word)
        rows.append((k, " ".join(w)))
        labels.append((k, int(insult and group or slur)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "rotten martians " * 5000), (None, "rotten")], labels + [(3, None), (n + 9, 1), (None, 1), labels[5]]


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, terms string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["__ls_score"] for r in toxicity.scored(docs, machine).collect()}
    truth = dict(x for x in labels if x[1] is not None and x[0] is not None and x[0] < 900)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(got[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[902] >= toxicity.THRESHOLD and got[900] == got[901] < toxicity.THRESHOLD
    # An additive model can't tell the pair from its parts: the linear weights alone do worse.
    machine.v[:] = 0
    plain = machine.score([machine.places(toxicity.terms(dict(rows)[i])) for i in held])
    best = max(np.mean([(p >= c) == bool(truth[i]) for p, i in zip(plain, held)]) for c in np.linspace(0.01, 0.99, 99))
    assert best < sum(right) / len(right)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r[0] for r in toxicity.scored(docs, none).select("__ls_score").distinct().collect()} == {0.0}


def test_pair_term_is_the_double_sum():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(np.arange(40))
    m.w0, m.w, m.v = 0.3, rng.normal(size=40), rng.normal(size=(40, toxicity.RANK))
    docs = [np.sort(rng.choice(40, n, replace=False)) for n in (0, 1, 2, 7, 40, 0)]
    want = [m.w0 + sum(m.w[i] for i in d) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(d) for j in d[k + 1 :]) for d in docs]
    assert np.allclose(m.raw(docs)[0], want)


def test_slopes_are_those_of_the_loss(monkeypatch):
    """One step over one batch moves the weights against the numeric slope."""
    rng = np.random.default_rng(6)
    docs, labels = [np.sort(rng.choice(6, 3, replace=False)) for _ in range(30)], rng.integers(0, 2, 30).astype(float)
    for name, value in (("EPOCHS", 1), ("BATCH", 64), ("DECAY", 0.0), ("RATE", 1e-3)):
        monkeypatch.setattr(toxicity, name, value)
    m = toxicity.Machine(np.arange(6))
    w, v = m.w.copy(), m.v.copy()
    m.fit(docs, labels)

    def loss(w, v):
        n = toxicity.Machine(np.arange(6), float(np.log(labels.mean() / (1 - labels.mean()))))
        n.w, n.v = w, v
        p = n.score(docs)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert np.sign(w[k] - m.w[k]) == np.sign(loss(w + step, v) - loss(w - step, v))
        at = np.zeros(v.shape)
        at[k, 2] = 1e-6
        assert np.sign(v[k, 2] - m.v[k, 2]) == np.sign(loss(w, v + at) - loss(w, v - at))


def test_pure_interactions_are_learnt(spark):
    """Label = insult XOR group: neither word says anything alone."""
    rng, rows, labels = random.Random(12), [], []
    filler = [f"f{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    for k in range(2000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(filler) for _ in range(rng.randrange(5, 60))] + ["rotten"] * insult + ["martians"] * group
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(insult != group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["__ls_score"] for r in toxicity.scored(docs, machine).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 300 and np.mean([(got[k] >= 0.5) == bool(labels[k][1]) for k in held]) > 0.95


def test_toxicity_of_empty_tables_and_repeated_ids(spark):
    rows, labels = toxic_corpus(300)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.train(spark.createDataFrame([], "doc_id long, text string"), known) is None
    twice = spark.createDataFrame(rows[:300] + [(7, t) for _, t in rows[:200]] + [(7, "rotten martians")] * 200, "doc_id long, text string")
    machine = toxicity.train(twice, known, rows=250)
    scores = [r["__ls_score"] for r in toxicity.scored(twice, machine).collect()]
    assert len(scores) == 700 and all(0 <= x <= 1 for x in scores)


def test_media(spark, docs):
    got = {r["doc_id"]: r for r in matroska.features(matroska.store(docs)).collect()}
    for r in corpus():
        raw = (r[1] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        row = got[r[0]]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert row["media_sha256"] == hashlib.sha256(matroska.muxed(payload)).hexdigest()
    same = [got[r[0]]["feature"] for r in corpus() if r[1] == corpus()[0][1]]
    assert len(same) == 3 and len(set(same)) == 1


def test_matroska_forms(spark):
    def block(lacing, frames, sizes=b""):
        return matroska.number(2) + b"\x00\x05" + bytes([lacing]) + (bytes([len(frames) - 1]) if lacing else b"") + sizes + b"".join(frames)

    a, b, c = b"a" * 300, b"b" * 20, b"c" * 500
    xiph = block(matroska.XIPH, [a, b, c], bytes([255, 45, 20]))
    ebml = block(matroska.EBML_LACING, [a, b, c], matroska.number(300) + matroska.number(20 - 300 + (1 << 13) - 1, 2))
    body = matroska.unsigned(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, xiph) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, ebml))
    unknown = (0x1F43B675).to_bytes(4, "big") + b"\xff" + body
    data = matroska.HEADER + matroska.element(matroska.SEGMENT, unknown + unknown)
    found = matroska.parsed(data)["packets"]
    assert [data[o : o + n] for *_, o, n, _ in found] == [a, b, c] * 4 and {p[2] for p in found} == {12} and [p[0] for p in found] == [0] * 6 + [1] * 6
    rows = [(1, bytearray(data)), (2, bytearray(b"nothing")), (3, None), (4, bytearray(data[:-40]))]
    table = matroska.packets(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert Counter((r["id"], r["error"] is None) for r in table) == {(1, True): 12, (2, False): 1, (4, False): 1}


def test_laced_frames_have_times_of_their_own(spark):
    """By the samples before them; a group's own duration goes before the track's."""
    payload = bytes(range(256)) * 2600
    found = matroska.parsed(matroska.muxed(payload))
    at, want = 0, []
    for *_, n, _ in found["packets"]:
        want.append(at * 1000 // matroska.RATE)
        at += n
    assert at == len(payload) and [p[2] for p in found["packets"]] == want and len(set(want)) == len(want)
    assert found["tracks"] == {1: {"type": 2, "codec": "A_PCM/INT/LIT", "duration": 64_000_000}}
    block = matroska.number(1) + b"\x00\x03" + bytes([matroska.FIXED, 2]) + b"abcabcabc"
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block) + matroska.unsigned(matroska.BLOCK_DURATION, 30))
    cluster = matroska.element(matroska.CLUSTER, matroska.unsigned(matroska.TIMESTAMP, 100) + group + matroska.element(matroska.SIMPLE_BLOCK, block))
    data = matroska.HEADER + matroska.element(matroska.SEGMENT, matroska.INTRODUCTION + cluster)
    assert [p[2] for p in matroska.parsed(data)["packets"]] == [103, 113, 123, 103, 167, 231]
    rows = matroska.packets(spark.createDataFrame([(None, bytearray(data)), (1, bytearray(data)), (1, bytearray(data))], "doc_id long, media binary")).collect()
    assert len(rows) == 18 and {(r["track_type"], r["codec"]) for r in rows} == {(2, "A_PCM/INT/LIT")}
    again = matroska.features(matroska.store(spark.createDataFrame([(None, "a"), (4, "a"), (4, None)], "doc_id long, text string"))).collect()
    assert len(again) == 3 and len({r["feature"] for r in again}) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    assert huffman.read_documents(spark, huffman.encode_table(none, 2)).count() == 0
    assert packing.pack(none).count() == 0 and mixing.mix(none).count() == 0
    assert line_dedup.drop_common_lines(none).count() == 0 and ngram_join.near_copies(none).count() == 0
    assert matroska.features(matroska.store(none)).count() == 0
    blocks, _, dtype = token_counts.flattened(none)
    assert token_counts.counted(blocks, dtype).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"), (7, "other words"), (None, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], EMPTY)
    assert huffman.read_documents(spark, huffman.encode_table(docs, 2)).count() == 5
    assert packing.pack(docs).agg({"length": "sum"}).first()[0] == sum(len(ids_of(t)) + 1 for _, t in rows)
    got = ngram_join.near_copies(docs).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == {(7, 7): 3} and len(got) == 5
    assert line_dedup.drop_common_lines(docs).count() == 5 and mixing.mix(docs).count() > 0
