"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lumisieve.llm import conversation_repair as repair
from lumisieve.llm import fill_in_middle as middle
from lumisieve.llm import language_id as language

GRAMMAR = regex.compile(r"(s?(ua)+)?")


# ---- operator 11

TEXTS = ["Yes.", "No!", "cut short", "", " ", "Why?  ", "one. two", "é."]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", ""]


def brute(turns):
    """Every edit of every turn, with at most two inserts before each and at the end: the least (cost, audit)."""
    fault = repair.faults(turns)
    options = [["I" * k for k in range(3)]] * (len(turns) + 1)
    best = None
    for inserts in itertools.product(*options):
        for edits in itertools.product("DKR", repeat=len(turns)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(fault, edits)):
                continue
            audit = "".join(i + e for i, e in zip(inserts, [*edits, ""]))
            cost = sum({"D": 2, "K": 0, "R": 1, "I": 5}[e] for e in audit) + 5 * sum(f == "truncated" and e != "D" for f, e in zip(fault, edits))
            if best and (cost, audit) >= best[:2]:
                continue
            kept = [(None, "") if e == "I" else t for e, t in zip(audit, lined(turns, audit)) if e != "D"]
            for renamed in itertools.product("ua", repeat=sum(e in "RI" for e in audit)):
                new = iter(renamed)
                out = [({"u": "user", "a": "assistant"}[next(new)], t[1]) if e in "RI" else t for e, t in zip([e for e in audit if e != "D"], kept)]
                if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                    best = (cost, audit, out)
                    break
    return best


def lined(turns, audit):
    rest = iter(turns)
    return [None if e == "I" else next(rest) for e in audit]


def talk(rng, n):
    return [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]


def test_search_against_every_edit():
    rng = random.Random(1)
    for _ in range(120):
        turns = talk(rng, rng.randrange(5))
        fault = repair.faults(turns)
        cost, audit, _ = next(repair.searched([(r[:1], f) for (r, _), f in zip(turns, fault)], 0, repair.ACCEPTED, True))
        assert (cost, audit, repair.edited(turns, audit)) == brute(turns), turns


def test_tables_of_parts_find_what_one_search_finds():
    rng = random.Random(2)
    for _ in range(150):
        turns = talk(rng, rng.randrange(6, 40))
        short = [(r[:1], f) for (r, _), f in zip(turns, repair.faults(turns))]
        cost, audit, _ = next(repair.searched(short, 0, repair.ACCEPTED, True))
        at = [0, *sorted(rng.sample(range(1, len(turns)), 3)), len(turns)]
        parts = [short[a:b] for a, b in zip(at, at[1:])]
        tables = [repair.table_of(p, k == 3) for k, p in enumerate(parts)]
        for grouped in (tables, [repair.times(tables[0], tables[1]), tables[2], tables[3]], [tables[0], repair.times(repair.times(tables[1], tables[2]), tables[3])]):
            assert min(c for k, c in enumerate(grouped[0][0]) if c >= 0) >= 0
            path = repair.cuts(grouped, 0, repair.ACCEPTED)
            assert path[0] == 0 and path[-1] in repair.ACCEPTED
        path = repair.cuts(tables, 0, repair.ACCEPTED)
        found = [next(repair.searched(p, path[k], (path[k + 1],), k == 3)) for k, p in enumerate(parts)]
        assert (sum(f[0] for f in found), "".join(f[1] for f in found)) == (cost, audit)


def expected(rows):
    """The contract's columns from rows (conv_id, turn, role, text) by plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else regex.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, numbers = [r[1:] for r in hurt], [r[0] for r in hurt if r[0] is not None]
        fault, initials = repair.faults(turns), [r[1][:1] for r in hurt]
        cost, audit, _ = next(repair.searched(list(zip(initials, fault)), 0, repair.ACCEPTED, True))
        text = "\n".join(f"{r}:{t}" for r, t in repair.edited(turns, audit))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


class Tables:
    """A session that reads one table."""

    def __init__(self, spark, table):
        self.real, self.table = spark, table
        self.read = self

    def parquet(self, _):
        return self.table


@pytest.mark.parametrize("part, fan", [(512, 512), (4, 2), (3, 512)])
def test_repair_of_tables(spark, monkeypatch, part, fan):
    monkeypatch.setattr(repair, "PART", part)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(3)
    rows = [(c, rng.choice([None, t, t, t + 5]), rng.choice([*ROLES, None]), rng.choice([*TEXTS, f"{t}.", f"{t}!", None])) for c in [*range(12), None] for t in range(rng.randrange(1, 9))]
    rows += [(50, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(61)] + [(51, 1, "user", "Same.")] * 30 + [(52, None, None, None)] * 9
    rows += [(53, 0, "user", "x" * 200_000 + "."), (53, 1, "assistant", "word. " * 30_000)]
    # A conversation that loses its only row.
    rows += [next((c, 0, "user", "Gone.") for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)]
    table = spark.createDataFrame([(*r, "other", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op11_conversation_repair(Tables(spark, table), "").collect()}
    assert got == expected(rows)
    assert all(GRAMMAR.fullmatch("".join(t["role"][0] for p in own for t in p["turns"])) for own in parts_of(repair.repaired(table)))


def parts_of(parts):
    by = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        by.setdefault(r["conv_id"], []).append(r)
    return by.values()


def test_repair_of_an_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.op11_conversation_repair(Tables(spark, table), "").collect() == []


# ---- operator 12

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["tze", "gru", "ph"], "cc": ["ñe", "çu", "éa"], "dd": ["wo", "ing", "th"], "ee": ["sch", "ung", "ö"]}


def said(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_codewords():
    assert language.codewords(1).shape == (1, 0) and language.codewords(0).shape == (0, 0)
    for n in (2, 3, 4, 6, 7, 30, 120):
        code = language.codewords(n)
        assert set(np.unique(code)) == {-1, 1} and all(len(set(c)) == 2 for c in code.T)
        assert language.least_distance(code) >= (1 if n < 3 else 2 if n == 3 else code.shape[1] // 2 if n <= 6 else code.shape[1] // 5)
    assert (language.codewords(30) == language.codewords(30)).all()


def test_grams_are_counted_over_slices(monkeypatch):
    rng = random.Random(5)
    for k in range(200):
        text = "".join(rng.choice(["a", "é", "Z", " ", "  ", "1", "\n", "中"]) for _ in range(rng.randrange(30)))
        monkeypatch.setattr(language, "SLICE", 1 << 18)
        whole = language.grams(text)
        letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        if not letters:
            assert whole is None
            continue
        plain = f" {' '.join(letters)} "
        assert whole.sum() == sum(map(len, letters)) + len(plain) - 1 + len(plain) - 2
        monkeypatch.setattr(language, "SLICE", rng.randrange(1, 6))
        assert (language.grams(text) == whole).all(), text


def test_a_wrong_bit_is_borne_with():
    model = language.Model(["a", "b", "c", "d"], np.ones((4, language.GRAMS)))
    for k in range(4):
        for wrong in range(7):
            bits = 3.0 * model.code[k]
            bits[wrong] *= -1
            name, score, ambiguous = model.decided(bits)
            assert name == "abcd"[k] and 0.5 < score < 1 and not ambiguous
    assert model.decided(np.zeros(7))[::2] == ("a", True)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(6)
    rows = [(k, said(rng, lang, rng.randrange(5, 40)), lang) for k, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(500))]
    known = {k: lang for k, _, lang in rows}
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 -- ¿?", "aa"), (1003, "kalomi " * 50_000, None), (None, "grutze phgru tze", "bb"), (3, rows[3][1], rows[3][2]), (1004, "中文", None)]
    docs = spark.createDataFrame([(*r, "src", 1.0) for r in rows], "doc_id long, text string, lang string, rank string, place double").repartition(3)
    model = language.train(docs, rows=60)
    assert model.languages == sorted(SYLLABLES)
    got = language.identified(docs, model, "found").collect()
    assert len(got) == len(rows) and got[0]["rank"] == "src"
    held = [r for r in got if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([r["found"]["lang"] == known[r["doc_id"]] for r in held]) >= 0.97
    by_id = {r["doc_id"]: r["found"] for r in got}
    assert all(tuple(by_id[k]) == ("und", 0.0, True) for k in (1000, 1001, 1002))
    assert by_id[1003]["lang"] == "aa" and by_id[None]["lang"] == "bb" and by_id[1004]["lang"] in SYLLABLES
    assert all(0 <= r["found"]["score"] <= 1 for r in got)
    # Held-out rows' labels and all languages of the classified table are without effect.
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("zz")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r["found"] for r in language.identified(other.drop("lang"), language.train(other, rows=60), "found").collect()}
    assert again == by_id


def test_one_language_and_none(spark):
    schema = "doc_id long, text string, lang string"
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "zzz", "xx"), (3, "5", None)], schema)
    assert [r["found"]["lang"] for r in language.identified(one, language.train(one), "found").orderBy("doc_id").collect()] == ["xx", "xx", "und"]
    none = spark.createDataFrame([(1, "abc", None), (2, None, "xx")], schema)
    assert [r["found"]["lang"] for r in language.identified(none, language.train(none), "found").collect()] == ["und", "und"]
    empty = none.limit(0)
    assert language.train(empty) is None and language.identified(empty, None).collect() == []


# ---- operator 13


def test_fill_in_middle(spark):
    rng = random.Random(7)
    lines = ["a line", "", "Éà 中", "<", "P>", "\r", "<M", "x" * 50]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "\n"])) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "a<P>b"), (204, "line\n" * 100_000), (None, "a\nb\nc"), (5, "other\ntext"), (5, "other\ntext"), (-3, "a\nb\n")]
    docs = spark.createDataFrame([(*r, "x", 4) for r in rows], "doc_id long, text string, form string, n int").repartition(3)
    made = middle.transformed(docs).withColumn("back", middle.restored(F.col("fim.output"), F.col("fim.form")))
    got = made.collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"x"}
    for r in got:
        text, f = r["text"] or "", r["fim"]
        units = regex.findall(r"[^\n]*\n|[^\n]+", text)
        digest = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert tuple(f) == (len(units), form, *((None, None) if form == "plain" else (len(p), len(m))), want) and r["back"] == text
    assert {"plain", "psm", "spm"} == {r["fim"]["form"] for r in got}
    assert {r["fim"]["form"] for r in middle.transformed(docs, rate=0).collect()} == {"plain"}
    assert {r["fim"]["form"] for r in middle.transformed(docs, spm=0, unit=r"\S+\s*|\s+").collect()} == {"plain", "psm"}
    assert middle.transformed(docs.limit(0)).collect() == []


def test_marks_at_the_edges_of_parts_are_told_apart():
    rng = random.Random(8)
    for _ in range(2000):
        p, m, s = ("".join(rng.choice("<PSM>") for _ in range(rng.randrange(5))) for _ in range(3))
        if not any(x in p + m + s for x in ("<P>", "<S>", "<M>")):
            assert middle.rebuilt(f"<P>{p}<S>{s}<M>{m}", "psm") == middle.rebuilt(f"<S>{s}<P>{p}<M>{m}", "spm") == p + m + s
