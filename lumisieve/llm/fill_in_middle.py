"""Fill-in-the-middle training texts (operator 13).

A text is cut into units (lines, by default); two seeded cuts part its units into prefix, middle and suffix, which are
put together in one of two orders with marks between, so that a model learns to write the middle last:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is (the share that ``rate`` leaves out, empty texts, and texts that hold a mark)

The work is done by Arrow-batched pandas functions, a row for a row, without a shuffle. The ``regex`` library finds the
units from left to right; only their ends are kept, in an array of machine words, and two of them slice the text. The
seed is the SHA-256 of ``<seed>:<doc_id>``, so reruns agree and no row depends on another. ``restored`` rebuilds a text
from its output and form alone: a text with marks stays plain and a mark can't begin within another one, so the first
of each kind is the right one.

Defined cases: a null or empty text is plain, with no units and an empty output; a null id is written as no digits;
rows that repeat an id are cut by the same seed, each by its own number of units; a text of any length is sliced
whole, beside 8 bytes for each unit. An empty table gives no rows. Other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines with their line feeds; the seed; percent of texts that are transformed, and of these in the order ``spm``.
UNIT, SEED, RATE, SPM = r"[^\n]*\n|[^\n]+", 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMED = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str, unit: "regex.Pattern") -> array:
    """Where each unit of a text ends, in code points."""
    return array("Q", (m.end() for m in unit.finditer(text)))


def seeds(key: str) -> list[int]:
    """The first four numbers of 32 bits of a key's SHA-256."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def formed(key: str, text: str | None, unit: "regex.Pattern", rate: int = RATE, spm: int = SPM) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    text = text or ""
    ends = unit_ends(text, unit)
    n, (h1, h2, h3, h4) = len(ends), seeds(key)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text from which an output was made."""
    if form == "plain":
        return output
    opening, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(opening).partition(between)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transformed(docs: DataFrame, name: str = "fim", seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = UNIT) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``name``: n (units), form, prefix_chars, middle_chars, output."""
    units = regex.compile(unit)

    @F.pandas_udf(FORMED)
    def run(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [formed(k, t, units, rate, spm) for k, t in zip(key, text)]
        n, form, before, between, output = zip(*rows) if rows else [()] * 5
        whole = lambda v: pd.array(v, dtype="Int64")
        return pd.DataFrame({"n": whole(n), "form": pd.Series(form, dtype=object), "prefix_chars": whole(before), "middle_chars": whole(between), "output": pd.Series(output, dtype=object)})

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumn(name, run(key, F.col("text").cast("string")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for."""

    @F.pandas_udf("string")
    def run(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(o, f) for o, f in zip(output, form)], dtype=object)

    return run(output, form)


def _digests(output: Column, form: Column) -> Column:
    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def run(output: pd.Series, form: pd.Series) -> pd.DataFrame:
        digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        return pd.DataFrame({"output_sha256": [digest(o) for o in output], "restored_sha256": [digest(rebuilt(o, f)) for o, f in zip(output, form)]}, dtype=object)

    return run(output, form)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    made = docs.withColumn("digests", _digests(F.col("fim.output"), F.col("fim.form")))
    return made.select("doc_id", *[f"fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars")], "digests.*")


ORACLE = r"""
WITH seeded AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), k, 8) AS BIGINT)) AS h FROM documents),
cuts AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM seeded),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
