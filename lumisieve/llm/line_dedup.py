"""Dropping lines that many documents share (operator 10).

Lines are exploded and normalised (ASCII white space stripped at both ends, A-Z lower-cased), hashed to 128 bits, and
counted by distinct documents. A line of at least ``MIN_CHARS`` code points in at least ``MIN_DOCS`` documents stays in
the document with the largest id only. Documents are put together again from the lines that stay, in their order.

A very common line is no hot spot: (line, document) pairs are made distinct first, then counted with partial sums,
and the only join on a line's hash is a plain one that adaptive execution splits. Texts move once, to meet the hashes
that their document loses.

Defined cases: a null or empty text is one empty line. Rows with equal ids are one document when counted, and each
loses the same lines; a null id is a document of its own, the smallest. A text of any length is split whole. An empty
table gives no rows. Other columns are kept by ``drop_common_lines`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_CHARS, MIN_DOCS = 20, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def line_hash(line: Column) -> Column:
    """128 bits of a line's key as a binary value; null for keys that are too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= MIN_CHARS, F.unhex(F.md5(key)))


def lost_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``__ls_doc, __ls_lost``: for each document that loses lines, the hashes of those lines."""
    lines = docs.select(F.col("doc_id").alias("__ls_doc"), F.explode(F.transform(lines_of(F.col("text")), line_hash)).alias("__ls_hash"))
    pairs = lines.where("__ls_hash is not null").distinct()
    common = pairs.groupBy("__ls_hash").agg(F.count(F.lit(1)).alias("__ls_n"), F.max("__ls_doc").alias("__ls_keeper")).where(F.col("__ls_n") >= min_docs)
    lost = pairs.join(common, "__ls_hash").where(~F.col("__ls_doc").eqNullSafe(F.col("__ls_keeper")))
    return lost.groupBy("__ls_doc").agg(F.collect_set("__ls_hash").alias("__ls_lost"))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with their texts' common lines dropped, and ``__ls_lines``, ``__ls_dropped`` (counts of lines)."""
    lost = lost_lines(docs, min_docs).hint("shuffle_merge")
    both = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("__ls_doc")), "left")
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__ls_lost"), line_hash(x)), F.lit(False)))
    # Only documents that lose lines are split again.
    both = both.withColumn("__ls_kept", F.when(F.col("__ls_lost").isNull(), F.array(F.coalesce("text", F.lit("")))).otherwise(kept))
    n_lines = F.size(lines).cast("long")
    both = both.withColumn("__ls_lines", n_lines).withColumn("__ls_dropped", F.when(F.col("__ls_lost").isNull(), F.lit(0)).otherwise(F.col("__ls_lines") - F.size("__ls_kept")).cast("long"))
    return both.withColumn("text", F.array_join("__ls_kept", "\n")).drop("__ls_kept", "__ls_doc", "__ls_lost")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", F.col("__ls_lines").alias("n_lines"), F.col("__ls_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), e'\n')) AS line,
               generate_subscripts(string_split(coalesce(text, ''), e'\n'), 1) AS pos FROM documents) u
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.k IS NOT NULL AND l.doc_id <> c.keeper) AS gone
  FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, e'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
