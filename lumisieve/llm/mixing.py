"""Mixing sources to target weights (operator 2), with DataFrame functions only.

* Targets: the wanted total is shared by weight; a source whose share is above ``max_epochs`` times its size is clamped
  there, and what that leaves is shared by weight among the others, until none is above (capped water-filling). Each
  round is one aggregation over the table of sources, which Spark holds; only two sums come to the driver.
* Taking: every document of a source is taken ``floor(target / size of source)`` whole times. For the fractional
  repetition the source's documents stand in the order of a seeded hash, and are taken from the start until the
  target's words are full; the one document at the end is taken in part. So a source's words are exactly
  ``floor(target)``, the order does not depend on partitions, and reruns agree.
* Where that order ends is found as in a radix selection: sums by (source, first 12 bits of the hash), then by the next
  12 bits within the one bucket where the sum is reached, then the last 12. A source with a third of all rows is
  pre-aggregated to 4096 sums like any other, and no window sees more than 4096 sums.
* The rows at the end's own hash are one document, but null or often repeated ids may be a third of the table. They are
  sorted by source, id, size and text in ranges that split equal rows, too, and prefix sums over the ranges place them.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a null id hashes as an
empty one; rows with equal ids are taken each for itself; a text of any length is counted whole. With no rows, or no
words at all, nothing is taken. Other columns are kept by ``mix`` whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
WORD, SALTS, FEW_SOURCES = r"[^\x20\x09-\x0D]+", 64, 10_000
_KEY, _SIZE, _HASH, _UPTO = "__ls_key", "__ls_size", "__ls_hash", "__ls_words_upto"


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def seeded_hash(doc_id: Column, seed: str) -> Column:
    """36 bits of the document's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 9), 16, 10).cast("long")


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.withColumns({_KEY: source_key(F.col("source")), _SIZE: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), _HASH: seeded_hash(F.col("doc_id"), seed)})


def ranked(sources: DataFrame) -> DataFrame:
    """The table of sources with each one's place (from 0) in the order of keys, without gathering them in one task."""
    placed = scratch.written(sources.orderBy(_KEY).withColumn("mid", F.monotonically_increasing_id()), "op2-sources")
    part = F.shiftright("mid", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(before, part == F.col("part")).withColumn("place", F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1)).drop("mid", "part", "before")


def water_filled(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (key, source_size, weight) with ``target``; ``share`` is the wanted total as a part of all sizes."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    wanted, level = min(share, float(max_epochs)) * total, 0.0
    while True:
        over = cap.cast("double") < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(over, cap)).alias("clamped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break
        higher = (wanted - (row["clamped"] or 0)) / row["free"]
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """Per source: ``source_size, target, whole`` (times that all is taken), the hash at which the fractional
    repetition ends (``end_hash``) and the words to take from there (``end_words``). Also the number of sources."""
    sizes = docs.groupBy(_KEY).agg(F.sum(_SIZE).alias("source_size"))
    weight = reduce(lambda c, i: c.when(F.col("place") % len(weights) == i, weights[i]), range(1, len(weights)), F.when(F.col("place") % len(weights) == 0, weights[0]))
    sources = scratch.written(ranked(sizes).withColumn("weight", weight), "op2-ranked")
    filled = water_filled(sources, share, max_epochs).drop("place", "weight")
    size = F.col("source_size")
    filled = filled.withColumn("whole", F.when(size > 0, F.floor(F.floor("target") / size)).otherwise(0).cast("long"))
    filled = scratch.written(filled.withColumn("need", F.floor("target").cast("long") - F.col("whole") * size), "op2-targets")
    found = filled.select(_KEY, "need", F.lit(0).cast("long").alias("end_hash"))
    inside = docs.select(_KEY, _SIZE, _HASH)
    for shift in (24, 12, 0):
        # Only the bucket in which the last round ended is looked at again; the join's keys spread a large source.
        if shift < 24:
            inside = inside.withColumn("prefix", F.shiftright(_HASH, shift + 12)).join(found.select(_KEY, F.shiftright("end_hash", shift + 12).alias("prefix")), [_KEY, "prefix"]).drop("prefix")
        sums = inside.groupBy(_KEY, F.shiftright(_HASH, shift).alias("bucket")).agg(F.sum(_SIZE).alias("words"))
        upto = F.sum("words").over(Window.partitionBy(_KEY).orderBy("bucket"))
        ends = sums.withColumn("before", upto - F.col("words")).withColumn("upto", upto).join(found.select(_KEY, "need"), _KEY)
        ends = ends.where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("upto")))
        found = scratch.written(ends.select(_KEY, (F.col("need") - F.col("before")).alias("need"), F.shiftleft("bucket", shift).alias("end_hash")), "op2-ends")
    # A source without words has no end: nothing is taken.
    end = found.withColumnRenamed("need", "end_words")
    out = scratch.written(filled.drop("need").join(end, _KEY, "left").fillna({"end_hash": -1, "end_words": 0}), "op2-shares")
    return out, out.count()


def _with_upto(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_UPTO``: the words of a source up to the row, in the order of id, size and text."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [_KEY, "doc_id", _SIZE, *(["text"] if "text" in rows.columns else []), "__ls_row"]
    placed = scratch.written(rows, "op2-last").withColumn("__ls_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Within a range, the id grows by one a row.
    placed = scratch.written(placed.drop("__ls_row").withColumn("__ls_at", F.monotonically_increasing_id()), "op2-placed")
    placed = placed.withColumn("__ls_range", F.shiftright("__ls_at", 33))
    sums = placed.groupBy(_KEY, "__ls_range").agg(F.sum(_SIZE).alias("__ls_sum"))
    before = F.sum("__ls_sum").over(Window.partitionBy(_KEY).orderBy("__ls_range")) - F.col("__ls_sum")
    inside = F.sum(_SIZE).over(Window.partitionBy(_KEY, "__ls_range").orderBy("__ls_at").rowsBetween(Window.unboundedPreceding, 0))
    both = placed.withColumn(_UPTO, inside).join(sums.withColumn("__ls_before", before).drop("__ls_sum"), [_KEY, "__ls_range"])
    return both.withColumn(_UPTO, F.col(_UPTO) + F.col("__ls_before")).select(*rows.columns, _UPTO)


def with_taken(docs: DataFrame, found: DataFrame, n_sources: int) -> DataFrame:
    """``docs`` with their source's shares and ``__ls_taken``: the words that the mix takes, repeats counted. The shares
    of up to ``FEW_SOURCES`` sources are broadcast, those of more are joined by salted keys; the rows are the same."""
    if n_sources <= FEW_SOURCES:
        both = docs.join(F.broadcast(found), _KEY)
    else:
        salted = found.withColumn("__ls_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = docs.withColumn("__ls_salt", F.col(_HASH) % SALTS).join(salted, [_KEY, "__ls_salt"]).drop("__ls_salt")
    whole, size = F.col("whole") * F.col(_SIZE), F.col(_SIZE)
    sure = both.where(F.col(_HASH) != F.col("end_hash")).withColumn("__ls_part", F.when(F.col(_HASH) < F.col("end_hash"), size).otherwise(0).cast("long"))
    last = _with_upto(both.where(F.col(_HASH) == F.col("end_hash")))
    rest = F.col("end_words") - F.col(_UPTO) + size
    last = last.withColumn("__ls_part", F.greatest(F.lit(0), F.least(size, rest)).cast("long")).drop(_UPTO)
    return sure.unionByName(last).withColumn("__ls_taken", whole + F.col("__ls_part"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) as the mix has them: a row for each whole repetition, and for the
    fractional one the whole text or, once in a source, its first words."""
    own, rows = docs.columns, measured(docs)
    found, n = shares(scratch.written(rows.select(_KEY, _SIZE, _HASH), "op2-sizes"), **options)
    taken = with_taken(rows, found.drop("source_size", "target"), n)
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("__ls_words") == F.col(_SIZE), F.col("text")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.col("__ls_words").cast("int")), ""))
    times = F.concat(F.array_repeat(F.col(_SIZE), F.col("whole").cast("int")), F.array("__ls_part"))
    out = taken.where("__ls_taken > 0").withColumn("__ls_words", F.explode(F.filter(times, lambda x: x > 0))).withColumn("text", text)
    return out.select(*own)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    narrow = scratch.written(measured(docs).drop("text"), "op2-sizes")
    found, n = shares(narrow)
    return with_taken(narrow, found, n).select("doc_id", F.col(_SIZE).alias("size"), "source_size", "target", F.col("__ls_taken").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY k
), o AS (
  SELECT k, source_size, w,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS wanted, sum(w) OVER () AS all_w,
         2 * (sum(source_size) OVER (ORDER BY source_size / w, k) - source_size) AS clamped,
         sum(w) OVER (ORDER BY source_size / w, k) - w AS clamped_w
  FROM s
), l AS (
  SELECT lambda_ AS lvl FROM (
    SELECT (wanted - CAST(clamped AS DOUBLE)) / CAST(all_w - clamped_w AS DOUBLE) AS lambda_, k, source_size, w FROM o) x
  WHERE 2.0 * source_size >= lambda_ * w
  ORDER BY source_size / w, k LIMIT 1
), t AS (
  SELECT k, source_size, least(CAST(2 * source_size AS DOUBLE), (SELECT lvl FROM l) * w) AS target FROM s
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole,
         CAST(floor(n.target) AS BIGINT) - n.whole * n.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN n ON d.k = n.k
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, need - upto + size)) AS BIGINT) AS taken
FROM c
"""
