"""As-of join: each row with the latest reference of its key until its time.

Rows and references are one table, sorted by key and time in ranges that Spark's sample makes about as large; a long
series is many ranges. Within a range a window carries the last reference on; over ranges the last ones of each are
carried by a window that has one row for each range of a key. References at a row's own time count; of several at one
time the one with the greatest values does.

Defined cases: rows with a null key or time have no reference, and such references are nobody's; rows that repeat are
kept; a row without an earlier reference has nulls; empty tables on either side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch


def latest(rows: DataFrame, references: DataFrame, by: list[str], time: str) -> DataFrame:
    """``rows`` with the other columns of ``references`` (both with ``by`` and ``time``)."""
    values = [c for c in references.columns if c not in (*by, time)]
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, time)])
    keys = [F.col(c).alias(f"__ls_by{k}") for k, c in enumerate(by)] + [F.col(time).alias("__ls_time")]
    held = F.struct(*[F.col(c) for c in values])
    left = rows.where(known).select(*keys, F.lit(1).alias("__ls_kind"), F.struct(*rows.columns).alias("__ls_row"))
    right = references.where(known).select(*keys, F.lit(0).alias("__ls_kind"), held.alias("__ls_ref"))
    both = left.unionByName(right, allowMissingColumns=True)
    by_names = [f"__ls_by{k}" for k in range(len(by))]
    order = [*by_names, "__ls_time", "__ls_kind", "__ls_ref", "__ls_id"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.withColumn("__ls_id", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Within a range, the id grows by one a row.
    ordered = scratch.written(ordered.drop("__ls_id").withColumn("__ls_at", F.monotonically_increasing_id()), "asof")
    ordered = ordered.withColumn("__ls_range", F.shiftright("__ls_at", 33))
    inner = Window.partitionBy(*by_names, "__ls_range").orderBy("__ls_at").rowsBetween(Window.unboundedPreceding, 0)
    carried = ordered.withColumn("__ls_near", F.last("__ls_ref", ignorenulls=True).over(inner)).where("__ls_kind = 1")
    lasts = ordered.groupBy(*by_names, "__ls_range").agg(F.max_by("__ls_ref", F.when(F.col("__ls_kind") == 0, F.col("__ls_at"))).alias("__ls_last"))
    before = Window.partitionBy(*by_names).orderBy("__ls_range").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("__ls_far", F.last("__ls_last", ignorenulls=True).over(before)).drop("__ls_last")
    met = carried.join(lasts, [*by_names, "__ls_range"], "left").withColumn("__ls_ref", F.coalesce("__ls_near", "__ls_far"))
    out = met.select("__ls_row.*", *[F.col("__ls_ref")[c].alias(c) for c in values])
    alone = rows.where(~known).select("*", *[F.lit(None).cast(references.schema[c].dataType).alias(c) for c in values])
    return out.unionByName(alone)
