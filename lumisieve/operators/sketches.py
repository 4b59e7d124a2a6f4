"""Distinct hashes by mergeable sketches: a sketch of each part is stored, and any grouping of the parts is a union of
sketches, without the hashes.

A sketch has 2 ** ``BITS`` registers; its estimate's standard error is about 1.04 / 2 ** (BITS / 2), 1.6 %. Null hashes
are not counted. A group without hashes has the estimate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
#: Standard errors that an estimate is held to.
SIGMAS = 4


def sketched(rows: DataFrame, by: list[str], value: str, bits: int = BITS) -> DataFrame:
    """``by, n, sketch`` of each part: rows and a sketch of their distinct values."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def merged(sketches: DataFrame, by: list[str], subtotals: bool = True) -> DataFrame:
    """``by, n, n_distinct`` of stored sketches; with ``subtotals`` for each subset of ``by``, too, as a cube."""
    groups = sketches.cube(*by) if subtotals else sketches.groupBy(*by)
    return groups.agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def within(estimate: Column, exact: Column, bits: int = BITS) -> Column:
    """Whether an estimate is as near as a sketch of so many bits should be; to one, at least."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * (SIGMAS * 1.04 / 2 ** (bits / 2)))
