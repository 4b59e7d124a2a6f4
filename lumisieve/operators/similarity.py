"""Joins and groups by Hamming distance between hash texts of one length.

Hashes are compared as 64-bit words. Near pairs come from ``hamming``: keys of blocks of bits that widen where many
values meet, for any radius. Equal hashes are one value throughout: pairs are between distinct values, and rows find
their value by a plain join, which adaptive execution splits where a value is very common.

The nearest match deepens the radius: equal values first, then those within 2, 4, 8, ... bits; only values without a match
go on. A radius finds all that is within it, so the nearest of what it finds (of equally near ones the first) is the
nearest of all, and the search stops there. When keys for the next radius cost more than measuring what is left, that is
done in blocks.

Defined cases: a null hash, one of another length than ``digits``, or one that is no lower-case hexadecimal text is near
nothing; ``near_groups`` and ``best_match`` keep its row, in a group of its own and without a match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.hashes import apart, cutoff_of, is_hex, multi_distance, words_of
from . import hamming
from .components import components

#: Golden entries that are measured in one row, shares of the values that meet them where they are too many to be sent to
#: all tasks, and the bytes up to which they are sent.
GOLDEN_BLOCK, GOLDEN_SHARES, GOLDEN_BYTES = 1024, 32, 8 << 20
#: Radii of the nearest match, how many pairs are measured sooner than any keys are made, and how many entries of a block
#: are measured at the cost of one candidate.
RADII, MEASURED, CANDIDATE_COST = (2, 4, 8, 12, 16, 24, 32), 1 << 24, 8


def _sided(left: DataFrame, right: DataFrame, digits: int) -> DataFrame:
    """Distinct hashes as words, with the sides they are of: a table."""
    valid = lambda rows, side: rows.where(F.length("hex") == digits).where(is_hex(F.col("hex"))).select("hex", F.lit(side).alias("sides")).distinct()
    if left is right:
        values = valid(left, hamming.LEFT + hamming.RIGHT)
    else:
        values = valid(left, hamming.LEFT).union(valid(right, hamming.RIGHT)).groupBy("hex").agg(F.bit_or("sides").alias("sides"))
    words = [w.alias(f"w{k}") for k, w in enumerate(hamming.words_in(F.col("hex"), digits))]
    return scratch.written(values.select(*words, "sides"), "near-values")


def near_values(left: DataFrame, right: DataFrame, digits: int, within: int, ordered: bool = False) -> DataFrame:
    """``a, b, distance`` of the distinct hashes ``hex`` of two tables that are at most ``within`` bits apart; ``ordered``:
    only those with a < b."""
    return _near_of(_sided(left, right, digits), digits, within, ordered)


def _near_of(values: DataFrame, digits: int, within: int, ordered: bool = False) -> DataFrame:
    names = [c for c in values.columns if c != "sides"]
    text = lambda side: hamming.hex_of([F.col(f"{side}{k}") for k in range(len(names))], digits)
    found = hamming.pairs(values, names, 4 * digits, within).select(text("a").alias("x"), text("b").alias("y"), "distance", "ways")
    ways = F.explode(F.filter(F.array(F.struct("x", "y", F.lit(1).alias("way")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(2).alias("way"))), lambda p: p["way"].bitwiseAND(F.col("ways")) > 0)).alias("p")
    both = found.select("distance", ways).select(F.col("p.x").alias("a"), F.col("p.y").alias("b"), "distance")
    if ordered:
        return both.where("a < b")
    same = values.where(F.col("sides") == hamming.LEFT + hamming.RIGHT) if within >= 0 else values.limit(0)
    hex_ = hamming.hex_of([F.col(c) for c in names], digits)
    return both.union(same.select(hex_.alias("a"), hex_.alias("b"), F.lit(0).alias("distance")))


def near_rows(left: DataFrame, right: DataFrame, digits: int, within: int) -> DataFrame:
    """Rows of ``left`` with those of ``right`` (each an ``id`` and a ``hex``): ``id, other_id, distance``."""
    values = near_values(left, right, digits, within)
    return left.join(values, left["hex"] == values["a"]).select("id", "b", "distance").join(right.select(F.col("id").alias("other_id"), F.col("hex").alias("b")), "b").select("id", "other_id", "distance")


def near_groups(rows: DataFrame, digits: int, within: int) -> DataFrame:
    """``id, hex, group_id`` (the smallest id that steps of at most ``within`` bits reach) for every row.

    Being near is no equivalence; groups are what chains of near values connect. A row without a hash is alone.
    """
    numbered = rows.where("hex is not null").groupBy("hex").agg(F.min("id").alias("first"))
    pairs = near_values(rows, rows, digits, within, ordered=True)
    links = pairs.join(numbered.toDF("a", "x"), "a").join(numbered.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components(links)
    of_value = numbered.join(groups, F.col("first") == F.col("node"), "left").select("hex", F.coalesce("component", "first").alias("group_id"))
    return rows.join(of_value, "hex", "left").select("id", "hex", F.coalesce("group_id", "id").alias("group_id"))


def _best(values: DataFrame, golden: DataFrame, own: str, distance, n_bytes: int) -> DataFrame:
    """``values`` (own) with ``best`` (distance, ordinal) of the golden entries (own, ordinal).

    Entries are gathered in blocks of about GOLDEN_BLOCK, and an expression measures a whole block, so that what is
    between is never a row for each pair. Entries of at most GOLDEN_BYTES are sent to all tasks; more are dealt with copies
    for each share of the values.
    """
    n = golden.count()
    block = F.pmod(F.xxhash64("ordinal", own), F.lit(max(1, -(-n // GOLDEN_BLOCK)))).alias("block")
    blocks = golden.groupBy(block).agg(F.collect_list(F.struct("ordinal", F.col(own).alias("value"))).alias("known"))
    if n_bytes <= GOLDEN_BYTES:
        met = values.withColumn("share", F.lit(0)).join(F.broadcast(blocks.withColumn("share", F.lit(0))), "share")
    else:
        dealt = values.withColumn("share", F.pmod(F.xxhash64(own), F.lit(GOLDEN_SHARES)).cast("int"))
        met = dealt.join(blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(GOLDEN_SHARES - 1)))).hint("merge"), "share")
    best = F.array_min(F.transform("known", lambda g: F.struct(distance(F.col(own), g["value"]).alias("distance"), g["ordinal"].alias("ordinal"))))
    return met.groupBy(*values.columns).agg(F.min(best).alias("best"))


def best_match(rows: DataFrame, golden: DataFrame, digits: int) -> DataFrame:
    """For each row (id, hex) the nearest of ``golden`` (ordinal, hex), the first of equally near ones; nulls without."""
    valid = lambda t: t.where(F.length("hex") == digits).where(is_hex(F.col("hex")))
    known = scratch.written(valid(golden).groupBy("hex").agg(F.min("ordinal").alias("ordinal")), "golden")
    left = scratch.written(valid(rows).select("hex").distinct(), "unmatched")
    struct = F.struct(F.col("distance").cast("int").alias("distance"), "ordinal")
    equal = left.join(known, "hex").withColumn("distance", F.lit(0)).select("hex", struct.alias("best"))
    parts, left = [scratch.written(equal, "matched")], scratch.written(left.join(known.select("hex"), "hex", "left_anti"), "unmatched")
    n_known = known.count()
    for within in RADII:
        n = left.count()
        if float(n) * n_known <= MEASURED or within >= 4 * digits:
            break
        if hamming.plan(n + n_known, float(n * n_known), 4 * digits, within)[0] == 0:
            break
        near = near_values(left, known, digits, within).join(known.select(F.col("hex").alias("b"), "ordinal"), "b")
        found = scratch.written(near.groupBy(F.col("a").alias("hex")).agg(F.min(struct).alias("best")), "matched")
        parts.append(found)
        left = scratch.written(left.join(found.select("hex"), "hex", "left_anti"), "unmatched")
    words = lambda t, *more: t.select(*more, words_of(F.col("hex")).alias("own"))
    parts.append(_best(words(left, "hex"), words(known, "ordinal"), "own", apart, n_known * (digits // 2 + 32)).select("hex", "best"))
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    return rows.join(best, "hex", "left").select("id", "hex", F.col("best.ordinal").alias("ordinal"), F.col("best.distance").alias("distance"))


def best_multi_match(rows: DataFrame, golden: DataFrame, cutoff: float | None = None, rate: float | None = None) -> DataFrame:
    """For each row (id, own: the hashes of its segments) the golden entry (ordinal, own) of the smallest multi-hash
    distance, the first of equally near ones; nulls for a row without segments.

    An entry without a near segment is as far as any other such one. So only entries that share a near pair of segments,
    found by keys, are measured, beside the first of all; where these are most of all entries, all are, in blocks.
    """
    some = lambda t, *more: t.where(F.size("own") > 0).select(*more, "own")
    values, known = scratch.written(some(rows.select("own").distinct()), "multi-values"), scratch.written(some(golden, "ordinal"), "multi-golden")
    score = lambda a, b: multi_distance(a, b, cutoff, rate)
    n_values = values.count()
    n_known, n_bytes, first = known.agg(F.count(F.lit(1)), F.sum(F.length(F.concat_ws(",", "own")) + 32), F.min("ordinal")).first()
    met = _near_entries(values, known, cutoff, rate, n_values * n_known) if n_values * n_known > MEASURED else None
    if met is None:
        best = _best(values, known, "own", score, n_bytes or 0)
    else:
        found = met.join(known.withColumnRenamed("own", "other"), "ordinal")
        found = found.select("own", F.struct(score(F.col("own"), F.col("other")).alias("distance"), "ordinal").alias("best"))
        far = values.select("own", F.struct(F.size("own").cast("double").alias("distance"), F.lit(first).cast(known.schema["ordinal"].dataType).alias("ordinal")).alias("best"))
        best = found.union(far).groupBy("own").agg(F.min("best").alias("best"))
    return rows.join(best, "own", "left").select("id", F.col("best.ordinal").alias("ordinal"), F.col("best.distance").alias("distance"))


def _near_entries(values: DataFrame, known: DataFrame, cutoff: float | None, rate: float | None, n_all: int) -> DataFrame | None:
    """``own, ordinal`` of values and entries with a near pair of segments; None if keys cost more than all ``n_all``."""
    limit = F.floor(cutoff_of(F.get("own", F.lit(0)), cutoff, rate)).cast("int").alias("within")
    mine = values.select("own", limit, F.explode(F.array_distinct("own")).alias("hex"))
    theirs = known.select("ordinal", F.explode(F.array_distinct("own")).alias("hex"))
    of = lambda t: t.withColumn("digits", F.length("hex"))
    # Sizes of hashes and cutoffs that the tables have: one row for each kind of hash.
    kinds = of(mine).select("digits", "within").distinct().join(of(theirs).select("digits").distinct(), "digits").where("digits > 0").collect()
    cost, sides = 0.0, []
    for kind in kinds:
        digits, within = kind["digits"], kind["within"]
        one, two = (of(t).where(F.col("digits") == digits) for t in (mine.where(F.col("within") == within), theirs))
        sided = _sided(one, two, digits)
        n, meet = hamming.sized(sided)
        m, price = hamming.plan(n, meet, 4 * digits, within) if within < 4 * digits else (0, meet)
        if meet and not m:
            return None
        cost += price
        sides.append((digits, within, sided, one, two))
    if cost >= n_all * CANDIDATE_COST * 8:
        return None
    out = None
    for digits, within, sided, one, two in sides:
        near = scratch.written(_near_of(sided, digits, within), "near-segments")
        counts = lambda t, name, n: t.groupBy(F.col("hex").alias(name)).agg(F.count(F.lit(1)).alias(n))
        rows = near.join(counts(one, "a", "p"), "a").join(counts(two, "b", "q"), "b").agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0
        if rows * CANDIDATE_COST > n_all:
            return None
        met = one.select("own", F.col("hex").alias("a")).join(near, "a").select("own", "b").join(two.select("ordinal", F.col("hex").alias("b")), "b").select("own", "ordinal")
        out = met if out is None else out.union(met)
    return None if out is None else out.distinct()


def known(rows: DataFrame, golden: DataFrame, missing: bool = False) -> DataFrame:
    """Rows whose hash is (or is not) one of a golden set's."""
    return rows.join(golden.select("hex").distinct(), "hex", "left_anti" if missing else "left_semi")


def largest(rows: DataFrame, by: list[str], size: str, ordinal: str, k: int) -> DataFrame:
    """The ``k`` largest rows of each group, of equally large ones the first, with their ``rank``."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), F.asc(ordinal))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def before(rows: DataFrame, by: str, order: str, value: str, span: int = 4096) -> DataFrame:
    """``rows`` with ``before``: the value of the row before, of those with the same ``by``, in the order of a whole number.

    Rows are looked at in stretches of ``span`` numbers, so a long series is many tasks' work; only the last rows of the
    stretches form a series of their own.
    """
    dealt = rows.withColumn("__ls_span", F.floor(F.col(order) / span))
    inner = dealt.withColumn("__ls_inner", F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(by, "__ls_span").orderBy(order)))
    lasts = dealt.groupBy(by, "__ls_span").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__ls_last"))
    lasts = lasts.withColumn("__ls_outer", F.lag("__ls_last").over(Window.partitionBy(by).orderBy("__ls_span"))).drop("__ls_last")
    same = inner[by].eqNullSafe(lasts[by]) & inner["__ls_span"].eqNullSafe(lasts["__ls_span"])
    return inner.join(lasts, same, "left").select(*[inner[c] for c in rows.columns], F.coalesce("__ls_inner", "__ls_outer")["v"].alias("before"))
