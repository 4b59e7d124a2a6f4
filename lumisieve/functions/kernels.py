"""Steps on whole planes as Column expressions: resampling, cosine and wavelet transforms, blur, median, and the hashes
made of them.

A plane is an array of rows of numbers. Every step but the median works along rows; the other direction is the same
step between two ``turned``. An image is one row of a table throughout, so nothing is shuffled and any number of
images is any number of independent tasks. The NumPy steps of ``raster`` do the same inside Arrow batches, for images of
many pixels; both give equal bits, and tests and SQL hold them against each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hashes as H
from .image_hash import ROBUST, SNAP
from .raster import DB4_LOW, HALF_ROOT, REACH, WEIGHT_BITS


def plane_of(flat: Column, width: Column | int, height: Column | int) -> Column:
    """The rows of an array of numbers."""
    w, h = _whole(width), _whole(height)
    return F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.slice(flat, y * w + 1, w))


def flat_of(plane: Column) -> Column:
    return F.flatten(plane)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def turned(plane: Column) -> Column:
    """Rows as columns."""
    return let(plane, lambda p: F.transform(F.sequence(F.lit(0), F.size(F.get(p, F.lit(0))) - 1), lambda x: F.transform(p, lambda row: F.get(row, x))))


def both_ways(plane: Column, step: Callable[[Column], Column], then: Callable[[Column], Column] | None = None) -> Column:
    """A step along each row, and then the same or another one along each column."""
    return turned(F.transform(turned(F.transform(plane, step)), then or step))


def _whole(v: Column | int) -> Column:
    return F.lit(v) if isinstance(v, int) else v


def dot(a: Column, b: Column, zero: Column) -> Column:
    """The sum of products, from the first to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, v: s + v)


# ---- resampling


def lanczos_weights(source: Column | int, target: int) -> Column:
    """For each place of a row of ``target``: the first place of the source that adds to it, and what each one adds, as
    whole numbers of 2 ** -WEIGHT_BITS."""
    n = _whole(source)

    def sinc(x: Column) -> Column:
        return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))

    def near(x: Column) -> Column:
        return F.when(F.abs(x) < REACH, sinc(x) * sinc(x / REACH)).otherwise(0.0)

    def of(middle: Column, wide: Column) -> Column:
        lo = F.greatest(F.lit(0), (middle - wide * REACH + 0.5).cast("int"))
        hi = F.least(n.cast("int"), (middle + wide * REACH + 0.5).cast("int"))
        raw = F.transform(F.transform(F.sequence(lo, hi - 1), lambda s: (s + 0.5 - middle) / wide), near)
        return F.struct(lo.alias("lo"), raw.alias("w"))

    def whole(q: Column) -> Column:
        total = F.aggregate(q["w"], F.lit(0.0), lambda a, v: a + v)
        unit = let(total, lambda t: F.transform(q["w"], lambda v: v / t * float(1 << WEIGHT_BITS)))
        return F.struct(q["lo"].alias("lo"), F.transform(unit, lambda v: (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("long")).alias("w"))

    def places(scale: Column) -> Column:
        middles = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda k: (k + 0.5) * scale)
        return let(F.greatest(F.lit(1.0), scale), lambda wide: F.transform(F.transform(middles, lambda m: of(m, wide)), whole))

    return let(n.cast("double") / F.lit(float(target)), places)


def resampled(row: Column, weights: Column) -> Column:
    """A row of bytes at other places, rounded to bytes."""
    def at(q: Column) -> Column:
        total = dot(F.slice(row, q["lo"] + 1, F.size(q["w"])), q["w"], F.lit(1 << (WEIGHT_BITS - 1)).cast("long"))
        return F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(total, WEIGHT_BITS))).cast("int")

    return F.transform(weights, at)


def resized(plane: Column, across: Column, down: Column) -> Column:
    """Lanczos, along rows first, by the weights of both directions, which are made once an image (named in a lambda as
    they are, they would be made for each row, and Spark puts a column's expression there as well)."""
    return let(F.struct(across.alias("across"), down.alias("down")), lambda w: both_ways(plane, lambda row: resampled(row, w["across"]), lambda row: resampled(row, w["down"])))


def with_resized(table, name: str, plane: str, width: Column | int, height: Column | int, to_width: int, to_height: int):
    """``table`` with the plane ``name``: the plane of another column, resized."""
    return table.withColumn(name, resized(F.col(plane), lanczos_weights(width, to_width), lanczos_weights(height, to_height)))


# ---- cosine transform


def cosine(row: Column, size: int, keep: int) -> Column:
    """The first ``keep`` coefficients of a row of ``size`` numbers: twice the plain sums."""
    table = F.array(*[F.array(*[F.lit(2 * math.cos(math.pi * k * (2 * x + 1) / (2 * size))) for x in range(size)]) for k in range(keep)])
    return F.transform(table, lambda c: dot(row, c, F.lit(0.0)))


# ---- wavelets


def _pair(row: Column, sign: int) -> Column:
    """Sums or differences of neighbours, the last one repeated where it has none."""
    last = F.size(row) - 1
    places = F.sequence(F.lit(0), F.floor(last / 2).cast("int"))
    return F.transform(places, lambda i: F.get(row, i * 2) * HALF_ROOT + sign * (F.get(row, F.least(i * 2 + 1, last)) * HALF_ROOT))


def haar_low(row: Column) -> Column:
    return _pair(row, 1)


def haar_high(row: Column) -> Column:
    return _pair(row, -1)


def haar_joined(low: Column, high: Column) -> Column:
    """The row whose low and high halves these are."""
    each = F.zip_with(low, high, lambda a, b: F.array(a * HALF_ROOT + b * HALF_ROOT, a * HALF_ROOT - b * HALF_ROOT))
    return F.flatten(each)


def haar_bands(plane: Column) -> dict[str, Column]:
    """One level: ``ll``, and the details ``lh``, ``hl``, ``hh`` (first letter: between rows, second: between columns)."""
    low, high = (turned(F.transform(turned(plane), step)) for step in (haar_low, haar_high))
    return {"ll": F.transform(low, haar_low), "lh": F.transform(low, haar_high), "hl": F.transform(high, haar_low), "hh": F.transform(high, haar_high)}


def haar_whole(bands: dict[str, Column]) -> Column:
    """The plane of one level's bands."""
    low, high = F.zip_with(bands["ll"], bands["lh"], haar_joined), F.zip_with(bands["hl"], bands["hh"], haar_joined)
    return turned(F.zip_with(turned(low), turned(high), haar_joined))


def haar_tower(table, plane: str, levels: int, name: str = "haar"):
    """``table`` with ``<name><k>``: a struct of the bands of each level; the next level is that of ``ll``."""
    ll = F.col(plane)
    for k in range(1, levels + 1):
        table = table.withColumn(f"{name}{k}", F.struct(*[v.alias(b) for b, v in haar_bands(ll).items()]))
        ll = F.col(f"{name}{k}.ll")
    return table


def haar_back(table, levels: int, name: str = "haar", out: str = "whole", without_mean: bool = False):
    """``table`` with ``out``: the plane of a tower's bands; ``without_mean`` sets the last low band to zero."""
    ll = F.col(f"{name}{levels}.ll")
    if without_mean:
        ll = F.transform(ll, lambda row: F.transform(row, lambda v: F.lit(0.0)))
    for k in range(levels, 0, -1):
        bands = {b: F.col(f"{name}{k}.{b}") for b in ("lh", "hl", "hh")}
        table = table.withColumn(out, haar_whole({"ll": ll, **bands}))
        ll = F.col(out)
    return table


def _mirrored(row: Column, at: Column, n: Column) -> Column:
    """A row's number at any place, mirrored at its edges, which are repeated."""
    p = F.pmod(at, n * 2)
    return F.get(row, F.least(p, n * 2 - 1 - p).cast("int"))


#: The high-pass filter that belongs to the low one: its taps backwards with every second sign turned.
DB4_HIGH = tuple(-v if k % 2 == 0 else v for k, v in enumerate(reversed(DB4_LOW)))


def db4_half(row: Column, taps: tuple[float, ...] = DB4_LOW) -> Column:
    """Half of the places of a row, filtered; taps are added in their order."""
    n = F.size(row)
    places = F.sequence(F.lit(0), F.floor((n + 7) / 2).cast("int") - 1)

    def at(i: Column) -> Column:
        total = F.lit(0.0)
        for k, tap in enumerate(taps):
            total = total + F.lit(tap) * _mirrored(row, i * 2 + (1 - k), n)
        return total

    return F.transform(places, at)


def db4_joined(low: Column, high: Column, size: Column | int) -> Column:
    """The row of ``size`` numbers whose two filtered halves these are."""
    n = F.size(low)

    def at(x: Column) -> Column:
        total = F.lit(0.0)
        for half, taps in ((low, DB4_LOW), (high, DB4_HIGH)):
            for j in range(4):
                # Place x of the row is in the windows of the halves' places from x // 2 on.
                i = F.floor(x / 2).cast("int") + j
                k = i * 2 + 1 - x
                tap = F.get(F.array(*[F.lit(t) for t in taps]), k)
                total = total + F.when(i < n, F.coalesce(tap, F.lit(0.0)) * F.coalesce(F.get(half, i), F.lit(0.0))).otherwise(0.0)
        return total

    return F.transform(F.sequence(F.lit(0), _whole(size) - 1), at)


# ---- blur and median


def box_of(radius: float, passes: int) -> tuple[int, int, int]:
    """Whole radius of a box, and the weights of its places and of the two beyond, in units of 2 ** -24."""
    variance = radius * radius / passes
    whole = math.floor((math.sqrt(12 * variance + 1) - 1) / 2)
    box = whole + (2 * whole + 1) * (whole * (whole + 1) - 3 * variance) / (6 * (variance - (whole + 1) ** 2))
    inner = int((1 << 24) / (box * 2 + 1))
    return int(box), inner, ((1 << 24) - (2 * int(box) + 1) * inner) // 2


def _widened(row: Column, by: int) -> Column:
    """A row with its edges repeated beyond them."""
    return F.concat(F.array_repeat(F.get(row, F.lit(0)), by), row, F.array_repeat(F.get(row, F.size(row) - 1), by))


def boxed(row: Column, radius: int, inner: int, outer: int) -> Column:
    """One pass of a box over a row of bytes, edges repeated, rounded to bytes. Sums of boxes are differences of the
    row's running sums, so a pass costs the same for any radius."""
    n = F.size(row)
    if radius <= 2:

        def summed(wide: Column) -> Column:
            at = lambda x: F.get(wide, x).cast("long")
            near = lambda x: reduce(lambda a, b: a + b, [at(x + d) for d in range(1, 2 * radius + 2)])
            return F.transform(F.sequence(F.lit(0), F.size(wide) - 2 * radius - 3), lambda x: F.shiftright(near(x) * inner + (at(x) + at(x + 2 * radius + 2)) * outer + (1 << 23), 24).cast("int"))

        return let(_widened(row, radius + 1), summed)
    at = lambda x: F.get(row, F.least(n - 1, F.greatest(F.lit(0), x))).cast("long")
    wide = _widened(row, radius)
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums"))
    grown = F.aggregate(wide, state, lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.array_append(s["sums"], s["sum"] + v).alias("sums")), lambda s: s["sums"])
    zero = F.concat(F.array(F.lit(0).cast("long")), grown)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.shiftright((F.get(zero, x + 2 * radius + 1) - F.get(zero, x)) * inner + (at(x - radius - 1) + at(x + radius + 1)) * outer + (1 << 23), 24).cast("int"))


def blurred(plane: Column, radius: float = 2.0, passes: int = 3) -> Column:
    """Gaussian blur as box blurs of a fractional radius, along rows and then along columns."""
    r, inner, outer = box_of(radius, passes)
    for _ in range(2):
        for _ in range(passes):
            plane = F.transform(plane, lambda row: boxed(row, r, inner, outer))
        plane = turned(plane)
    return plane


def median3(plane: Column) -> Column:
    """The fifth of each place's nine neighbours in order, edges repeated."""
    return let(plane, _median3)


def _median3(plane: Column) -> Column:
    """Three above each other are put in order first; of the nine, the fifth is the middle one of the largest of the least,
    the middle of the middle ones and the least of the largest."""
    middle = lambda a, b, c: F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))

    def ordered(rows: Column, y: Column) -> Column:
        upper, own, lower = (F.get(rows, y + d) for d in range(3))
        return F.transform(F.arrays_zip(upper.alias("a"), own.alias("b"), lower.alias("c")), lambda t: F.struct(F.least(t["a"], t["b"], t["c"]).alias("lo"), middle(t["a"], t["b"], t["c"]).alias("mid"), F.greatest(t["a"], t["b"], t["c"]).alias("hi")))

    def fifth(a: Column, b: Column, c: Column) -> Column:
        return middle(F.greatest(a["lo"], b["lo"], c["lo"]), middle(a["mid"], b["mid"], c["mid"]), F.least(a["hi"], b["hi"], c["hi"]))

    def along(wide: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(wide) - 3), lambda x: fifth(F.get(wide, x), F.get(wide, x + 1), F.get(wide, x + 2)))

    return let(_widened(plane, 1), lambda rows: F.transform(F.sequence(F.lit(0), F.size(rows) - 3), lambda y: let(_widened(ordered(rows, y), 1), along)))


# ---- hashes


def phash_bits(plane: Column, side: int, n: int) -> Column:
    """Bits of a plane of ``side`` x ``side`` bytes: low frequencies above their median."""
    low = F.flatten(both_ways(_doubles(plane), lambda row: cosine(row, side, n)))
    return let(low, lambda v: H.above(v, H.median_of(v), SNAP))


def phash_simple_bits(plane: Column, side: int, n: int) -> Column:
    """The same along rows only, of the first rows, without the first coefficient, above the mean."""
    low = F.flatten(F.transform(F.slice(_doubles(plane), 1, n), lambda row: F.slice(cosine(row, side, n + 1), 2, n)))
    return let(low, lambda v: H.above(v, H.mean_of(v), SNAP))


def _doubles(plane: Column) -> Column:
    return F.transform(plane, lambda row: F.transform(row, lambda v: v.cast("double")))


def with_wavelet_bits(table, name: str, plane: str, side: int, n: int, kind: str = "haar", robust: bool = False):
    """``table`` with the bits ``name`` of a plane of ``side`` x ``side`` bytes (a power of 2, at least ``n``): the mean is
    taken out by a whole Haar transform and its inverse, then levels down to ``n`` are above their median."""
    deepest, levels = side.bit_length() - 1, side.bit_length() - n.bit_length()
    made = table.withColumn("__ls_unit", F.transform(plane, lambda row: F.transform(row, lambda v: v.cast("double") / 255.0)))
    made = haar_back(haar_tower(made, "__ls_unit", deepest, "__ls_haar"), deepest, "__ls_haar", "__ls_flat", without_mean=True)
    for k in range(levels):
        step = haar_low if kind == "haar" else (lambda row: db4_half(row))
        # Columns first: bands between rows come first in ``haar_bands`` too.
        made = made.withColumn("__ls_flat", F.transform(turned(F.transform(turned(F.col("__ls_flat")), step)), step))
    low = F.flatten("__ls_flat")
    if robust:
        low = F.transform(low, lambda v: F.when(F.abs(v) < ROBUST, 0.0).otherwise(v))
    made = made.withColumn("__ls_low", low)
    bits = H.above(F.col("__ls_low"), H.median_of(F.col("__ls_low")), SNAP if kind != "haar" else 0.0)
    return made.withColumn(name, bits).drop("__ls_unit", "__ls_flat", "__ls_low", *[f"__ls_haar{k}" for k in range(1, deepest + 1)])
