"""Hash values as Column expressions: bits, hexadecimal text, distances.

A hash is ``array<int>`` of zeros and ones, row by row, or its text: the bits as one big number in lower-case
hexadecimal, padded in front to whole digits. Distances are taken between words of 64 bits (the last one shorter), so
hashes of any length stay in native expressions; joins make the words once for each hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is added to a median or mean before a strict comparison; the default share of differing bits.
SNAP, BIT_ERROR_RATE = 1e-10, 0.25


def above(values: Column, threshold: Column, snap: float = 0.0) -> Column:
    """One where a value exceeds the threshold by more than ``snap``."""
    # The threshold is an array beside the values: within a lambda it would be computed for each of them.
    return F.zip_with(values, F.array_repeat(threshold + snap if snap else threshold, F.size(values)), lambda v, t: (v > t).cast("int"))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def median_of(values: Column) -> Column:
    """The middle value, or the mean of the two in the middle."""
    n, s = F.size(values), F.array_sort(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def average_bits(plane: Column, mean: Column | None = None) -> Column:
    """Bits of a plane that has the hash's own size: brighter than its mean, or than another one that is given."""
    return above(plane, mean_of(plane) if mean is None else mean)


def difference_bits(plane: Column, width: int, height: int, vertical: bool = False) -> Column:
    """Bits of a plane one column (or row) larger than the hash: brighter than the left (or upper) neighbour."""
    step, w, h = (width, width, height - 1) if vertical else (1, width - 1, height)
    at = [y * width + x for y in range(h) for x in range(w)]
    return F.array(*[(F.get(plane, F.lit(i + step)) > F.get(plane, F.lit(i))).cast("int") for i in at])


def to_hex(bits: Column, n: int) -> Column:
    """The text of ``n`` bits."""
    parts, lo = [], 0
    while lo < n:
        size = (n - lo) % 64 or 64  # whole words but for the first
        number = F.aggregate(F.slice(bits, lo + 1, size), F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, 1).bitwiseOR(v.cast("long")))
        parts.append(F.lpad(F.lower(F.hex(number)), (size + 3) // 4, "0"))
        lo += size
    return F.concat(*parts)


def is_hex(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]+$"), F.lit(False))


def side_of(text: Column) -> Column:
    """The side of the square hash that a text holds; null if it is no lower-case hexadecimal or its bits are no square."""
    side = F.floor(F.sqrt(F.length(text) * 4)).cast("int")
    return F.when(is_hex(text) & (side * side == F.length(text) * 4), side)


def from_hex(text: Column) -> Column:
    """Bits of a square hash's text, null for texts that hold none."""
    return F.when(side_of(text).isNotNull(), _bits(text))


def _bits(text: Column) -> Column:
    def digit(c: Column) -> Column:
        v = F.conv(c, 16, 10).cast("int")
        return F.array(*[F.shiftright(v, k).bitwiseAND(1) for k in (3, 2, 1, 0)])

    return F.flatten(F.transform(F.split(text, ""), digit))


def from_flat_hex(text: Column, bits: int) -> Column:
    """The last 14 x ``bits`` bits of a colour hash's text; null if it holds fewer."""
    n = 14 * bits
    return F.when(is_hex(text) & (F.length(text) * 4 >= n), F.slice(_bits(text), F.length(text) * 4 - n + 1, n))


def from_multi_hex(text: Column) -> Column:
    """The hashes of a comma-joined text, null if one of them is no square hash."""
    parts = F.split(text, ",", -1)
    return F.when(F.forall(parts, lambda p: side_of(p).isNotNull()), parts)


def bit_size(text: Column) -> Column:
    """How many bits a hash's text holds (not how many are set)."""
    return F.length(text) * 4


def valid_bits(bits: Column) -> Column:
    """Whether an array is a hash: not empty, zeros and ones only."""
    return F.coalesce((F.size(bits) > 0) & F.forall(bits, lambda b: b.isNotNull() & b.isin(0, 1)), F.lit(False))


def old_hex(text: Column, side: int = 8) -> Column:
    """Bits from the text of earlier versions, which took the two digits of every 8 bits from the last bit to the first."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side * side // 8 - 1)), lambda i: F.reverse(_bits(F.substring(text, i * 2 + 1, F.lit(2))))))


def words_of(text: Column) -> Column:
    """A text's bits as words of 64."""
    word = lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / 16).cast("int"))), word)


def apart(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of as many words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two texts of one length; null if the lengths differ."""
    return F.when(F.length(a) == F.length(b), apart(words_of(a), words_of(b)))


def nearest(own: Column, others: Column) -> Column:
    """The smallest distance to any of ``others`` that has the same length; null if none has."""
    return F.array_min(F.transform(others, lambda o: hamming(own, o)))


def cutoff_of(first: Column, cutoff: float | None, rate: float | None) -> Column:
    return F.lit(float(cutoff)) if cutoff is not None else bit_size(first) * F.lit(BIT_ERROR_RATE if rate is None else rate)


def multi_difference(own: Column, other: Column, cutoff: float | None = None, rate: float | None = None) -> Column:
    """``matches, distance``: how many of ``own`` hashes have one of ``other`` within the cutoff, and their distances."""
    limit = cutoff_of(F.get(own, F.lit(0)), cutoff, rate)
    near = F.filter(F.transform(own, lambda h: nearest(h, other)), lambda d: d <= limit)
    return F.struct(F.size(near).alias("matches"), F.aggregate(near, F.lit(0), lambda s, d: s + d).alias("distance"))


def multi_distance(own: Column, other: Column, cutoff: float | None = None, rate: float | None = None) -> Column:
    """Segments without a match, plus the matched ones' mean share of differing bits."""
    d, n = multi_difference(own, other, cutoff, rate), F.size(own).cast("double")
    bits = bit_size(F.get(own, F.lit(0)))
    return F.when(d["matches"] == 0, n).otherwise(n - (d["matches"] - d["distance"] / (d["matches"] * bits).cast("double")))


def multi_matches(own: Column, other: Column, regions: int = 1, cutoff: float | None = None, rate: float | None = None) -> Column:
    return multi_difference(own, other, cutoff, rate)["matches"] >= regions


def colour_values(black: Column, gray: Column, faint: list[Column], bright: list[Column], total: Column, bits: int) -> list[Column]:
    """The 14 values of a colour histogram, each from 0 to 2 ** bits - 1."""
    room = float(1 << bits)
    capped = lambda v: F.least(F.lit((1 << bits) - 1), F.floor(v)).cast("int")
    coloured = F.greatest(F.lit(1).cast("long"), total - black - gray)
    return [*(capped(c / total.cast("double") * room) for c in (black, gray)), *(capped(c * room / coloured) for c in (*faint, *bright))]
