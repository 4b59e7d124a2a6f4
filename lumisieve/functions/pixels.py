"""Pixel functions as Column expressions: integer arithmetic on red, green and blue from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Luma weights (of 65536) and the bounds of colour classes.
LUMA = (19595, 38470, 7471)
BLACK_BELOW, GRAY_BELOW, FAINT_BELOW, BRIGHT_ABOVE = 32, 85, 170, 170


def _div(a: Column, b) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.floor(a / b).cast("int")


def over_black(value: Column, alpha: Column) -> Column:
    """A channel composited on black: ``value * alpha / 255``, truncated."""
    return _div(value * alpha, 255)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 32768, 16).cast("int")


def saturation(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high == low, 0).otherwise(_div((high - low) * 255, high)).cast("int")


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue from 0 to 255: 1530 steps around the circle from the largest channel (red before green before blue), wrapped
    before the division by 6."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.when(high == low, 1).otherwise(high - low)
    red, green, blue = (_div((high - c) * 255, span) for c in (r, g, b))
    steps = F.when(r == high, blue - green).when(g == high, red - blue + 510).otherwise(green - red + 1020)
    return F.when(high == low, 0).otherwise(_div(F.when(steps < 0, steps + 1530).otherwise(steps), 6)).cast("int")


def value(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b).cast("int")


def colour_class(r: Column, g: Column, b: Column) -> Column:
    """``black``, ``gray``, ``faint``, ``bright``, or ``none`` (colourful, in no bin)."""
    s = saturation(r, g, b)
    return F.when(luma(r, g, b) < BLACK_BELOW, "black").when(s < GRAY_BELOW, "gray").when(s < FAINT_BELOW, "faint").when(s > BRIGHT_ABOVE, "bright").otherwise("none")


def hue_bin(h: Column) -> Column:
    return F.least(F.lit(5), _div(h * 6, 255)).cast("int")


#: Bins of ``with_colour_bin``: the two without a hue, six of each of the two with one, and that of pixels of no class.
BINS = ("black", "gray", *(f"{c}{k}" for c in ("faint", "bright") for k in range(6)), "none")


def with_colour_bin(table: DataFrame, name: str, r: str, g: str, b: str) -> DataFrame:
    """``table`` with the place in ``BINS`` of each row's pixel (``colour_class``, and for colours ``hue_bin``).

    The same rules in fewer steps, each a column that is made once: written out as one expression they are longer
    than what the JVM compiles, and a pixel takes some fifty times as long. A saturation is held against its bounds by
    whole numbers, without its division; a hue is made of the two channels that its case names."""
    red, green, blue, hi, lo = F.col(r), F.col(g), F.col(b), F.col("__ls_hi"), F.col("__ls_lo")
    made = table.withColumns({"__ls_hi": F.greatest(r, g, b), "__ls_lo": F.least(r, g, b), "__ls_dark": luma(red, green, blue) < BLACK_BELOW})
    case = lambda *of: F.when(red == hi, of[0]).when(green == hi, of[1]).otherwise(of[2])
    made = made.withColumns({"__ls_span": F.greatest(F.lit(1), hi - lo), "__ls_x": hi - case(blue, red, green), "__ls_y": hi - case(green, blue, red), "__ls_from": case(F.lit(0), F.lit(510), F.lit(1020)), "__ls_s": (hi - lo) * 255})
    made = made.withColumn("__ls_steps", _div(F.col("__ls_x") * 255, F.col("__ls_span")) - _div(F.col("__ls_y") * 255, F.col("__ls_span")) + F.col("__ls_from"))
    made = made.withColumn("__ls_hb", hue_bin(_div(F.when(F.col("__ls_steps") < 0, F.col("__ls_steps") + 1530).otherwise(F.col("__ls_steps")), 6)))
    s, hb = F.col("__ls_s"), F.col("__ls_hb")
    place = F.when(F.col("__ls_dark"), 0).when(s < hi * GRAY_BELOW, 1).when(s < hi * FAINT_BELOW, hb + 2).when(s >= hi * (BRIGHT_ABOVE + 1), hb + 8).otherwise(14)
    return made.withColumn(name, place).select(*table.columns, name)


def bin_bits(v: Column, bits: int) -> Column:
    """The bits by which a histogram value from 0 to 2 ** bits - 1 is written: not plain binary (8 of 4 bits is 1100)."""
    return F.array(*[(F.shiftright(v, bits - i - 1).bitwiseAND((1 << (bits - i)) - 1) > 0).cast("int") for i in range(bits)])
