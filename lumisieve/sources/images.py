"""Encoded images as DataFrames: formats and sizes by native expressions on the first bytes, limits before any decoding.

``read_images`` keeps what Spark's ``binaryFile`` source gives and adds ``format``, ``error``; ``decoded`` adds
``raster`` (null where ``error`` says why). Errors are rows, never failed tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import let
from . import codecs

MAX_BYTES = MAX_PIXELS = codecs.MAX_PIXELS
#: Markers of a JPEG that are followed before its size is left to the decoder.
JPEG_MARKERS = 1024
RASTER = "struct<width:int,height:int,channels:tinyint,data:binary>"
#: First bytes in hexadecimal (fixed values), in the order in which they are tried.
MAGIC = (("bmp", "^424D"), ("png", "^89504E470D0A1A0A"), ("gif", "^474946383[79]61"), ("jpeg", "^FFD8"), ("webp", "^52494646.{8}57454250"), ("tiff", "^(49492A00|4D4D002A)"), ("heic", "^.{8}66747970(68656963|68656978|68657663|68657678|6D696631|6D736631)"))


def format_of(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 16)), None
    for name, magic in MAGIC:
        hit = head.rlike(magic)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _number(content: Column, at: int, n: int, little: bool) -> Column:
    """A whole number of ``n`` bytes at a place counted from 0; null beyond the end."""
    places = range(at + n, at, -1) if little else range(at + 1, at + n + 1)
    digits = F.concat(*[F.hex(F.substring(content, p, 1)) for p in places])
    return F.when(F.length(content) >= at + n, F.conv(digits, 16, 10).cast("long"))


def size_of(content: Column) -> Column:
    """``width, height`` as the first bytes give them; null for formats whose size stands elsewhere."""
    def signed(c: Column) -> Column:
        return F.abs(F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c))

    def pair(w: Column, h: Column) -> Column:
        return F.struct(w.alias("width"), h.alias("height"))

    f = format_of(content)
    extended = F.hex(F.substring(content, 13, 4)) == "56503858"
    return (
        F.when(f == "png", pair(_number(content, 16, 4, False), _number(content, 20, 4, False)))
        .when(f == "gif", pair(_number(content, 6, 2, True), _number(content, 8, 2, True)))
        .when((f == "bmp") & (_number(content, 14, 4, True) == 12), pair(_number(content, 18, 2, True), _number(content, 20, 2, True)))
        .when(f == "bmp", pair(signed(_number(content, 18, 4, True)), signed(_number(content, 22, 4, True))))
        .when((f == "webp") & extended, pair(_number(content, 24, 3, True) + 1, _number(content, 27, 3, True) + 1))
        .when(f == "heic", _ispe(content))
        .when(f == "jpeg", _frame(content))
        .when(f == "tiff", _directory(content))
    )


def _byte(content: Column, at: Column) -> Column:
    """The byte at a place counted from 0; null beyond the end."""
    place = F.least(at, F.lit((1 << 31) - 2)).cast("int") + 1
    return F.conv(F.hex(F.substring(content, place, F.lit(1))), 16, 10).cast("long")


def _two(content: Column, at: Column) -> Column:
    return _byte(content, at) * 256 + _byte(content, at + 1)


def _frame(content: Column) -> Column:
    """A JPEG's size: markers are followed from one to the next, up to the one that begins a frame; null if there is none
    among the first ``JPEG_MARKERS``."""
    none, end = F.lit(None).cast("long"), F.lit(-1).cast("long")
    state = F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height"))

    def met(m: Column) -> Column:
        at, kind = m["at"], m["kind"]
        begins = kind.between(0xC0, 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        alone = kind.between(0xD0, 0xD8) | (kind == 0x01)
        # The end of the image, a scan's beginning and any byte but a marker's first lead nowhere.
        lost = (m["first"] != 0xFF) | kind.isin(0xD9, 0xDA) | kind.isNull()
        after = F.when(lost | begins, end).when(kind == 0xFF, at + 1).when(alone, at + 2).otherwise(at + 2 + _two(content, at + 2))
        side = lambda k: F.when(begins & ~lost, _two(content, at + k))
        return F.struct(F.coalesce(after, end).alias("at"), side(7).alias("width"), side(5).alias("height"))

    def step(s: Column, _: Column) -> Column:
        marker = F.struct(s["at"].alias("at"), _byte(content, s["at"]).alias("first"), _byte(content, s["at"] + 1).alias("kind"))
        return F.when(s["at"] < 0, s).otherwise(let(marker, met))

    steps = F.sequence(F.lit(1), F.least(F.lit(JPEG_MARKERS), F.greatest(F.lit(1), F.floor(F.length(content) / 2).cast("int"))))
    return F.aggregate(steps, state, step, lambda s: F.when(s["height"].isNotNull() & s["width"].isNotNull(), F.struct(s["width"].alias("width"), s["height"].alias("height"))))


def _directory(content: Column) -> Column:
    """A TIFF's size from the entries (tags 256 and 257, of 2 or 4 bytes) of its first directory."""
    little, none = F.hex(F.substring(content, 1, 1)) == "49", F.lit(None).cast("long")

    def number(at: Column, n: int) -> Column:
        """Bytes as they stand, or the other way round."""
        digits = F.hex(F.substring(content, F.least(at, F.lit((1 << 31) - 8)).cast("int") + 1, F.lit(n)))
        turned = lambda d: F.concat(*[F.substring(d, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])
        return let(digits, lambda d: F.when(F.length(d) == 2 * n, F.conv(F.when(little, turned(d)).otherwise(d), 16, 10).cast("long")))

    def of_entry(e: Column) -> Column:
        return F.when(e["kind"] == 3, number(e["at"] + 8, 2)).when(e["kind"] == 4, number(e["at"] + 8, 4))

    def within(d: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            at = d["start"] + 2 + i.cast("long") * 12
            entry = F.struct(at.alias("at"), number(at, 2).alias("tag"), number(at + 2, 2).alias("kind"))
            side = lambda e, tag, name: F.when(e["tag"] == tag, of_entry(e)).otherwise(s[name]).alias(name)
            return let(entry, lambda e: F.struct(side(e, 256, "width"), side(e, 257, "height")))

        places = F.when(d["n"] > 0, F.sequence(F.lit(0), (d["n"] - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.struct(none.alias("width"), none.alias("height")), step, lambda s: F.when(s["width"].isNotNull() & s["height"].isNotNull(), s))

    start = F.struct(number(F.lit(4).cast("long"), 4).alias("start"))
    return let(start, lambda d: let(F.struct(d["start"].alias("start"), number(d["start"], 2).alias("n")), within))


def raster_fault(raster: Column) -> Column:
    """Why a raster (width, height, channels, data) is none; null if it is one."""
    w, h, c = (raster[k] for k in ("width", "height", "channels"))
    size = w.cast("long") * h.cast("long") * c.cast("long")
    fault = F.when(F.coalesce((w <= 0) | (h <= 0), F.lit(True)), "sides must be positive").when(F.coalesce(~c.isin(3, 4), F.lit(True)), "channels must be 3 or 4")
    return F.when(raster.isNull(), "no raster").otherwise(fault.when(F.coalesce(F.length(raster["data"]) != size, F.lit(True)), "a raster's bytes must be width x height x channels"))


def _ispe(content: Column) -> Column:
    """The first image spatial extents box within the first MiB."""
    text = F.hex(F.substring(content, 1, 1 << 20))
    at = F.locate("69737065", text)
    side = lambda k: F.conv(F.substring(text, at + 16 + 8 * k, F.lit(8)), 16, 10).cast("long")
    return F.when((at > 0) & (at % 2 == 1), F.struct(side(0).alias("width"), side(1).alias("height")))


def read_images(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """Files at ``path``. Larger ones than ``max_bytes`` are rows without content whose error says so; only their names and
    lengths are read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    small = checked(files.where(F.col("length") <= max_bytes))
    large = files.where(F.col("length") > max_bytes).select(*[c for c in files.columns if c != "content"])
    error = F.struct(F.lit("imageTooLarge").alias("kind"), F.lit(None).cast("string").alias("format"), F.lit("more bytes than the limit").alias("detail"))
    large = large.withColumn("content", F.lit(None).cast("binary")).withColumn("format", F.lit(None).cast("string")).withColumn("error", error)
    return small.unionByName(large.select(*small.columns))


def checked(images: DataFrame, content: str = "content", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """``images`` with ``format`` and ``error``: unknown formats, and sizes beyond the limit, before any decoding."""
    c = F.col(content)
    fault = lambda kind, f, detail: F.struct(F.lit(kind).alias("kind"), f.alias("format"), F.lit(detail).alias("detail"))
    too_large = F.coalesce(let(size_of(c), lambda s: s["width"] * s["height"]) > max_pixels, F.lit(False))
    error = F.when(F.col("format").isNull(), fault("unsupportedFormat", F.col("format"), "no known first bytes")).when(too_large, fault("imageTooLarge", F.col("format"), "more pixels than the limit"))
    return images.withColumn("format", format_of(c)).withColumn("error", error)


def decoded(images: DataFrame, content: str = "content") -> DataFrame:
    """``checked`` images with ``raster``; ``error`` is filled where a decoder gives up."""

    @F.pandas_udf(f"raster {RASTER}, error struct<kind:string,format:string,detail:string>")
    def run(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = [codecs.decode(d, k) if isinstance(k, str) else (None, None) for d, k in zip(data, kind)]
        return pd.DataFrame({"raster": [r[0] for r in rows], "error": [r[1] for r in rows]})

    ready = images.withColumn("__found", run(F.when(F.col("error").isNull(), F.col(content)), F.when(F.col("error").isNull(), F.col("format"))))
    return ready.withColumn("raster", F.col("__found.raster")).withColumn("error", F.coalesce("error", F.col("__found.error"))).drop("__found")
