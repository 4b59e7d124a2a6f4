"""Queries of the steps on planes: each vector as a plane of 8 x 8 bytes, through the kernels that the hashes use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import kernels as K
from ..operators import segments as G
from .queries import planes

SIDE, HASH, SMALL = 8, 8, 16
#: Segments of planes of 64 and of 256 places count from these sizes on.
LEAST, LEAST_SMALL = 3, 12


def _grids(spark, sf_dir) -> DataFrame:
    return planes(spark, sf_dir).select("vec_id", K.plane_of(F.col("px"), SIDE, SIDE).alias("plane"))


def _text(plane: Column) -> Column:
    return F.array_join(F.transform(F.flatten(plane), lambda v: v.cast("string")), ",")


def _places(rows: DataFrame, plane: str, value: str, of) -> DataFrame:
    """A row for each place of a plane."""
    lines = rows.select("vec_id", F.posexplode(plane).alias("y", "row"))
    return lines.select("vec_id", "y", F.posexplode("row").alias("x", "v")).select("vec_id", "y", "x", of(F.col("v")).alias(value))


def q_resized(spark, sf_dir):
    """Planes enlarged and made smaller, each direction by its own factor."""
    rows = K.with_resized(_grids(spark, sf_dir), "r", "plane", SIDE, SIDE, 12, 5)
    return K.with_resized(rows, "s", "r", 12, 5, 3, 7).select("vec_id", _text(F.col("r")).alias("wide"), _text(F.col("s")).alias("tall"))


def q_dct(spark, sf_dir):
    """Cosine transform of rows and columns: thousandths of the coefficients."""
    rows = _grids(spark, sf_dir).withColumn("c", K.both_ways(K._doubles(F.col("plane")), lambda row: K.cosine(row, SIDE, SIDE)))
    return _places(rows, "c", "thousandths", lambda v: F.round(v * 1000).cast("long"))


def q_phash(spark, sf_dir):
    """Both hashes of frequencies, of planes enlarged fourfold."""
    n = 4 * HASH
    rows = K.with_resized(_grids(spark, sf_dir), "r", "plane", SIDE, SIDE, n, n)
    bits = {"phash": K.phash_bits(F.col("r"), n, HASH), "phash_simple": K.phash_simple_bits(F.col("r"), n, HASH)}
    return rows.select("vec_id", *[H.to_hex(b, HASH * HASH).alias(c) for c, b in bits.items()])


def q_haar(spark, sf_dir):
    """One level of the Haar transform: sums of each 2 x 2 places with the four patterns of signs."""
    rows = K.haar_tower(_grids(spark, sf_dir).withColumn("plane", K._doubles(F.col("plane"))), "plane", 1)
    names = {"ll": "low", "hl": "rows_differ", "lh": "columns_differ", "hh": "diagonal"}
    each = F.arrays_zip(*[F.flatten(F.col(f"haar1.{b}")).alias(b) for b in names])
    at = rows.select("vec_id", F.posexplode(each).alias("at", "p"))
    half = SIDE // 2
    return at.select("vec_id", F.floor(F.col("at") / half).cast("int").alias("y"), (F.col("at") % half).cast("int").alias("x"), *[F.round(F.col("p").getField(b) * 2).cast("long").alias(n) for b, n in names.items()])


def q_wavelets(spark, sf_dir):
    """The whole Haar transform and its inverse, without and with the mean; Daubechies' low and high halves of each row
    and what they join to; millionths, whole numbers."""
    millionths = lambda plane: _text(F.transform(plane, lambda row: F.transform(row, lambda v: F.round(v * 1e6).cast("long"))))
    rows = _grids(spark, sf_dir).withColumn("plane", K._doubles(F.col("plane")))
    rows = K.haar_tower(rows, "plane", 3)
    rows = K.haar_back(rows, 3, out="whole")
    rows = K.haar_back(rows, 3, out="flat", without_mean=True)
    rows = rows.withColumn("low", F.transform("plane", lambda r: K.db4_half(r))).withColumn("high", F.transform("plane", lambda r: K.db4_half(r, K.DB4_HIGH)))
    rows = rows.withColumn("joined", F.zip_with("low", "high", lambda a, b: K.db4_joined(a, b, SIDE)))
    level3 = F.round(F.get(F.get("haar3.ll", F.lit(0)), F.lit(0)) * 1e6).cast("long")
    return rows.select("vec_id", level3.alias("coarsest"), *[millionths(F.col(c)).alias(c) for c in ("whole", "flat", "low", "high", "joined")])


def q_whash(spark, sf_dir):
    """The three wavelet hashes of planes enlarged to 16 x 16, of one level's low band."""
    rows = K.with_resized(_grids(spark, sf_dir), "r", "plane", SIDE, SIDE, SMALL, SMALL)
    for name, kind, robust in (("haar", "haar", False), ("db4", "db4", False), ("db4_robust", "db4", True)):
        rows = K.with_wavelet_bits(rows, name, "r", SMALL, HASH, kind, robust)
    return rows.select("vec_id", *[H.to_hex(F.col(c), n).alias(c) for c, n in (("haar", 64), ("db4", 121), ("db4_robust", 121))])


def q_blurred(spark, sf_dir):
    rows = _grids(spark, sf_dir).withColumn("b", K.blurred(F.col("plane")))
    return rows.select("vec_id", _text(F.col("b")).alias("blurred"), _text(K.median3(F.col("plane"))).alias("median"))


def q_segments(spark, sf_dir):
    """Segments of the planes as they are."""
    rows = _grids(spark, sf_dir).select(F.col("vec_id").alias("id"), "plane")
    return G.segments(rows, 128, LEAST).withColumnRenamed("id", "vec_id")


def q_crop_resistant(spark, sf_dir):
    """Hashes of the segments that a blurred copy of 16 x 16 shows."""
    rows = _grids(spark, sf_dir).select(F.col("vec_id").alias("id"), "plane")
    return G.crop_resistant(rows, SMALL, None, 128, LEAST_SMALL).withColumnRenamed("id", "vec_id")


QUERIES = {
    "resized_planes": q_resized,
    "dct_planes": q_dct,
    "phash_planes": q_phash,
    "haar_planes": q_haar,
    "wavelet_planes": q_wavelets,
    "whash_planes": q_whash,
    "blurred_planes": q_blurred,
    "segment_planes": q_segments,
    "crop_resistant_planes": q_crop_resistant,
}
