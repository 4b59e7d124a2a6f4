"""The raster functions by name, for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .functions import image_hash
from .sources import codecs


def register(spark: SparkSession) -> list[str]:
    """``image_<algorithm>(content, format, size)``, and the table function
    ``image_segments(content, format)``: their names."""
    names = []
    for algorithm in image_hash.ALGORITHMS:
        names.append(f"image_{algorithm}")
        spark.udf.register(names[-1], _function(algorithm))
    spark.udtf.register("image_segments", Segments)
    return [*names, "image_segments"]


def _function(algorithm: str):
    @F.pandas_udf("string")
    def run(content: pd.Series, kind: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([_hash(c, k, s, algorithm) for c, k, s in zip(content, kind, size)], dtype=object)

    return run


def _pixels(content, kind) -> np.ndarray | None:
    raster = codecs.decode(bytes(content), kind)[0] if content is not None and kind else None
    return raster and image_hash.pixels_of(raster["width"], raster["height"], raster["channels"], raster["data"])


def _hash(content, kind, size, algorithm):
    pixels = _pixels(content, kind)
    try:
        return None if pixels is None else image_hash.text_of(image_hash.bits_of(pixels, algorithm, int(size)))
    except ValueError:
        return None


@udtf(returnType="segment int, x int, y int, width int, height int, hex string")
class Segments:
    """The segments of an image, in their order, with each one's difference hash."""

    def eval(self, content: bytes, kind: str):
        pixels = _pixels(content, kind)
        for k, (x, t, r, b) in enumerate(image_hash.crops(pixels) if pixels is not None else []):
            yield k, x, t, r - x, b - t, image_hash.text_of(image_hash.bits_of(pixels[t:b, x:r], "difference", 8))
