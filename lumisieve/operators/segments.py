"""Segments of planes, and the hashes of what they frame, as relations.

A plane becomes runs: stretches of a scan line on one side of the threshold, a row each. Runs of neighbouring lines that
overlap are links, found by an equi-join on (image, side, line); the regions are the links' connected components, over
all images at once; their sizes and boxes are aggregates. A region is named by the first place of its first run, so
regions come in the order in which a reader of the plane meets them: those above the threshold, then the others.
Regions of the second kind count only until what was met, with the border, is as much as the plane.

The runs are written once (what makes the planes may be long) and planes are dealt to at least as many tasks as a shuffle
has before they are blurred or resized: a small file of planes is much work.

Defined cases: a plane without segments of more than the least size has none (``crops`` then takes the whole plane); a
null plane has no rows. Ids must not repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import hashes as H
from ..functions import kernels as K
from .components import components

BORDER = 2


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def runs(planes: DataFrame, threshold: float) -> DataFrame:
    """``id, h, w, hill, y, x0, x1, at`` (x1 is the first place after) of planes (id, plane) of ``h`` lines of ``w`` places."""
    flat = planes.select("id", F.size("plane").alias("h"), F.size(F.get("plane", F.lit(0))).alias("w"), F.flatten("plane").alias("v"))
    flat = flat.select("id", "h", "w", F.transform("v", lambda x: x > threshold).alias("side"), F.size("v").alias("n"))
    begins = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i % F.col("w") == 0) | (F.get("side", i) != F.get("side", i - 1)))
    flat = flat.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array("n"))
    each = F.zip_with("begins", ends, lambda a, b: F.struct(a.alias("at"), b.alias("next"), F.get("side", a).alias("hill")))
    rows = flat.select("id", "h", "w", F.explode(each).alias("r")).select("id", "h", "w", "r.*")
    x0 = (F.col("at") % F.col("w")).cast("int")
    return rows.select("id", "h", "w", "hill", F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), x0.alias("x0"), (x0 + F.col("next") - F.col("at")).alias("x1"), "at")


def segments(planes: DataFrame, threshold: float = 128, least_size: int = 500) -> DataFrame:
    """``id, segment, size, top, left, bottom, right`` of planes (id, plane): segments from 0 on, in their order."""
    every = scratch.written(runs(planes, threshold), "runs")
    node = F.struct("id", "at")
    upper = every.select("id", "hill", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), node.alias("a"))
    lower = every.select("id", "hill", "y", "x0", "x1", node.alias("b"))
    links = lower.join(upper, ["id", "hill", "y"]).where((F.col("x0") < F.col("u1")) & (F.col("u0") < F.col("x1"))).select("a", "b")
    regions = components(links).select(F.col("node.id").alias("id"), F.col("node.at").alias("at"), F.col("component.at").alias("first"))
    placed = every.join(regions, ["id", "at"], "left").withColumn("first", F.coalesce("first", "at"))
    box = [F.min("y").alias("top"), F.min("x0").alias("left"), F.max("y").alias("bottom"), (F.max("x1") - 1).alias("right")]
    found = placed.groupBy("id", "h", "w", "hill", "first").agg(F.sum(F.col("x1") - F.col("x0")).alias("size"), *box)
    order = Window.partitionBy("id").orderBy(F.desc("hill"), "first")
    met = found.withColumn("met", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = met.where(F.col("hill") | (BORDER * (F.col("h") + F.col("w")) + F.col("met") < F.col("h") * F.col("w"))).where(F.col("size") > least_size)
    return kept.select("id", (F.row_number().over(order) - 1).alias("segment"), F.col("size").cast("long").alias("size"), "top", "left", "bottom", "right")


def crops(planes: DataFrame, side: int, limit: int | None = None, threshold: float = 128, least_size: int = 500) -> DataFrame:
    """``id, segment, x0, y0, x1, y1`` in planes (id, plane) of bytes: the segments of a blurred copy of ``side`` x ``side``,
    the largest ``limit`` of them if there is one; the whole plane where there are none."""
    sized = planes.withColumns({"h": F.size("plane"), "w": F.size(F.get("plane", F.lit(0)))})
    small = K.with_resized(_dealt(sized, "id"), "small", "plane", F.col("w"), F.col("h"), side, side)
    # The median is a step of its own, so that blurring is not done for each of its places.
    small = small.select("id", K.median3(K.blurred(F.col("small"))).alias("plane"))
    found = segments(small, threshold, least_size)
    if limit is not None:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("size"), "segment"))).where(F.col("rank") <= limit)
        found = found.withColumn("segment", F.col("rank") - 1).drop("rank")
    both = sized.select("id", "w", "h").join(found, "id", "left")
    whole = F.col("segment").isNull()
    edges = {"x0": (F.when(whole, 0).otherwise(F.col("left")), "w"), "y0": (F.when(whole, 0).otherwise(F.col("top")), "h"), "x1": (F.when(whole, side).otherwise(F.col("right") + 1), "w"), "y1": (F.when(whole, side).otherwise(F.col("bottom") + 1), "h")}
    place = lambda at, n: F.greatest(F.lit(0), F.least(F.col(n), F.rint(at * (F.col(n) / float(side))).cast("int")))
    boxes = both.select("id", F.coalesce("segment", F.lit(0)).alias("segment"), *[place(*e).alias(c) for c, e in edges.items()])
    return boxes.where("x1 > x0 and y1 > y0")


def crop_resistant(planes: DataFrame, side: int, limit: int | None = None, threshold: float = 128, least_size: int = 500, size: int = 8) -> DataFrame:
    """``id, segment, hex``: the difference hash of each crop, segments from 0 on."""
    boxes = crops(planes, side, limit, threshold, least_size)
    # Crops are cut before they are dealt to tasks, and numbered before that.
    rank = F.row_number().over(Window.partitionBy("id").orderBy("segment")) - 1
    own = boxes.withColumn("segment", rank).join(planes, "id")
    cut = F.transform(F.slice("plane", F.col("y0") + 1, F.col("y1") - F.col("y0")), lambda row: F.slice(row, F.col("x0") + 1, F.col("x1") - F.col("x0")))
    dealt = _dealt(own.select("id", "segment", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), cut.alias("cut")), "id", "segment")
    small = K.with_resized(dealt, "small", "cut", F.col("w"), F.col("h"), size + 1, size).select("id", "segment", F.flatten("small").alias("px"))
    return small.select("id", "segment", H.to_hex(H.difference_bits(F.col("px"), size + 1, size), size * size).alias("hex"))
