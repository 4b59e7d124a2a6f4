"""Kernels and segments as Spark plans against the NumPy steps, on planes of several sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.functions import image_hash as I
from lumisieve.functions import kernels as K
from lumisieve.functions import raster as R
from lumisieve.operators import segments as G

RNG = np.random.default_rng(21)
PLANES = [RNG.integers(0, 256, s) for s in ((8, 8), (13, 9), (5, 30), (1, 7), (16, 16))] + [np.full((9, 12), 200), np.full((6, 6), 3)]


@pytest.fixture(scope="module")
def planes(spark):
    rows = [(i, p.tolist(), p.shape[1], p.shape[0]) for i, p in enumerate(PLANES)]
    return spark.createDataFrame(rows, "id long, plane array<array<int>>, w int, h int").withColumn("real", K._doubles(F.col("plane")))


def held(table, name, want, within=0.0, only=lambda p: True):
    got = {r["id"]: np.array(r[name]) for r in table.select("id", name).collect()}
    for i, p in enumerate(PLANES):
        if only(p):
            w = np.asarray(want(p))
            assert got[i].shape == w.shape and np.abs(got[i] - w).max() <= within, (name, i)


@pytest.mark.parametrize("size", [(32, 32), (3, 7), (9, 8)])
def test_resize_by_weights_of_columns(planes, size):
    held(K.with_resized(planes, "r", "plane", F.col("w"), F.col("h"), *size), "r", lambda p: R.resized(p.astype(np.uint8), *size))


@pytest.mark.parametrize("radius", [2.0, 5.0])
def test_blur_and_median(planes, radius):
    held(planes.withColumn("b", K.blurred(F.col("plane"), radius)), "b", lambda p: R.blurred(p.astype(np.uint8), radius))
    held(planes.withColumn("m", K.median3(F.col("plane"))), "m", R.median3)


def test_wavelets(planes):
    square = lambda p: p.shape in ((8, 8), (16, 16))
    rows = planes.where("w = h and w in (8, 16)")
    tower = K.haar_tower(rows, "real", 3)
    held(tower.withColumn("ll", F.col("haar3.ll")), "ll", lambda p: R.haar_levels(p.astype(float), 3)[0], only=square)
    held(K.haar_back(tower, 3), "whole", lambda p: p, 1e-9, square)
    held(K.haar_back(tower, 3, without_mean=True), "whole", lambda p: R.without_mean(p.astype(float), 3), only=square)
    halves = planes.withColumn("low", F.transform("real", lambda r: K.db4_half(r))).withColumn("high", F.transform("real", lambda r: K.db4_half(r, K.DB4_HIGH)))
    held(halves.withColumn("back", F.zip_with("low", "high", lambda a, b: K.db4_joined(a, b, F.col("w")))), "back", lambda p: p, 1e-9)
    both = planes.withColumn("low", F.transform(K.turned(F.transform(K.turned(F.col("real")), lambda r: K.db4_half(r))), lambda r: K.db4_half(r)))
    held(both, "low", lambda p: R.db4_low(p.astype(float), 1))


def test_hashes(planes):
    big = K.with_resized(planes, "r", "plane", F.col("w"), F.col("h"), 32, 32)
    held(big.withColumn("b", K.phash_bits(F.col("r"), 32, 8)), "b", lambda p: I.phash(p.astype(np.uint8), 8).ravel())
    held(big.withColumn("b", K.phash_simple_bits(F.col("r"), 32, 8)), "b", lambda p: I.phash_simple(p.astype(np.uint8), 8).ravel())
    for kind, robust in (("haar", False), ("db4", False), ("db4", True)):
        rows = planes.where("id = 4")
        held(K.with_wavelet_bits(rows, "b", "plane", 16, 8, kind, robust), "b", lambda p: I.wavelet(p.astype(np.uint8), 8, kind, robust).ravel(), only=lambda p: p.shape == (16, 16))


@pytest.mark.parametrize("least", [0, 3, 500])
def test_segments(planes, least):
    got = {}
    for r in G.segments(planes.select("id", "plane"), 128, least).orderBy("id", "segment").collect():
        got.setdefault(r["id"], []).append((r["size"], (r["top"], r["left"], r["bottom"], r["right"])))
    assert got == {i: s for i, p in enumerate(PLANES) if (s := R.segments(p.astype(np.float32), 128, least))}


@pytest.mark.parametrize("limit, least", [(None, 5), (2, 5), (None, 10_000)])
def test_crop_resistant(planes, limit, least):
    got = {}
    for r in G.crop_resistant(planes.select("id", "plane"), 16, limit, 128, least).orderBy("id", "segment").collect():
        got.setdefault(r["id"], []).append(r["hex"])
    want = {}
    for i, p in enumerate(PLANES):
        rgb = np.stack([p.astype(np.uint8)] * 3, 2)
        want[i] = [I.text_of(I.difference(p[t:b, x:r].astype(np.uint8), 8)) for x, t, r, b in I.crops(rgb, limit, 128, least, 16)]
    assert got == {i: w for i, w in want.items() if w}


def test_no_planes(spark):
    none = spark.createDataFrame([], "id long, plane array<array<int>>")
    assert G.segments(none).collect() == [] and G.crop_resistant(none, 16).collect() == []


def test_steps_are_made_once_an_image(planes):
    """Nothing is shuffled, and no step of a plan stands in it once for each place that uses it."""
    plan = planes.select(K.blurred(F.col("plane")).alias("b"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(plan) < 60_000


def test_weights_are_not_made_for_each_row(planes):
    plan = K.with_resized(planes.drop("real"), "r", "plane", F.col("w"), F.col("h"), 16, 16)._jdf.queryExecution().optimizedPlan().toString()
    rows = plan.split("transform(plane#")
    assert len(rows) == 2 and "SIN" in rows[0] and "SIN" not in rows[1]


def test_segments_make_their_planes_once(spark, planes):
    made = spark.sparkContext.accumulator(0)

    def seen(plane):
        made.add(1)
        return plane

    rows = planes.select("id", F.udf(seen, "array<array<int>>")("plane").alias("plane"))
    assert G.segments(rows, 128, 3).count() > 0 and made.value == len(PLANES)


def test_one_file_of_planes_is_blurred_by_several_tasks(spark, tmp_path):
    spark.range(64).coalesce(1).select("id", F.array_repeat(F.array_repeat(F.col("id").cast("int"), 8), 8).alias("plane")).write.parquet(str(tmp_path / "planes"))
    rows = G._dealt(spark.read.parquet(str(tmp_path / "planes")), "id")
    assert len({r[0] for r in rows.select(F.spark_partition_id()).collect()}) > 1
