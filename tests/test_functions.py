"""Pixel and hash functions against plain Python, and the raster steps against known values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.functions import hashes as H
from lumisieve.functions import image_hash as I
from lumisieve.functions import pixels as P
from lumisieve.functions import raster as R


def hsv_plain(r, g, b):
    hi, lo = max(r, g, b), min(r, g, b)
    if hi == lo:
        return 0, 0, hi
    d = hi - lo
    rc, gc, bc = ((hi - c) * 255 // d for c in (r, g, b))
    t = bc - gc if r == hi else 510 + rc - bc if g == hi else 1020 + gc - rc
    return (t + 1530 if t < 0 else t) // 6, d * 255 // hi, hi


def test_pixels(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(500)] + [(0, 0, 0), (255, 255, 255), (100, 150, 200), (255, 0, 1), (7, 7, 7)]
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    got = spark.createDataFrame(rows, "r int, g int, b int").select("r", "g", "b", P.luma(r, g, b), P.hue(r, g, b), P.saturation(r, g, b), P.value(r, g, b), P.over_black(r, g)).collect()
    h, s, v = R.hsv(np.array(rows, np.uint8)[None])
    luma = R.luma(np.array(rows, np.uint8)[None])[0]
    for k, row in enumerate(got):
        red, green, blue = row[:3]
        assert row[3] == (19595 * red + 38470 * green + 7471 * blue + 32768) >> 16 == luma[k]
        assert tuple(row[4:7]) == hsv_plain(red, green, blue) == (h[k], s[k], v[k])
        assert row[7] == red * green // 255
    assert (100, 150, 200) in rows and hsv_plain(100, 150, 200) == (148, 127, 200)


def test_bin_bits_are_not_plain_binary(spark):
    got = dict(spark.range(16).select("id", H.to_hex(P.bin_bits(F.col("id").cast("int"), 4), 4)).collect())
    assert {k: got[k] for k in (0, 1, 2, 4, 7, 8, 15)} == {0: "0", 1: "1", 2: "2", 4: "6", 7: "7", 8: "c", 15: "f"}


def test_hash_texts(spark):
    bits = [1, 0, 1, 0, 0, 1, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    row = spark.createDataFrame([(bits, bits[:6])], "a array<int>, b array<int>").select(H.to_hex(F.col("a"), 16).alias("h"), H.to_hex(F.col("b"), 6).alias("k")).first()
    assert (row["h"], row["k"]) == ("a5f0", "29")
    texts = ["a5f0", "A5F0", "", None, "a5f", "xyz1", "ffff", "f"]
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", H.side_of(t), H.from_hex(t), H.hamming(t, F.lit("a5f0"))).collect()
    assert [g[1] for g in got] == [4, None, None, None, None, None, 4, 2]
    assert got[0][2] == bits and [g[3] for g in got][0] == 0 and got[6][3] == 8 and got[7][3] is None


def test_wide_distances_and_multi_hashes(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(50):
        a, b = rng.getrandbits(196), rng.getrandbits(196)
        rows.append((f"{a:049x}", f"{b:049x}", bin(a ^ b).count("1")))
    got = spark.createDataFrame(rows, "a string, b string, d int").select(H.hamming(F.col("a"), F.col("b")).alias("x"), "d").collect()
    assert all(r["x"] == r["d"] for r in got)
    own, other = ["ffff", "0000", "00ff"], ["fffe", "f00f", "a"]
    d = spark.createDataFrame([(own, other)], "o array<string>, p array<string>")
    row = d.select(H.multi_difference(F.col("o"), F.col("p")).alias("d"), H.multi_distance(F.col("o"), F.col("p")).alias("s"), H.multi_matches(F.col("o"), F.col("p"), 2).alias("m")).first()
    # Of 16 bits, 4 may differ: the first does by 1; the second by 8, the third by 8.
    assert tuple(row["d"]) == (1, 1) and row["s"] == 3 - (1 - 1 / 16) and row["m"] is False
    assert d.select(H.from_multi_hex(F.lit("ffff,00")).alias("x"), H.from_multi_hex(F.lit("ffff,0000")).alias("y")).first()["x"] is None


def test_resize_keeps_sizes_and_constants():
    rng = np.random.default_rng(3)
    plane = rng.integers(0, 256, (23, 31), dtype=np.uint8)
    assert (R.resized(plane, 31, 23) == plane).all()
    assert (R.resized(np.full((40, 17), 93, np.uint8), 9, 8) == 93).all()


def test_dct_against_its_sum():
    x = np.random.default_rng(4).normal(size=32)
    n = np.arange(32)
    want = [2 * (x * np.cos(np.pi * k * (2 * n + 1) / 64)).sum() for k in range(32)]
    assert np.abs(R.dct(x, 0) - want).max() < 1e-9 and np.abs(R.dct(np.ones(32), 0)[1:]).max() == 0


def test_wavelets():
    x = np.random.default_rng(5).normal(size=(16, 16))
    ll, details = R.haar(x)
    assert np.abs(R.haar_inverse(ll, details) - x).max() < 1e-12
    assert abs(R.without_mean(x, 4).mean()) < 1e-12
    assert abs(sum(R.DB4_LOW) - 2**0.5) < 1e-12
    assert [R.db4_low(np.ones((s, s)), k).shape[0] for s, k in ((8, 0), (16, 1), (32, 2), (64, 3), (128, 4))] == [8, 11, 13, 14, 14]


def test_blur_and_median():
    assert (R.blurred(np.full((20, 30), 77, np.uint8)) == 77).all()
    plane = np.random.default_rng(6).integers(0, 256, (9, 11), dtype=np.uint8)
    wide = np.pad(plane, 1, mode="edge")
    assert all(R.median3(plane)[y, x] == np.sort(wide[y : y + 3, x : x + 3].ravel())[4] for y in range(9) for x in range(11))


def test_regions_against_flood_fill():
    rng = np.random.default_rng(7)
    for _ in range(20):
        mask = rng.random((13, 17)) < 0.6
        want = np.full(mask.shape, -1)
        for y, x in zip(*np.nonzero(mask)):
            if want[y, x] < 0:
                todo = [(y, x)]
                want[y, x] = y * 17 + x
                while todo:
                    a, b = todo.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 13 and 0 <= d < 17 and mask[c, d] and want[c, d] < 0:
                            want[c, d] = y * 17 + x
                            todo.append((c, d))
        assert (R.regions(mask) == want).all()


def test_hash_columns(spark):
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    rows = [(50, 40, 3, bytearray(image.tobytes())), (50, 40, 4, bytearray(b"123")), (0, 0, 3, bytearray(b""))]
    df = spark.createDataFrame(rows, "width int, height int, channels int, data binary").select(F.struct("width", "height", "channels", "data").alias("r"))
    for a in I.ALGORITHMS:
        got = [r[0] for r in df.select(I.hash_of(F.col("r"), a, 3 if a == "colour" else 8)).collect()]
        assert got[0] == I.text_of(I.bits_of(image, a, 3 if a == "colour" else 8)) and got[1:] == [None, None]
    got = [r[0] for r in df.select(I.crop_resistant(F.col("r"))).collect()]
    assert got[0] and got[1:] == [None, None]
    with pytest.raises(ValueError):
        I.bits_of(image, "whash_haar", 6)
    with pytest.raises(ValueError):
        I.bits_of(image, "average", 1)


def test_whole_image_is_the_segment_of_an_even_image():
    assert I.crops(np.full((30, 60, 3), 200, np.uint8)) == [(0, 0, 60, 30)]


def test_colour_bins_are_classes_and_hues(spark):
    steps = F.array(*[F.lit(v) for v in sorted({*range(0, 256, 7), 1, 2, 31, 32, 33, 84, 85, 127, 128, 170, 171, 254, 255})])
    pixels = spark.range(1).select(F.explode(steps).alias("r")).select("r", F.explode(steps).alias("g")).select("*", F.explode(steps).alias("b"))
    c, hb = P.colour_class(F.col("r"), F.col("g"), F.col("b")), P.hue_bin(P.hue(F.col("r"), F.col("g"), F.col("b")))
    want = F.when(c.isin("faint", "bright"), F.concat(c, hb.cast("string"))).otherwise(c)
    names = F.array(*[F.lit(n) for n in P.BINS])
    both = P.with_colour_bin(pixels, "bin", "r", "g", "b").select(F.get(names, F.col("bin")).alias("got"), want.alias("want"))
    assert both.where("got <> want or got is null").count() == 0 and both.select("got").distinct().count() == len(P.BINS)


def test_colour_hash_is_short_enough_to_be_compiled(spark, tmp_path):
    """HotSpot leaves methods of over 8,000 bytes to its interpreter."""
    from lumisieve.plans.queries import QUERIES

    spark.createDataFrame([(1, "abc"), (2, None), (3, "ab"), (4, "ä\U0001f600z" * 50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["colour_hash"](spark, str(tmp_path))
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows if r["hex"] is None) == [2, 3] and len(rows) == 4
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(found._jdf.queryExecution().executedPlan())
    assert code.size() > 0 and max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000
