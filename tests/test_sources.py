"""Formats, limits and decoders, against encoders written here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.sources import codecs, images


def bmp24(p):
    h, w = p.shape[:2]
    rows = b"".join((r[:, ::-1].tobytes()).ljust(-(-w * 3 // 4) * 4, b"\0") for r in p[::-1])
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(rows), 0, 54, 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + rows


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(p, colour, depth=8, filters=(0, 1, 2, 3, 4), extra=b""):
    h, w = p.shape[:2]
    step = max(1, p.shape[2] * depth // 8)
    lines, above, out = p.reshape(h, -1).astype(">u2" if depth == 16 else np.uint8), None, b""
    raw = [bytes(x.tobytes()) for x in lines]
    above = bytes(len(raw[0]))
    for y, own in enumerate(raw):
        k = filters[y % len(filters)]
        coded = bytearray()
        for x, v in enumerate(own):
            a, b, c = own[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            q = a + b - c
            guess = (0, a, b, (a + b) // 2, min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2])[k]
            coded.append((v - guess) & 255)
        out += bytes([k]) + coded
        above = own
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


RNG = np.random.default_rng(1)


@pytest.mark.parametrize("w", [1, 2, 5, 8])
def test_bmp(w):
    p = RNG.integers(0, 256, (6, w, 3), dtype=np.uint8)
    assert (codecs.bmp(bmp24(p)) == p).all()


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_png(colour, n, depth):
    p = RNG.integers(0, 1 << depth, (11, 7, n)).astype(np.uint16)
    got = codecs.png(png(p, colour, depth))
    want = p if depth == 8 else np.minimum(p, 255) if colour == 0 else p >> 8
    want = np.dstack([want[:, :, :1]] * 3 + ([want[:, :, 1:]] if colour == 4 else [])) if colour in (0, 4) else want
    assert (got == want).all()


def test_png_palette_with_transparency():
    p = RNG.integers(0, 3, (4, 5, 1), dtype=np.uint8)
    table = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], np.uint8)
    got = codecs.png(png(p, 3, extra=chunk(b"PLTE", table.tobytes()) + chunk(b"tRNS", b"\x10\x20")))
    assert (got[:, :, :3] == table[p[:, :, 0]]).all() and (got[:, :, 3] == np.array([16, 32, 255])[p[:, :, 0]]).all()


def test_rle8():
    body = bytes([3, 7, 0, 3, 1, 2, 3, 0, 0, 0, 6, 9, 0, 1])
    table = b"".join(bytes([k, k, k, 0]) for k in range(256))
    data = b"BM" + struct.pack("<IIIIiiHHIIIIII", 0, 0, 54 + 1024, 40, 6, 2, 1, 8, 1, 0, 0, 0, 0, 0) + table + body
    assert codecs.bmp(data)[:, :, 0].tolist() == [[9] * 6, [7, 7, 7, 1, 2, 3]]


def gif(index, table, clear=None, interlaced=False, at=(0, 0), canvas=None):
    """Codes of nine bits only: a clear code often enough that they never grow."""
    h, w = index.shape
    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)] if interlaced else range(h)
    bits, n = 0, 0
    for k, v in enumerate(v for r in order for v in index[r].tolist()):
        for code in ([256] if k % 100 == 0 else []) + [v]:
            bits, n = bits | code << n, n + 9
    bits, n = bits | 257 << n, n + 9
    raw = bits.to_bytes((n + 7) // 8, "little")
    blocks = b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"
    cw, ch = canvas or (w, h)
    control = b"\x21\xf9\x04" + bytes([1, 0, 0, clear, 0]) if clear is not None else b""
    return b"GIF89a" + struct.pack("<HHBBB", cw, ch, 0xF7, 2, 0) + table.tobytes() + control + b"\x2c" + struct.pack("<HHHHB", *at, w, h, 64 * interlaced) + b"\x08" + blocks + b"\x3b"


@pytest.mark.parametrize("interlaced", [False, True])
def test_gif(interlaced):
    table = RNG.integers(0, 256, (256, 3), dtype=np.uint8)
    index = RNG.integers(0, 256, (13, 21))
    assert (codecs.gif(gif(index, table, interlaced=interlaced)) == table[index]).all()
    got = codecs.gif(gif(index, table, clear=int(index[0, 0]), at=(2, 3), canvas=(30, 20)))
    assert got.shape == (20, 30, 4) and (got[0, 0, :3] == table[2]).all() and got[3, 2, 3] == 0 and (got[3:16, 2:23, :3] == table[index]).all()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("method", [1, 8, 5])
@pytest.mark.parametrize("samples", [1, 3])
def test_tiff(order, method, samples):
    p = RNG.integers(0, 256, (9, 7, samples), dtype=np.uint8)
    def coded(raw):
        if method == 8:
            return zlib.compress(raw)
        if method == 1:
            return raw
        bits = "".join(("100000000" if k % 200 == 0 else "") + f"{v:09b}" for k, v in enumerate(raw)) + "100000001"
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    strips = [coded(p[:5].tobytes()), coded(p[5:].tobytes())]
    places = [8, 8 + len(strips[0])]
    far = 8 + sum(map(len, strips))
    tags = [(256, 3, [7]), (257, 3, [9]), (258, 3, [8] * samples), (259, 3, [method]), (262, 3, [2 if samples == 3 else 1]), (273, 4, places), (277, 3, [samples]), (278, 3, [5]), (279, 4, [len(s) for s in strips])]
    extra, entries = b"", b""
    for tag, kind, values in tags:
        body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(body) > 4:
            body, extra = struct.pack(order + "I", far + len(extra)), extra + body
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", far + len(extra)) + b"".join(strips) + extra + struct.pack(order + "H", len(tags)) + entries + bytes(4)
    assert (codecs.tiff(data) == np.broadcast_to(p, (9, 7, 3))).all() and codecs.stated_size(data, "tiff") == (7, 9)


def test_jpeg_size():
    head = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xff\xc2" + struct.pack(">HBHHB", 8, 8, 33, 44, 3)
    assert codecs.stated_size(head, "jpeg") == (44, 33) and codecs.stated_size(b"\xff\xd8\xff", "jpeg") is None


def test_errors_are_rows(spark, tmp_path):
    good = bmp24(RNG.integers(0, 256, (4, 4, 3), dtype=np.uint8))
    files = {"a.bmp": good, "b.bmp": good[:60], "c.txt": b"hello", "d.jpg": b"\xff\xd8\xff\xe0" + bytes(20), "f.png": b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 1 << 20, 1 << 20), "g.bmp": good + bytes(5000)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = images.decoded(images.read_images(spark, str(tmp_path), max_bytes=4000)).select(F.element_at(F.split("path", "/"), -1).alias("n"), "error.kind", F.col("raster.width").alias("w")).collect()
    got = {r["n"]: (r["kind"], r["w"]) for r in rows}
    assert got == {"a.bmp": (None, 4), "b.bmp": ("truncated", None), "c.txt": ("unsupportedFormat", None), "d.jpg": ("unsupportedFeature", None), "f.png": ("imageTooLarge", None), "g.bmp": ("imageTooLarge", None)}


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"BM")
    df = images.read_images(spark, str(tmp_path), max_bytes=10)
    assert "LessThanOrEqual(length,10)], ReadSchema" in df._jdf.queryExecution().toString()


def jpeg_head(w, h, kind=0xC0, before=b""):
    return b"\xff\xd8" + before + b"\xff" + bytes([kind]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + bytes(9)


def tiff_head(w, h, order="<", kinds=(3, 4), at=8):
    value = lambda v, k: struct.pack(order + ("HH" if k == 3 else "I"), *((v, 0) if k == 3 else (v,)))
    entries = struct.pack(order + "HHI", 254, 4, 1) + bytes(4) + struct.pack(order + "HHI", 256, kinds[0], 1) + value(w, kinds[0]) + struct.pack(order + "HHI", 257, kinds[1], 1) + value(h, kinds[1])
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + bytes(at - 8) + struct.pack(order + "H", 3) + entries


def test_sizes_of_jpeg_and_tiff(spark):
    segment = lambda kind, n: b"\xff" + bytes([kind]) + struct.pack(">H", n + 2) + b"\xff" * n
    files = [
        (jpeg_head(640, 480), (640, 480)),
        (jpeg_head(70, 9, 0xC2, segment(0xE0, 14) + segment(0xDB, 65) + segment(0xC4, 30)), (70, 9)),
        (jpeg_head(1, 65535, 0xCF, b"\xff\xff\xff\x01" + segment(0xE1, 5000)), (1, 65535)),
        (jpeg_head(5, 5, 0xDA), None),
        (b"\xff\xd8\xff\xe0\xff\xf0", None),
        (b"\xff\xd8", None),
        (b"\xff\xd8" + segment(0xE0, 3) + b"\0\0\0", None),
        (tiff_head(300, 70000), (300, 70000)),
        (tiff_head(7, 8, ">", (4, 3), 40), (7, 8)),
        (tiff_head(7, 8)[:-5], None),
        (tiff_head(7, 8, at=8)[:4] + struct.pack("<I", 4_000_000_000), None),
    ]
    rows = spark.createDataFrame([(k, bytearray(f)) for k, (f, _) in enumerate(files)], "k int, content binary")
    got = {r["k"]: r["size"] and tuple(r["size"]) for r in rows.select("k", images.size_of(F.col("content")).alias("size")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(files)}
    kinds = [r["error"] and r["error"]["kind"] for r in images.checked(rows, max_pixels=65535).orderBy("k").collect()]
    assert kinds[0] == kinds[7] == "imageTooLarge" and kinds[1] is None


def test_too_large_files_are_rows(spark, tmp_path):
    small, large = bmp24(RNG.integers(0, 256, (2, 2, 3), dtype=np.uint8)), bmp24(RNG.integers(0, 256, (20, 20, 3), dtype=np.uint8))
    (tmp_path / "a.bmp").write_bytes(small)
    (tmp_path / "b.bmp").write_bytes(large)
    rows = {r["path"][-5:]: r for r in images.decoded(images.read_images(spark, str(tmp_path), max_bytes=len(small))).collect()}
    assert rows["a.bmp"]["error"] is None and rows["a.bmp"]["raster"]["width"] == 2
    assert rows["b.bmp"]["error"]["kind"] == "imageTooLarge" and rows["b.bmp"]["content"] is None and rows["b.bmp"]["raster"] is None


def test_raster_faults(spark):
    rows = [(1, (2, 1, 3, bytearray(6))), (2, (2, 1, 4, bytearray(6))), (3, (0, 1, 3, bytearray(0))), (4, (2, 1, 2, bytearray(4))), (5, None), (6, (1, 1, 3, None))]
    df = spark.createDataFrame(rows, f"k int, raster {images.RASTER}")
    got = {r["k"]: r["f"] for r in df.select("k", images.raster_fault(F.col("raster")).alias("f")).collect()}
    assert got[1] is None and got[3].startswith("sides") and got[4].startswith("channels") and got[5] == "no raster" and got[2] == got[6] and "bytes" in got[2]
