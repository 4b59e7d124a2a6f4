"""Bytes of one image to pixels: BMP, PNG, GIF (first frame) and baseline TIFF. Other formats are recognised and reported as not supported.

Each decoder gives an array height x width x channels or raises ``Fault`` with the kind of error that its row gets.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: More than this many pixels are never decoded.
MAX_PIXELS = 268_435_456


class Fault(Exception):
    def __init__(self, kind: str, detail: str):
        super().__init__(detail)
        self.kind, self.detail = kind, detail


def decode(data: bytes, kind: str) -> tuple[dict | None, dict | None]:
    """(raster, None) or (None, error)."""
    try:
        size = stated_size(bytes(data), kind)
        if size and size[0] * size[1] > MAX_PIXELS:
            raise Fault("imageTooLarge", "more pixels than the limit")
        if kind not in DECODERS:
            raise Fault("unsupportedFeature", f"no decoder for {kind}")
        p = np.ascontiguousarray(DECODERS[kind](bytes(data)))
        return {"width": p.shape[1], "height": p.shape[0], "channels": p.shape[2], "data": p.tobytes()}, None
    except Fault as e:
        return None, {"kind": e.kind, "format": kind, "detail": e.detail}
    except (struct.error, IndexError, ValueError, zlib.error) as e:
        return None, {"kind": "corruptInput", "format": kind, "detail": str(e)}


def bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size == 12:
        raise Fault("unsupportedFeature", "an OS/2 header")
    if size not in (40, 52, 56, 108, 124):
        raise Fault("corruptInput", f"a header of {size} bytes")
    width, height, planes, depth, method = struct.unpack_from("<iiHHI", data, 18)
    used = struct.unpack_from("<I", data, 46)[0]
    if planes != 1 or width <= 0 or height == 0:
        raise Fault("corruptInput", "planes or size")
    if method in (4, 5):
        raise Fault("unsupportedFeature", "an embedded image")
    rows, flip = abs(height), height > 0
    if method in (1, 2):
        index = _runs(data, start, width, rows, depth)
        pixels = _palette(data, size, used, depth)(index)
        return pixels[::-1] if flip else pixels
    stride = (width * depth + 31) // 32 * 4
    if len(data) < start + stride * rows:
        raise Fault("truncated", "fewer rows than the header says")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if method == 3 and depth in (16, 32):
        pixels = _masked(data, size, lines, width, depth)
    elif method:
        raise Fault("corruptInput", f"compression {method} at {depth} bits")
    elif depth in (24, 32):
        n = depth // 8
        pixels = lines[:, : width * n].reshape(rows, width, n)[:, :, 2::-1]
    elif depth in (1, 4, 8):
        pixels = _palette(data, size, used, depth)(_unpacked(lines, depth)[:, :width])
    elif depth == 16:
        w = lines[:, : width * 2].copy().view("<u2").astype(np.uint32)
        pixels = np.stack([((w >> s) & 31) * 255 // 31 for s in (10, 5, 0)], 2)
    else:
        raise Fault("unsupportedFeature", f"{depth} bits")
    return (pixels[::-1] if flip else pixels).astype(np.uint8)


def _unpacked(lines: np.ndarray, depth: int) -> np.ndarray:
    """Indices or samples of 1, 2, 4 or 8 bits, the high bits first."""
    if depth == 8:
        return lines
    per = 8 // depth
    shifts = np.arange(per - 1, -1, -1) * depth
    return ((lines[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(len(lines), -1).astype(np.uint8)


def _palette(data: bytes, header: int, used: int, depth: int):
    n = min(used or 1 << depth, 1 << depth)
    table = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
    return lambda index: table[np.minimum(index, n - 1)]


def _masked(data: bytes, header: int, lines: np.ndarray, width: int, depth: int) -> np.ndarray:
    masks = list(struct.unpack_from("<III", data, 54)) + ([struct.unpack_from("<I", data, 66)[0]] if header >= 56 else [0])
    if not all(masks[:3]):
        raise Fault("corruptInput", "an empty colour mask")
    words = lines[:, : width * depth // 8].copy().view("<u2" if depth == 16 else "<u4").astype(np.uint64)
    out = []
    for m in masks if masks[3] else masks[:3]:
        shift = (m & -m).bit_length() - 1
        out.append(((words & np.uint64(m)) >> np.uint64(shift)) * np.uint64(255) // np.uint64(m >> shift))
    return np.stack(out, 2)


def _runs(data: bytes, at: int, width: int, rows: int, depth: int) -> np.ndarray:
    """Run-length coded indices; runs end at the row's end, a short stream is an error."""
    out, x, y = np.zeros((rows, width), np.uint8), 0, 0
    while True:
        if at + 2 > len(data):
            raise Fault("corruptInput", "runs end early")
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            values = [v] * n if depth == 8 else [v >> 4 if k % 2 == 0 else v & 15 for k in range(n)]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            return out
        elif v == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
            continue
        else:
            n = v if depth == 8 else v // 2
            raw = data[at : at + n]
            values = list(raw) if depth == 8 else [d for b in raw for d in (b >> 4, b & 15)]
            at += n + n % 2
        if y < rows:
            fit = values[: max(0, width - x)]
            out[y, x : x + len(fit)] = fit
        x = min(width, x + len(values))


def png(data: bytes) -> np.ndarray:
    at, body, table, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) < size:
            raise Fault("truncated", "a chunk ends early")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            table = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not body:
        raise Fault("corruptInput", "no header or no data")
    width, height, depth, colour, _, _, interlaced = head
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if samples is None or not width or not height or depth not in (1, 2, 4, 8, 16):
        raise Fault("corruptInput", "colour type, depth or size")
    raw, at = zlib.decompressobj().decompress(b"".join(body)), 0
    whole = np.zeros((height, width, samples), np.uint16)
    # First column, first row and steps of the passes.
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlaced else ((0, 0, 1, 1),)
    for x, y, dx, dy in passes:
        w, h = len(range(x, width, dx)), len(range(y, height, dy))
        if w and h:
            stride = (w * samples * depth + 7) // 8
            lines = _unfiltered(raw, at, stride, h, max(1, samples * depth // 8))
            at += (stride + 1) * h
            values = lines.reshape(h, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16) if depth == 16 else _unpacked(lines, depth)
            whole[y::dy, x::dx] = values[:, : w * samples].reshape(h, w, samples)
    if colour == 3:
        if table is None:
            raise Fault("corruptInput", "no palette")
        index = np.minimum(whole[:, :, 0], len(table) - 1)
        pixels = table[index]
        if clear is not None:
            alpha = np.concatenate([clear, np.full(max(0, len(table) - len(clear)), 255, np.uint8)])
            pixels = np.dstack([pixels, alpha[index]])
        return pixels
    if depth == 16:  # plain gray is capped, all else keeps its high byte
        whole = np.minimum(whole, 255) if colour == 0 else whole >> 8
    elif depth < 8:
        whole = whole * (255 // ((1 << depth) - 1))
    whole = whole.astype(np.uint8)
    if colour in (0, 4):
        whole = np.dstack([whole[:, :, :1]] * 3 + ([whole[:, :, 1:]] if colour == 4 else []))
    return whole


def _unfiltered(raw: bytes, at: int, stride: int, rows: int, step: int) -> np.ndarray:
    if len(raw) < at + (stride + 1) * rows:
        raise Fault("truncated", "fewer rows than the header says")
    out, above = np.zeros((rows, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(rows):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        at += stride + 1
        if kind == 0:
            own = line.copy()
        elif kind == 2:
            own = line + above
        elif kind == 1:
            wide = np.pad(line, (0, -stride % step)).reshape(-1, step)
            own = np.cumsum(wide, 0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind in (3, 4):
            own = bytearray(line.tobytes())
            up = above.tobytes()
            for x in range(stride):
                a, b = own[x - step] if x >= step else 0, up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x - step] if x >= step else 0
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                own[x] = (own[x] + guess) & 255
            own = np.frombuffer(bytes(own), np.uint8)
        else:
            raise Fault("corruptInput", f"filter {kind}")
        out[y] = above = own
    return out


def gif(data: bytes) -> np.ndarray:
    width, height, flags, ground = struct.unpack_from("<HHBB", data, 6)
    table = lambda at, f: (np.frombuffer(data, np.uint8, 3 * (2 << (f & 7)), at).reshape(-1, 3), at + 3 * (2 << (f & 7)))
    colours, at = table(13, flags) if flags & 128 else (None, 13)
    canvas = np.zeros((height, width, 3), np.uint8)
    if colours is not None and ground < len(colours):
        canvas[:] = colours[ground]
    clear = None
    while True:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear = data[at + 6]
            _, at = _blocks(data, at + 2)
        elif kind == 0x2C:
            break
        else:
            raise Fault("corruptInput", "no frame")
    x, y, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
    colours, at = table(at + 10, own) if own & 128 else (colours, at + 10)
    if colours is None or x + w > width or y + h > height or not w or not h:
        raise Fault("corruptInput", "no palette, or a frame beyond the canvas")
    packed, _ = _blocks(data, at + 1)
    index = _lzw(packed, data[at], w * h).reshape(h, w)
    if own & 64:  # rows come in four passes (fixed values: first row, step)
        order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
        index = index[np.argsort(order)]
    if index.max() >= len(colours):
        raise Fault("corruptInput", "an index beyond the palette")
    canvas[y : y + h, x : x + w] = colours[index]
    if clear is None:
        return canvas
    alpha = np.full((height, width), 255, np.uint8)
    alpha[y : y + h, x : x + w][index == clear] = 0
    return np.dstack([canvas, alpha])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(out), at + 1


def _lzw(data: bytes, root: int, wanted: int, high_first: bool = False, early: int = 0) -> np.ndarray:
    """LZW codes to bytes: GIF's order of bits, or TIFF's with its code lengths that grow one code early."""
    clear, bits, held, at, out = 1 << root, 0, 0, 0, bytearray()
    size, words, last = root + 1, [], None
    while len(out) < wanted:
        while bits < size:
            if at >= len(data):
                raise Fault("truncated", "codes end early")
            held = held << 8 | data[at] if high_first else held | data[at] << bits
            bits, at = bits + 8, at + 1
        if high_first:
            code, held = held >> (bits - size), held & ((1 << (bits - size)) - 1)
        else:
            code, held = held & ((1 << size) - 1), held >> size
        bits -= size
        if code == clear:
            words, size, last = [bytes([k]) for k in range(clear)] + [b"", b""], root + 1, None
            continue
        if code == clear + 1 or not words and last is None and code > clear:
            break
        if not words:
            words = [bytes([k]) for k in range(clear)] + [b"", b""]
        if last is None:
            word = words[code]
        elif code < len(words):
            word = words[code]
            words.append(last + word[:1])
        elif code == len(words):
            word = last + last[:1]
            words.append(word)
        else:
            raise Fault("corruptInput", "a code before its word")
        if len(words) > 4096:
            words.pop()
        if len(words) + early >= 1 << size and size < 12:
            size += 1
        out += word
        last = word
    if len(out) < wanted:
        raise Fault("truncated", "fewer pixels than the header says")
    return np.frombuffer(bytes(out[:wanted]), np.uint8)


def tiff(data: bytes) -> np.ndarray:
    tags = tiff_tags(data)
    one = lambda tag, other=None: tags.get(tag, [other])[0]
    width, height, method, samples = one(256), one(257), one(259, 1), one(277, 1)
    if not width or not height or 273 not in tags:
        raise Fault("corruptInput", "no size or no strips")
    if set(tags.get(258, [1])) != {8} or one(262) not in (0, 1, 2) or samples != (3 if one(262) == 2 else 1) or one(284, 1) != 1 or method not in (1, 5, 8, 32946):
        raise Fault("unsupportedFeature", "more than 8-bit gray or RGB strips, plain, LZW or deflated")
    rows, parts = one(278, height), []
    for k, (at, n) in enumerate(zip(tags[273], tags.get(279, [len(data)] * len(tags[273])))):
        wanted, strip = min(rows, height - k * rows) * width * samples, data[at : at + n]
        if method == 5:
            part = _lzw(strip, 8, wanted, high_first=True, early=1)
        else:
            part = np.frombuffer(strip if method == 1 else zlib.decompress(strip), np.uint8)[:wanted]
        if len(part) < wanted:
            raise Fault("truncated", "a strip ends early")
        parts.append(part)
    pixels = np.concatenate(parts)[: width * height * samples].reshape(height, width, samples)
    if one(317, 1) == 2:
        pixels = np.cumsum(pixels, 1, dtype=np.uint8)
    if one(262) == 0:
        pixels = 255 - pixels
    return pixels if samples == 3 else np.repeat(pixels, 3, 2)


def tiff_tags(data: bytes) -> dict[int, list[int]]:
    """Whole-number entries of the first directory."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in (1, 3, 4) and n:
            code = {1: "B", 3: "H", 4: "I"}[kind]
            place = at + 10 + 12 * k
            if n * struct.calcsize("=" + code) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            out[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, place))
    return out


def jpeg_size(data: bytes) -> tuple[int, int]:
    """Width and height by the first frame header."""
    at = 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + n


def stated_size(data: bytes, kind: str) -> tuple[int, int] | None:
    """Width and height of formats whose size stands behind a pointer or after other parts."""
    try:
        if kind == "tiff":
            tags = tiff_tags(data)
            return tags[256][0], tags[257][0]
        return jpeg_size(data) if kind == "jpeg" else None
    except (struct.error, IndexError, KeyError):
        return None


DECODERS = {"bmp": bmp, "png": png, "gif": gif, "tiff": tiff}
