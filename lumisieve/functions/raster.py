"""Numeric steps on one raster, for use inside Arrow-batched functions. Integer steps are exact wherever they run."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bits of a resampling weight, the kernel's reach, sqrt(1/2) as the square root of 0.5, and the analysis
#: low-pass filter of Daubechies' wavelet with four vanishing moments.
WEIGHT_BITS, REACH, HALF_ROOT = 22, 3.0, 0.7071067811865476
DB4_LOW = (-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965)


def composited(pixels: np.ndarray) -> np.ndarray:
    """RGB of an RGB or RGBA raster over black."""
    if pixels.shape[2] == 3:
        return pixels
    p = pixels.astype(np.uint32)
    return (p[:, :, :3] * p[:, :, 3:] // 255).astype(np.uint8)


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[:, :, k].astype(np.uint32) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = rgb.reshape(-1, 3).astype(np.int32)
    high, low = c.max(1), c.min(1)
    span = np.where(high == low, 1, high - low)
    red, green, blue = (((high - c[:, k]) * 255) // span for k in range(3))
    steps = np.select([c[:, 0] == high, c[:, 1] == high], [blue - green, 510 + red - blue], 1020 + green - red)
    hue = np.where(high == low, 0, np.where(steps < 0, steps + 1530, steps) // 6)
    return hue, np.where(high == low, 0, (high - low) * 255 // np.maximum(high, 1)), high


@lru_cache(256)
def _weights(source: int, target: int) -> np.ndarray:
    """Row k: how much each source place adds to target place k, in units of 2 ** -WEIGHT_BITS (whole, as float64)."""
    scale = source / target
    wide = max(1.0, scale)
    out = np.zeros((target, source))
    for k in range(target):
        middle = (k + 0.5) * scale
        lo, hi = max(0, int(middle - REACH * wide + 0.5)), min(source, int(middle + REACH * wide + 0.5))
        x = (np.arange(lo, hi) + 0.5 - middle) / wide
        w = np.where(np.abs(x) < REACH, np.sinc(x) * np.sinc(x / REACH), 0.0)
        total = np.add.accumulate(w)[-1] if len(w) else 0.0
        w = (w / total if total else w) * (1 << WEIGHT_BITS)
        out[k, lo:hi] = np.copysign(np.floor(np.abs(w) + 0.5), w)
    return out


def resized(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos, columns first, rounded to bytes in between. Sums are below 2 ** 53, so float64 products are exact."""
    half = 1 << (WEIGHT_BITS - 1)
    narrow = lambda acc: np.clip((acc.astype(np.int64) + half) >> WEIGHT_BITS, 0, 255).astype(np.uint8)
    across = narrow(plane.astype(np.float64) @ _weights(plane.shape[1], width).T)
    return narrow(_weights(plane.shape[0], height) @ across.astype(np.float64))


def dct(x: np.ndarray, axis: int) -> np.ndarray:
    """DCT-II, twice the plain sum: by one complex FFT of even places, then odd ones backwards."""
    x = np.moveaxis(np.asarray(x, np.float64), axis, -1)
    n = x.shape[-1]
    folded = np.concatenate([x[..., ::2], x[..., 1::2][..., ::-1]], -1)
    turned = np.fft.fft(folded, axis=-1) * np.exp(-0.5j * np.pi * np.arange(n) / n)
    return np.moveaxis(2 * turned.real, -1, axis)


def _paired(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.moveaxis(x, axis, 0)
    if len(x) % 2:
        x = np.concatenate([x, x[-1:]])
    a, b = HALF_ROOT * x[::2], HALF_ROOT * x[1::2]
    return np.moveaxis(a + b, 0, axis), np.moveaxis(a - b, 0, axis)


def haar(x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One level: the low band, and the three others (horizontal, vertical, diagonal details)."""
    low, high = _paired(x, 0)
    (ll, lh), (hl, hh) = _paired(low, 1), _paired(high, 1)
    return ll, (hl, lh, hh)


def haar_inverse(ll: np.ndarray, details: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    hl, lh, hh = details
    ll = ll[: lh.shape[0], : lh.shape[1]]

    def joined(a, b, axis):
        a, b = HALF_ROOT * np.moveaxis(a, axis, 0), HALF_ROOT * np.moveaxis(b, axis, 0)
        out = np.empty((2 * len(a), *a.shape[1:]))
        out[::2], out[1::2] = a + b, a - b
        return np.moveaxis(out, 0, axis)

    return joined(joined(ll, lh, 1), joined(hl, hh, 1), 0)


def haar_levels(x: np.ndarray, levels: int) -> tuple[np.ndarray, list]:
    details = []
    for _ in range(levels):
        x, d = haar(x)
        details.append(d)
    return x, details


def without_mean(x: np.ndarray, levels: int) -> np.ndarray:
    """``x`` after the coarsest low band is set to zero."""
    ll, details = haar_levels(x, levels)
    ll = np.zeros_like(ll)
    for d in reversed(details):
        ll = haar_inverse(ll, d)
    return ll


def db4_low(x: np.ndarray, levels: int) -> np.ndarray:
    """The low band of Daubechies' wavelet, edges mirrored with the edge repeated; taps are added in their order."""
    def half(v: np.ndarray) -> np.ndarray:
        n = (len(v) + 7) // 2
        wide = np.pad(v, [(7, 7), (0, 0)], mode="symmetric")
        out = np.zeros((n, v.shape[1]))
        for k, tap in enumerate(DB4_LOW):
            at = 2 * np.arange(n) + 8 - k
            out = out + tap * wide[at]
        return out

    for _ in range(levels):
        x = half(half(x).T).T
    return x


def blurred(plane: np.ndarray, radius: float = 2.0, passes: int = 3) -> np.ndarray:
    """Gaussian blur as box blurs of a fractional radius, in 24-bit fixed point, edges repeated, bytes between passes."""
    variance = radius * radius / passes
    whole = np.floor((np.sqrt(12 * variance + 1) - 1) / 2)
    box = whole + (2 * whole + 1) * (whole * (whole + 1) - 3 * variance) / (6 * (variance - (whole + 1) ** 2))
    r = int(box)
    inner = int((1 << 24) / (box * 2 + 1))
    outer = ((1 << 24) - (2 * r + 1) * inner) // 2

    # Sums are below 2 ** 32: no more than 255 in units of 2 ** -24, and a half.
    inner, outer = np.uint32(inner), np.uint32(outer)

    def along(p: np.ndarray) -> np.ndarray:
        """Down the columns, where a neighbour is a whole row away. A box is a difference of running sums."""
        n = len(p)
        wide = np.concatenate([np.repeat(p[:1], r + 1, 0), p, np.repeat(p[-1:], r + 1, 0)]).astype(np.uint32)
        if r <= 2:
            near = sum((wide[d : d + n] for d in range(2, 2 * r + 2)), wide[1 : 1 + n])
        else:
            sums = np.concatenate([np.zeros_like(wide[:1]), np.cumsum(wide, 0, dtype=np.uint32)])
            near = sums[2 * r + 2 : 2 * r + 2 + n] - sums[1 : 1 + n]
        return ((near * inner + (wide[:n] + wide[2 * r + 2 :]) * outer + np.uint32(1 << 23)) >> np.uint32(24)).astype(np.uint8)

    plane = np.ascontiguousarray(plane.T)
    for _ in range(passes):
        plane = along(plane)
    plane = np.ascontiguousarray(plane.T)
    for _ in range(passes):
        plane = along(plane)
    return plane


def median3(plane: np.ndarray) -> np.ndarray:
    """The fifth of nine neighbours, by least and greatest ones of whole planes: each line of three is put in order; then
    it is the middle of the greatest least one, the middle of the middle ones, and the least greatest one."""
    h, w = plane.shape
    wide = np.pad(plane, 1, mode="edge")

    def ordered(a, b, c):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        return np.minimum(lo, c), np.maximum(lo, np.minimum(hi, c)), np.maximum(hi, c)

    lows, middles, highs = zip(*(ordered(*(wide[y : y + h, x : x + w] for x in range(3))) for y in range(3)))
    low = np.maximum(np.maximum(lows[0], lows[1]), lows[2])
    high = np.minimum(np.minimum(highs[0], highs[1]), highs[2])
    return ordered(low, ordered(*middles)[1], high)[1]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of places in a row of the mask: their row, first place and the one after, and the first place (row by
    row) of their 4-connected region. Runs are joined with those that they touch in the row above."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    top = list(range(len(row)))

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    bounds, b, e = np.searchsorted(row, np.arange(h + 1)).tolist(), begin.tolist(), end.tolist()
    for y in range(1, h):
        i, j = bounds[y - 1], bounds[y]
        while i < bounds[y] and j < bounds[y + 1]:
            if b[i] < e[j] and b[j] < e[i]:
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    first = np.array([find(k) for k in range(len(row))], np.int64)
    return row, begin, end, (row * w + begin)[first] if len(row) else first


def regions(mask: np.ndarray) -> np.ndarray:
    """For each place of the mask, the first place of its region; elsewhere -1."""
    row, begin, end, places = runs(mask)
    label, size = np.full(mask.size, -1), end - begin
    at = np.repeat(row * mask.shape[1] + begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    label[at] = np.repeat(places, size)
    return label.reshape(mask.shape)


def segments(plane: np.ndarray, threshold: float = 128, least_size: int = 500) -> list[tuple[int, tuple[int, int, int, int]]]:
    """(size, (top, left, bottom, right)) of regions above the threshold, then of those not above it, each kind by first
    place. Valleys are looked for only while what is found, plus the border, is less than the whole."""
    h, w = plane.shape
    out, done = [], 0
    for hills in (True, False):
        row, begin, end, places = runs(plane > threshold if hills else plane <= threshold)
        firsts, at = np.unique(places, return_inverse=True)
        sizes = np.bincount(at, end - begin, len(firsts)).astype(np.int64)
        box = [np.full(len(firsts), v) for v in (h, w, -1, -1)]
        for fold, edge, v in ((np.minimum, box[0], row), (np.minimum, box[1], begin), (np.maximum, box[2], row), (np.maximum, box[3], end - 1)):
            fold.at(edge, at, v)
        for k, size in enumerate(sizes.tolist()):
            if not hills and 2 * (h + w) + done >= h * w:
                break
            done += size
            if size > least_size:
                out.append((size, tuple(int(e[k]) for e in box)))
    return out
