"""CRC-32 of a whole from the CRC-32s of its parts."""

from __future__ import annotations

from functools import lru_cache

_POLY = 0xEDB88320


def _times(mat: tuple[int, ...], vec: int) -> int:
    out, i = 0, 0
    while vec:
        if vec & 1:
            out ^= mat[i]
        vec, i = vec >> 1, i + 1
    return out


@lru_cache(None)
def _zeros(power: int) -> tuple[int, ...]:
    """The operator on a CRC that ``2 ** power`` zero bits bring about, as columns over GF(2)."""
    if power == 0:
        return (_POLY, *(1 << i for i in range(31)))
    half = _zeros(power - 1)
    return tuple(_times(half, c) for c in half)


def moved(crc: int, n_bytes: int) -> int:
    """What a part with this CRC adds (by xor) to the CRC of a whole in which ``n_bytes`` follow the part."""
    power = 3
    while n_bytes and crc:
        if n_bytes & 1:
            crc = _times(_zeros(power), crc)
        n_bytes, power = n_bytes >> 1, power + 1
    return crc
