"""CRC-32C of many byte strings at once, and its masked form for checksums stored beside their data.

A checksum is linear in its bytes: strings are cut into blocks of equal size,
all blocks are worked off side by side, and neighbouring blocks are joined by
shifting the earlier one over the later one, level by level.
"""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0x82F63B78
_WORDS = 16  # in a block of 64 bytes, 2^6
_LEVEL = 6
_MASK_DELTA = np.uint32(0xA282EAD8)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_T0 = _byte_table()


def _over_a_byte(c: np.ndarray) -> np.ndarray:
    return (c >> np.uint32(8)) ^ _T0[c & np.uint32(255)]


_HALF = np.arange(1 << 16, dtype=np.uint32)
_HIGH = _T0[_HALF >> 8] ^ _over_a_byte(_T0[_HALF & 255])
_LOW = _over_a_byte(_over_a_byte(_HIGH))


def _tables(images: np.ndarray) -> np.ndarray:
    """Four tables of 256 of the linear map that takes bit k to ``images[k]``."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1
    return np.stack([
        np.bitwise_xor.reduce(np.where(bits, images[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)
    ]).astype(np.uint32)


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def _shifts() -> list[np.ndarray]:
    """Maps over 2^k zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [_tables(_over_a_byte(bits))]
    for _ in range(47):
        out.append(_tables(_apply(out[-1], _apply(out[-1], bits))))
    return out


_SHIFTS = _shifts()


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksum of ``data[start:end]`` for each pair of bounds."""
    sizes = np.asarray(ends, np.int64) - starts
    counts = -(-sizes // (4 * _WORDS))
    stops = np.cumsum(counts) * (4 * _WORDS)
    # Zeros before a string leave the bare checksum as it is.
    padded = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    for start, end, size, stop in zip(np.asarray(starts).tolist(), np.asarray(ends).tolist(), sizes.tolist(), stops.tolist()):
        padded[stop - size : stop] = data[start:end]
    words = padded.view("<u4").reshape(-1, _WORDS)
    c = np.zeros(len(words), np.uint32)
    for k in range(_WORDS):
        c ^= words[:, k]
        c = _LOW[c & 0xFFFF] ^ _HIGH[c >> 16]
    level = _LEVEL
    while counts.max(initial=0) > 1:
        pairs = (counts + 1) // 2
        even = np.zeros(2 * int(pairs.sum()), np.uint32)
        shift = 2 * np.cumsum(pairs) - np.cumsum(counts)
        even[np.arange(len(c)) + np.repeat(shift, counts)] = c
        c, counts, level = _apply(_SHIFTS[level], even[0::2]) ^ even[1::2], pairs, level + 1
    bare = np.zeros(len(sizes), np.uint32)
    bare[sizes > 0] = c
    start = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max(initial=0)).bit_length()):
        start = np.where((sizes >> k) & 1 == 1, _apply(_SHIFTS[k], start), start)
    return bare ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The stored form: turned and shifted, so that data that hold their own checksum do not look alike."""
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + _MASK_DELTA
