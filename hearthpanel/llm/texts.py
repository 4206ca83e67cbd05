"""Words and word shingles of whole texts as arrays of 64-bit hashes (used inside tasks)."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16
"""Bytes hashed at once, so that a text of any length takes bounded memory besides its own words."""

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x100000001B3
_POWER = _powers(_BASE, BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes that are not marked in `gap`."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~gap[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of at most BLOCK bytes `data`, the same wherever the span lies."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data.astype(np.uint64) * _POWER[:len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * _INVERSE[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * _ODD)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    return _LOWER[data]


def utf8(text: str | None) -> np.ndarray:
    """Bytes of a text; none for null."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def blocks(data: np.ndarray, gap: np.ndarray) -> list[np.ndarray]:
    """`data` cut into blocks of at most BLOCK bytes, each but the last ending at a byte marked in `gap` if it has one."""
    out, begin = [], 0
    while begin < len(data):
        end = min(begin + BLOCK, len(data))
        if end < len(data):
            cuts = np.flatnonzero(gap[data[begin:end]])
            end = begin + int(cuts[-1]) + 1 if len(cuts) else end
        out.append(data[begin:end])
        begin = end
    return out


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """One hash per word `[^\\x20\\x09-\\x0D]+` of the whole text, A-Z lower-cased if asked.

    Null, empty and blank texts have no words. A text is hashed in blocks that end at white space;
    only a single word longer than a block is hashed in pieces of a block each.
    """
    data = lowered(utf8(text)) if lower else utf8(text)
    parts = [span_hashes(block, *word_bounds(block)) for block in blocks(data, _SPACE)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; fewer words give none."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        total = (total + words[k:k + count]) * np.uint64((0xD6E8FEB86659FD93 + 2 * k) & _MASK)
        total ^= total >> np.uint64(32)
    return mixed(total + np.uint64(width))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle as a whole, no words give none."""
    if len(words) == 0:
        return words
    return np.unique(window_hashes(words, min(width, len(words))))


PARITY_WORDS = 16


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of 1,024 places, as 16 longs.

    The places at which two sets disagree are at most as many as the shingles that are in one of them only.
    """
    odd = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
