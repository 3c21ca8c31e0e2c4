"""Words of many texts at once, as 64-bit hashes computed from the bytes by numpy.

A word's hash is a polynomial of its bytes, taken as a difference of running sums over a whole slice of texts, and mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_bytes

_P = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
#: Bytes hashed at a time; a longer text stays whole.
PART = 1 << 19
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        for name, base in (("_powers", _P), ("_inverses", pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of a text column, and where each text's words start
    and the last one's end. Many texts take no more memory than PART bytes of them, or the longest one."""
    raw, offsets = text_bytes(column)
    part = offsets[1:] // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(offsets) - 1]
    hashes, bounds, before = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b in zip(cuts, cuts[1:]):
        h, found = _word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes.append(h)
        bounds.append(found[1:] + before)
        before += len(h)
    return np.concatenate(hashes), np.concatenate(bounds)


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    start[first] = inside[first]  # a text's last word does not run on into the next text
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    at, to = np.flatnonzero(start), np.flatnonzero(end) + 1
    _grow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.multiply(_VALUE[raw], _powers[: len(raw)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    h = (sums[to] - sums[at]) * _inverses[at]
    return mixed(h ^ (to - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(at, offsets)


def planes(values: np.ndarray) -> bytes:
    """Integers as bytes, all lowest bytes first, so that the mostly empty high ones compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def deltas(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=ascending.dtype.type(0)))


def undeltas(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unplanes(data, kind), dtype=kind)
