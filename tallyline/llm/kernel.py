"""Vectorised text kernels on the bytes of an Arrow string column: words, their 64-bit hashes, and runs of hashes.

All arithmetic is modulo 2**64. A word's hash is a polynomial in its bytes, each first replaced by a random 64-bit number,
then mixed; two different words collide with a chance of about 2**-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=_U)


def lookup(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is-word by byte, random number by byte); with fold, A-Z count as a-z."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    number = _RANDOM.copy()
    if fold:
        number[65:91] = number[97:123]
    return word, number


#: bytes that part words: the six ASCII white-space characters
SPACE = lookup(b" \t\n\v\f\r", False)
#: A-Z lower-cased; words are runs of 0-9, a-z and of all that is not ASCII
ALNUM = lookup(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets n + 1 from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and for each of the n texts + 1 the number of words before it."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = kind[0][data]
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.unique(offsets)
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts - 1] == 1)]  # a word can't reach over two texts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: tuple[np.ndarray, np.ndarray], piece: int = 1 << 21) -> np.ndarray:
    """64-bit hashes of the spans, which are in order and apart."""
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + piece, "right")))
        part = data[low : ends[to - 1]]
        n = len(part)
        up, down = _powers(max(piece, 1 << (n - 1).bit_length() if n > 1 else 1))
        total = np.zeros(n + 1, _U)
        np.cumsum(kind[1][part] * up[:n], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(_U)
        at = to
    return mix(out)


def runs(hashed: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of k hashes that stays inside one text; `first` as from words()."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.zeros(n, _U)
    for i in range(k):
        h = (h ^ hashed[i : i + n]) * _U(0x9FB21C651E98DF25)
        h ^= h >> _U(32)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[:n] == doc[k - 1 :]
    return mix(h[whole]), doc[:n][whole]
