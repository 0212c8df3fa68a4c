"""Words and word windows of a whole Arrow batch at once, as numpy arrays over its UTF-8 bytes.

Separators of all word rules used here are ASCII, so splitting bytes equals splitting code points.
Hashes are 64-bit polynomials over bytes (words) or word hashes (windows), taken from prefix sums
modulo 2**64 and then mixed. Prefix sums are made a piece at a time and kept only where a range begins
or ends, so a text takes memory for its words, not for eight numbers a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (one longer text is handled whole: it takes some 20 times its size).
CHUNK = 1 << 19
#: Values of a prefix sum that are made at a time.
PIECE = 1 << 16

U = np.uint64
_R, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base][0][:n], _powers[base][1][:n]


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges of values, the same for equal contents wherever they start. starts and ends rise."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    up, down = powers(base, PIECE)
    inverse, total = pow(base, -1, 1 << 64), np.zeros(1, U)
    at_start, at_end, back = np.empty(len(starts), U), np.empty(len(starts), U), np.empty(len(starts), U)
    sums = np.zeros(min(PIECE, len(values)) + 1, dtype=U)
    s = e = 0
    for a in range(0, len(values) + 1, PIECE):
        own = values[a : a + PIECE]
        part = sums[: len(own) + 1]
        np.cumsum(own.astype(U) * up[: len(own)], out=part[1:])
        part[1:] *= U(pow(base, a, 1 << 64))
        s_to, e_to = np.searchsorted(starts, a + PIECE), np.searchsorted(ends, a + PIECE)
        here = starts[s:s_to] - a
        at_start[s:s_to] = part[here] + total
        back[s:s_to] = down[here] * U(pow(inverse, a, 1 << 64))
        at_end[e:e_to] = part[ends[e:e_to] - a] + total
        total += part[-1:]
        s, e = s_to, e_to
    return mix((at_end - at_start) * back + mix((ends - starts).astype(U)))


class Words:
    """The words of some texts. starts, ends: bytes; first: of each text its first word, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        data = LOWER[data] if lower else data
        self.data, self.offsets = data, offsets
        inside = table[data]
        filled = offsets[:-1] < offsets[1:]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][filled]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[offsets[1:][filled] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes."""
        return ranges(self.data, starts, ends, _R)

    def doc(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, hashes: np.ndarray, k: int, base: int = _Q) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of k words inside one text."""
        room = np.maximum(self.counts - k + 1, 0)
        begin = np.repeat(self.first[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
        return begin, ranges(hashes, begin, begin + k, base)


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of up to ``chunk`` bytes (or one longer text): from row, to row, bytes, offsets.

    A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
    give_back()


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps its own ways
        return None


_c = _libc()
if _c is not None:
    # glibc raises this limit to 32 MB by itself, and then keeps what arrays up to that size had
    _c.mallopt(-3, 2 << 20)


def give_back() -> None:
    """Workers live on from task to task: what this batch took goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _c is not None:
        _c.malloc_trim(0)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, exact for integers and booleans."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: keys that occur more than once, and those equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        k = keys[order]
        same[1:] = k[1:] == k[:-1]
    later = np.zeros(len(keys), bool)
    later[order] = same
    any_ = same.copy()
    any_[:-1] |= same[1:]
    more = np.zeros(len(keys), bool)
    more[order] = any_
    return more, later


def covered(n: int, begins: np.ndarray, lengths) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + lengths, -1)
    return np.cumsum(edge[:n]) > 0
