"""Word splitting and hashing of whole Arrow string columns with numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``. The separators are single ASCII bytes, so the
UTF-8 bytes of a column can be scanned as they are. A word's hash is a polynomial over its
bytes modulo 2**64 taken from prefix sums, then mixed; equal words have equal hashes in every
process, and different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_EDGE = np.zeros(256, bool)
_EDGE[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
    if n <= 1 << 22:  # a very long text's table isn't kept
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Words:
    """Words of consecutive texts: byte spans in ``data``, hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        if fold:
            data = _FOLD[data]
        self.data = data
        n = len(data)
        inside = ~_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: text i has the words bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)

    def split_edges(self) -> None:
        """Make runs of ASCII punctuation at a word's ends words of their own.

        Only where the text between them starts and ends with a letter or digit of Latin-1, and
        not for the signs ``'``, ``<``, ``>`` and ``|``, which contractions and special tokens use.
        """
        d, n = self.data, len(self.starts)
        left, right = self.starts.copy(), self.ends.copy()
        for _ in range(8):
            more = (left < right) & _EDGE[d[np.minimum(left, len(d) - 1)]] if len(d) else np.zeros(n, bool)
            if not more.any():
                break
            left += more
        for _ in range(8):
            more = (left < right) & _EDGE[d[right - 1]] if len(d) else np.zeros(n, bool)
            if not more.any():
                break
            right -= more
        at = np.minimum(left, max(0, len(d) - 1))
        ok = left < right
        if len(d):
            first, second = d[at], d[np.minimum(at + 1, len(d) - 1)]
            last, before = d[right - 1], d[np.maximum(right - 2, 0)]
            ok &= _ALNUM[first] | ((first == 0xC3) & (second != 0x97) & (second != 0xB7))
            ok &= _ALNUM[last] | ((before == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 0x80) & (right - left > 1))
        left = np.where(ok, left, self.starts)
        right = np.where(ok, right, self.ends)
        starts = np.stack([self.starts, left, right], axis=1)
        ends = np.stack([left, right, self.ends], axis=1)
        real = ends > starts
        count = np.concatenate([[0], np.cumsum(real.sum(axis=1))])
        self.starts, self.ends, self.bounds = starts[real], ends[real], count[self.bounds]

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + _U(1)) * _power(_BASE, n), out=total[1:])
        value = (total[self.ends] - total[self.starts]) * _power(_INVERSE, n)[self.starts]
        return mix(value + (self.ends - self.starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column, fold: bool = False, limit: int = 1 << 19) -> Iterator[tuple[int, int, Words]]:
    """Split a column into runs of rows of about ``limit`` bytes (one row at least) and their words."""
    data, offsets = string_buffers(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(rows, max(hi, lo + 1))
        at = offsets[lo : hi + 1]
        yield lo, hi, Words(data[at[0] : at[-1]], at - at[0], fold)
        lo = hi


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
