"""Indel similarities of strings, computed bit-parallel on integers.

``ratio`` is 100 * 2 * LCS / (total length). ``partial_ratio`` is the best ratio of the shorter
string against windows of the longer one, cut windows at both ends included. ``weighted_ratio``
combines them with token-sorted and token-set forms, as the public scorers of that name do.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter


def lcs(a: str, b: str, least: float = 0.0) -> int:
    """Length of the longest common subsequence, one integer operation a character of the shorter string.

    Exact where it reaches ``least``; else some length that doesn't.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    n, stop = len(a), math.ceil(least) - 1
    row = ones = (1 << n) - 1
    get = _places(a).get
    for at in range(0, len(b), 64):
        for c in b[at : at + 64]:
            hit = row & get(c, 0)
            row = row + hit | row ^ hit
        row &= ones
        most = n - row.bit_count() + max(len(b) - at - 64, 0)
        if most < stop:
            return most
    return n - row.bit_count()


@functools.lru_cache(32)
def _places(a: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    size = len(a) // 8 + 1
    places: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        if c not in places:
            places[c] = bytearray(size)
        places[c][i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(bits, "little") for c, bits in places.items()}


def _growing(a: str, b: str, least: int):
    """Sizes of beginnings of ``b`` above ``least`` with the length of their longest common subsequence with ``a``."""
    n = len(a)
    row = ones = (1 << n) - 1
    places = _places(a)
    for size, c in enumerate(b, 1):
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & ones
        if size > least:
            yield size, n - row.bit_count()


def ratio(a: str | None, b: str | None, floor: float = 0.0) -> float:
    """The exact value where it exceeds ``floor``; else some value that doesn't."""
    if a is None or b is None:
        return 0.0
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b, floor * total / 200.0) / total


def may_reach(a: str, b: str, score: float) -> bool:
    """Whether lengths and character counts leave room for that ratio."""
    total = len(a) + len(b)
    if not total:
        return True
    if 200.0 * min(len(a), len(b)) / total < score:
        return False
    return 200.0 * sum((Counter(a) & Counter(b)).values()) / total >= score


def partial_ratio(a: str | None, b: str | None, floor: float = 0.0) -> float:
    """The exact value where it exceeds ``floor``; else some value that doesn't."""
    if a is None or b is None:
        return 0.0
    if a == b or not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _windows(short, long, floor)
    return max(best, _windows(long, short, max(floor, best))) if len(a) == len(b) else best


def _windows(short: str, long: str, floor: float) -> float:
    """Best ratio of ``short`` against windows of its length in ``long`` and cut ones at both ends.

    No window shares more with ``short`` than the stretch that holds it: stretches that can't beat
    the best are passed over, others are halved, the most promising first. So are the ends of cut
    windows; where those may beat it, all their sizes take one pass from each end.
    """
    n, m, best = len(short), len(long), floor
    if best >= 100.0:
        return best
    common, head, tail = _stretches(short, long)
    least = best * n / (200.0 - best)  # a cut window of that size, or one that shares so much, can't beat the best
    for shared, a, b in ((head, short, long[: n - 1]), (tail, short[::-1], long[: m - n : -1])):
        if shared > least:
            for size, got in _growing(a, b, int(least)):
                best = max(best, 200.0 * got / (n + size))
    # an upper bound, the first and the last start of a stretch's windows
    heap = [(-100.0 * min(got, n) / n, lo, hi) for got, lo, hi in common]
    heapq.heapify(heap)
    while heap:
        bound, lo, hi = heapq.heappop(heap)
        if -bound <= best:
            break
        if lo == hi:
            best = -bound
            continue
        middle = (lo + hi) // 2
        for first, last in ((lo, middle), (middle + 1, hi)):
            bound = 100.0 * lcs(short, long[first : last + n], best * n / 100.0) / n
            if bound > best:
                heapq.heappush(heap, (-bound, first, last))
    return best


def _stretches(short: str, long: str) -> tuple[list[tuple[int, int, int]], int, int]:
    """Longest common subsequences of ``short`` with stretches of ``long``, all in one pass over ``short``.

    A stretch is three times as long as ``short`` and begins at each second multiple of its length:
    what it shares, its first and last window's start. Then what ``short`` shares with the ends of
    its length. Every other stretch lies in one copy of ``long``, the rest in another; the bits
    between two take up what additions carry over, one a step.
    """
    n, m = len(short), len(long)
    starts = [lo for lo in range(0, m - n + 1, 2 * n)]
    ends = [min(lo + 3 * n, m) for lo in starts]
    copies = [0, 0]
    for k, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
        copies[k % 2] |= ((1 << hi - lo) - 1) << lo
    even, odd = copies
    side, end = m + n, (1 << n) - 1
    head = side * min(len(starts), 2)
    tail = head + 2 * n
    lay = lambda x: x & even | (x & odd) << side | (x & end) << head | (x >> m - n) << tail
    places = _places(long)
    laid = {c: lay(places[c]) for c in set(short) if c in places}
    row = even | odd << side | end << head | end << tail
    get = laid.get
    for c in short:
        hit = row & get(c, 0)
        row = row + hit | row ^ hit
    shares = lambda at, size: size - (row >> at & (1 << size) - 1).bit_count()
    common = [(shares(lo + side * (k % 2), hi - lo), lo, min(lo + 2 * n - 1, m - n)) for k, (lo, hi) in enumerate(zip(starts, ends, strict=True))]
    return common, shares(head, n), shares(tail, n)


def weighted_ratio(a: str | None, b: str | None, floor: float = 0.0) -> float:
    """The exact value where it exceeds ``floor``; else some value that doesn't."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = max(floor, ratio(a, b, floor))
    if lengths < 1.5:
        return max(best, 0.95 * _token_ratio(a, b, ratio, best / 0.95))
    scale = 0.9 if lengths <= 8.0 else 0.6
    best = max(best, scale * partial_ratio(a, b, best / scale))
    return max(best, 0.95 * scale * _token_ratio(a, b, partial_ratio, best / scale / 0.95))


def _token_ratio(a: str, b: str, score, floor: float) -> float:
    left, right = sorted(a.split()), sorted(b.split())
    both = sorted(set(left) & set(right))
    best = score(" ".join(left), " ".join(right), floor)
    if both:
        if score is partial_ratio:
            return 100.0
        one, two = sorted(set(left) - set(both)), sorted(set(right) - set(both))
        base = " ".join(both)
        if not one or not two:
            return 100.0
        joined = [" ".join([base, *one]), " ".join([base, *two])]
        best = max(best, score(base, joined[0], floor), score(base, joined[1], floor), score(*joined, floor))
    return best


def is_duplicate(a: str | None, b: str | None, partial: float = 80, full: float = 80) -> bool:
    if a is None or b is None:
        return False
    if not a or not b:
        return a == b or min(partial, full) <= 0
    if a == b:
        return min(partial, full) <= 100
    short, total = min(len(a), len(b)), len(a) + len(b)
    if total > 3.4 * short and 200.0 * short < full * total:  # much longer: the whole shares too much to tell anything
        return partial_ratio(a, b, partial - 1e-6) >= partial
    common = lcs(a, b, min(full * total / 200.0, (partial - 1e-6) * short / (200.0 - partial + 1e-6)))
    if 200.0 * common / (len(a) + len(b)) >= full:
        return True
    # no window shares more than the whole does, and none is smaller than what it shares
    if 200.0 * common < (partial - 1e-6) * (short + common):
        return False
    return partial_ratio(a, b, partial - 1e-6) >= partial


def duplicate_scores(a: str | None, b: str | None) -> tuple[float, float | None] | None:
    """Both ratios of two strings that are duplicates, null for others; a partial ratio below 80 is null."""
    if not is_duplicate(a, b):
        return None
    partial = partial_ratio(a, b, 80 - 1e-6)
    return ratio(a, b), partial if partial >= 80 else None
