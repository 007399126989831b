"""Disjoint closed intervals of whole numbers, and dyadic blocks of them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

Interval = tuple[int, int]


class IntervalSet:
    """Numbers as disjoint intervals in rising order, none touching the next."""

    def __init__(self, intervals: Iterable[Interval] = ()):
        self._lows: list[int] = []
        self._highs: list[int] = []
        for lo, hi in intervals:
            self.add(lo, hi)

    def __iter__(self) -> Iterator[Interval]:
        return zip(self._lows, self._highs)

    def __len__(self) -> int:
        return len(self._lows)

    def add(self, lo: int, hi: int) -> None:
        """Merge ``[lo, hi]`` in; what it overlaps or touches becomes one with it."""
        if lo > hi:
            return
        a, b = bisect_left(self._highs, lo - 1), bisect_right(self._lows, hi + 1)
        if a < b:
            lo, hi = min(lo, self._lows[a]), max(hi, self._highs[b - 1])
        self._lows[a:b], self._highs[a:b] = [lo], [hi]

    def gaps(self, lo: int, hi: int) -> list[Interval]:
        """What of ``[lo, hi]`` isn't covered."""
        out, at = [], lo
        for k in range(bisect_left(self._highs, lo), len(self._lows)):
            if self._lows[k] > hi:
                break
            if self._lows[k] > at:
                out.append((at, self._lows[k] - 1))
            at = self._highs[k] + 1
        if at <= hi:
            out.append((at, hi))
        return out


def merge(intervals: Iterable[Interval]) -> list[Interval]:
    """Disjoint intervals in rising order; touching ones become one."""
    return list(IntervalSet(intervals))


def subtract(available: Iterable[Interval], processed: Iterable[Interval]) -> list[Interval]:
    """What of ``available`` no interval of ``processed`` covers."""
    done = IntervalSet(processed)
    return [gap for lo, hi in merge(available) for gap in done.gaps(lo, hi)]


def dyadic(lo: int, hi: int) -> list[tuple[int, int]]:
    """``[lo, hi]`` as the fewest aligned blocks (level, number): block ``number`` of level
    ``level`` holds the numbers n with ``n >> level == number``."""
    out = []
    while lo <= hi:
        level = (lo & -lo).bit_length() - 1 if lo else 62
        while level and lo + (1 << level) - 1 > hi:
            level -= 1
        out.append((level, lo >> level))
        lo += 1 << level
    return out
