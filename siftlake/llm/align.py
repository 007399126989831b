"""Local alignment of a test item's words with a document's words.

A sparse Smith-Waterman: only cells where both words are equal are visited, a
path goes on diagonally, or past one change (word replaced, lost or added). Beside
the score the states needed for the exact rule are carried: how long the present
run of equal words is, and the earliest item word from which a path reaches here
with at least ``apart`` unchanged words between any two changes.
"""

from __future__ import annotations

MATCH, CHANGE = 2, -5


def align(item: list[int], places: dict[int, list[int]], doc: list[int], apart: int = 10) -> tuple[int, int, int, int]:
    """(longest unchanged run, longest span with changes ``apart`` words apart, best
    score, document word at which the best span ends). ``places`` maps a word of the
    item to its positions in the item; ``doc`` holds -1 for words foreign to all items."""
    longest = span = score = 0
    end = -1
    # state of a cell (i, j): run, first item word without a change yet, first item
    # word after at least one change (any run), the same where the run is >= apart, score
    rows: list[dict[int, tuple[int, int, int, int, int]]] = [{}, {}, {}]
    big = 1 << 30
    delayed: dict[int, list[int]] = {}
    for j, w in enumerate(doc):
        prev, prev2 = rows[-1], rows[-2]
        now: dict[int, tuple[int, int, int, int, int]] = {}
        for i in places.get(w, ()):
            d = prev.get(i - 1)
            if d is not None:
                run, plainly, changed, ready, s = d
                run, s = run + 1, s + MATCH
            else:
                run, plainly, changed, ready, s = 1, i, big, big, MATCH
            # changes that end just before this cell: replaced, lost, added
            born = big
            for c in (prev2.get(i - 2), prev.get(i - 2), prev2.get(i - 1)):
                if c is not None:
                    crun, cplain, _, cready, cs = c
                    start = min(cplain, cready)
                    if start < born:
                        born = start
                    if cs + CHANGE + MATCH > s:
                        s = cs + CHANGE + MATCH
            key = j - i
            line = delayed.get(key)
            if line is None or d is None:
                line = delayed[key] = []
            line.append(born)
            if born < changed:
                changed = born
            if len(line) >= apart:
                r = line[-apart]
                if r < ready:
                    ready = r
            now[i] = (run, plainly, changed, ready, s)
            if run > longest:
                longest = run
            reach = i + 1 - min(plainly, changed)
            if reach > span:
                span, end = reach, j
            if s > score:
                score = s
        rows = [rows[1], rows[2], now]
    return longest, span, score, end
