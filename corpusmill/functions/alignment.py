"""Alignment of two line sequences by their longest common stretches.

The longest stretch that both sequences hold is taken first (of equal ones the first of ``before``, then of ``after``), then
the longest on either side of it, and so on. Lines come as 64-bit digests. All stretches of one length are taken in one
sweep from left to right: the next one of that length to the right of a stretch taken is what a search of the right side
alone would give. A length is found by bisection over hashes of windows, so the work is n log n for each length that occurs.
Ranges of a few lines go through the standard library, which takes the same stretches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Lines of a range that the standard library aligns: at most so many on either side.
FEW_LINES = 64
#: Line ends of any kind, as a text reader splits lines.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


class _Windows:
    """Hashes of the windows of a sequence, of any length, from running sums."""

    def __init__(self, lines: np.ndarray) -> None:
        mixed = (lines ^ (lines >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * _powers(BASE, len(lines)), dtype=np.uint64)))
        self.back = _powers(INVERSE, len(lines))

    def of(self, low: int, high: int, width: int) -> np.ndarray:
        """One hash for each window of ``width`` in the range, whatever its place: sums are shifted back to its start."""
        end = high - width + 1
        return (self.sums[low + width : end + width] - self.sums[low:end]) * self.back[low:end]


def _powers(base: np.uint64, count: int) -> np.ndarray:
    """The powers of the base from 0 on, modulo 2^64."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def matching_stretches(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, int]]:
    """``start in before, start in after, length`` of the stretches taken, in order; those that touch are joined."""
    one = two = None
    own, other = before.tolist(), after.tolist()
    taken, work = [], [(0, len(before), 0, len(after))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        if alo == ahi or blo == bhi:
            continue
        if max(ahi - alo, bhi - blo) <= FEW_LINES:
            taken += [(alo + i, blo + j, n) for i, j, n in SequenceMatcher(None, own[alo:ahi], other[blo:bhi], autojunk=False).get_matching_blocks()[:-1]]
            continue
        if one is None:
            one, two = _Windows(before), _Windows(after)
        low, high = 0, min(ahi - alo, bhi - blo)
        while low < high:  # the greatest width of a window that both hold
            width = (low + high + 1) // 2
            if len(np.intersect1d(one.of(alo, ahi, width), two.of(blo, bhi, width))):
                low = width
            else:
                high = width - 1
        if not low:
            continue
        places = defaultdict(list)
        for j, h in enumerate(two.of(blo, bhi, low).tolist(), blo):
            places[h].append(j)
        i, j = alo, blo  # ends of the last stretch taken
        hashes = one.of(alo, ahi, low).tolist()
        k = alo
        while k + low <= ahi:
            found = places.get(hashes[k - alo])
            at = bisect_left(found, j) if found else 0
            if found and at < len(found):
                taken.append((k, found[at], low))
                work.append((i, k, j, found[at]))
                i, j = k + low, found[at] + low
                k = i
            else:
                k += 1
        work.append((i, ahi, j, bhi))
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(taken):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def changes(before: np.ndarray, after: np.ndarray) -> int:
    """Stretches in which the sequences differ: gaps beside the stretches they share."""
    if np.array_equal(before, after):
        return 0
    count, i, j = 0, 0, 0
    for a, b, n in [*matching_stretches(before, after), (len(before), len(after), 0)]:
        count += a > i or b > j
        i, j = a + n, b + n
    return count


def line_digests(text: Column) -> Column:
    """One 64-bit digest per line, line ends included; computed where the text is."""
    lines = F.regexp_extract_all(text, F.lit(rf"(?s)(?:(?!{LINE_ENDS}).)++(?:{LINE_ENDS}|\z)|{LINE_ENDS}"), F.lit(0))
    return F.transform(lines, lambda x: F.xxhash64(x))
