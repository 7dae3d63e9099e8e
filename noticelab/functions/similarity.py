"""Similarity by the longest common subsequence (Indel distance)."""

from __future__ import annotations

from collections import Counter


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition (Hyyro 2004)."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = row & places.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str, enough: float = 0.0) -> float:
    """The best ratio of the shorter text to a stretch of its length in the longer
    one; 0 if it would be below `enough`.

    Two texts of Indel similarity r share most characters: of a stretch's n and
    the short one's m, at least r * (n + m) / 2.  The shared characters of all
    stretches are counted as the window moves, a step each, and only stretches
    that have enough are compared."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    m, best = len(short), 0.0
    wanted, held, shared = Counter(short), Counter(), 0
    for i in range(1 - m, len(long)):
        if i + m - 1 < len(long):
            c = long[i + m - 1]
            held[c] += 1
            shared += held[c] <= wanted[c]
        if i > 0:
            c = long[i - 1]
            shared -= held[c] <= wanted[c]
            held[c] -= 1
        size = min(i + m, len(long)) - max(i, 0)
        if 2 * shared >= max(best, enough) * (m + size):
            best = max(best, ratio(short, long[max(i, 0) : i + m]))
            if best == 1.0:
                break
    return best if best >= enough else 0.0
