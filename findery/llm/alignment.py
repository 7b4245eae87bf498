"""Edit distance of word sequences inside a band, bit-parallel on Python integers."""

from __future__ import annotations


def banded_distance(a: list[int], b: list[int], most: int) -> int | None:
    """Least insertions, deletions and replacements from ``a`` to ``b``, or None if over ``most``.

    Only cells within ``most`` diagonals of the main one are computed: each
    column of the band is one pair of integers of ``2 * most + 1`` bits.
    """
    if abs(len(a) - len(b)) > most:
        return None
    start = 0
    shorter = min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m if n + m <= most else None
    if most >= max(n, m):
        most = max(n, m)
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    get = where.get
    # bit r of a column's integers stands for row column - most + r
    up, down = (full << most) & full, 0
    # the score runs down the lowest diagonal to the last row, then along that row
    score = min(n, most)
    bottom = 1 << (width - 1)
    row_bit = 1 << (min(n, most) - 1 + most) if most else 0
    shift = -most
    for j, word in enumerate(b):
        found = get(word, 0)
        match = (found >> shift if shift >= 0 else found << -shift) & full
        diagonal = (((match & up) + up) ^ up) | match | down
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        if j < n - most:
            if not diagonal & bottom:
                score += 1
        else:
            if right & row_bit:
                score += 1
            if left & row_bit:
                score -= 1
            row_bit >>= 1
        half = (diagonal & full) >> 1
        up = (left | ~(half | right)) & full
        down = half & right
        shift += 1
    return score if score <= most else None
