"""Adaptive bins: neighbours merged until few are left."""

from __future__ import annotations

import heapq

import numpy as np


def adaptive_bins(values: list[float], counts: list[float], nbins: int, by_size: bool = True) -> tuple[list[float], list[float]]:
    """Merge neighbouring bins until nbins are left: the narrowest first, or those of the smallest count.

    A bin reaches to the next value; the last one to half the last gap beyond, or 1 for a single value. The smallest bin
    joins its smaller neighbour; ties go to the left. Returns lower edges and counts.
    """
    order = np.argsort(values)
    low, n = [float(values[i]) for i in order], [float(counts[i]) for i in order]
    end = low[-1] + ((low[-1] - low[-2]) / 2 if len(low) > 1 else 1.0)
    right = [*low[1:], end]
    before, after, alive = list(range(-1, len(low) - 1)), [*range(1, len(low)), -1], [True] * len(low)
    size = (lambda i: right[i] - low[i]) if by_size else (lambda i: n[i])
    heap, left = [(size(i), low[i], i) for i in range(len(low))], len(low)
    heapq.heapify(heap)
    while left > max(1, nbins):
        s, _, i = heapq.heappop(heap)
        if not alive[i] or s != size(i):
            continue
        sides = [j for j in (before[i], after[i]) if j >= 0]
        j = min(sides, key=lambda j: (size(j), low[j]))
        a, b = min(i, j, key=lambda k: low[k]), max(i, j, key=lambda k: low[k])
        right[a], n[a], alive[b], after[a] = right[b], n[a] + n[b], False, after[b]
        if after[b] >= 0:
            before[after[b]] = a
        heapq.heappush(heap, (size(a), low[a], a))
        left -= 1
    keep = [i for i in range(len(low)) if alive[i]]
    return [low[i] for i in keep], [n[i] for i in keep]
