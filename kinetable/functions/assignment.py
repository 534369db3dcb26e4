"""Least-cost one-to-one assignment of a small square table."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least total cost (shortest augmenting paths with potentials)."""
    n = len(cost)
    rows, columns = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)  # the row that holds a column
    for start in range(n):
        reach, via, settled = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, at, length = start, -1, 0.0
        while True:
            step = length + cost[row] - rows[row] - columns
            better = ~settled & (step < reach)
            reach[better], via[better] = step[better], at
            column = int(np.where(settled, np.inf, reach).argmin())
            settled[column], length, at = True, reach[column], column
            if owner[column] < 0:
                break
            row = owner[column]
        held = settled & (owner >= 0)
        rows[owner[held]] += length - reach[held]
        rows[start] += length
        columns[settled] -= length - reach[settled]
        while at >= 0:  # hand the columns on along the path
            before = via[at]
            owner[at] = start if before < 0 else owner[before]
            at = before
    out = np.empty(n, int)
    out[owner] = np.arange(n)
    return out
