"""Cutting Arrow batches, so that a Python worker holds a bounded part of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of rows whose sizes are `most` at most together, or of one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), side="right")))
        yield a, b
        a = b
