"""Connected components for the operators that link rows: in Spark, and of the rows of one task."""

from __future__ import annotations

import numpy as np

from loomline.operators.components import connected_components

__all__ = ["connected_components", "forest"]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over the links ``(a, b)`` for each of ``n`` rows of one task."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(fresh, at, low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            break
        root = fresh
    return root
