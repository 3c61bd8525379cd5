"""Components of pairs within one task, in numpy."""

from __future__ import annotations

import numpy as np


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b the smallest node reachable from each."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within consecutive groups of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)  # of each row in its group
    left = np.repeat(sizes, sizes) - place - 1  # partners after each row
    a = np.repeat(np.arange(len(place)), left)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
    return a, b
