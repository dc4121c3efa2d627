"""SimHash bits and BK-trees over them, for the search within two bits (`simhash`) and the wider one (`resemblance`)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Hashes that are counted at once, and pairs in flight.
PART, PAIRS = 1 << 15, 1 << 19


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The unsigned 64-bit SimHash of n hashes, which come in parts: a bit is set where over half of them have it."""
    ones = np.zeros(64, np.int64)
    for part in parts:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


class BKForest:
    """BK-trees of several groups at once: points[i] belongs to groups[i]; each group's first point is its root."""

    def __init__(self, points: np.ndarray, groups: np.ndarray) -> None:
        self.points = points
        n = len(points)
        kinds, first, inverse = np.unique(groups, return_index=True, return_inverse=True)
        self.root = first[inverse]
        at, left = self.root.copy(), np.setdiff1d(np.arange(n), first)
        keys, children = [], []
        while len(left):  # all points go down one level; the first to come along an edge becomes the child
            d = np.bitwise_count(points[left] ^ points[at[left]]).astype(np.int64)
            edge, firsts, back = np.unique(at[left] * 128 + d, return_index=True, return_inverse=True)
            child = left[firsts]
            keys.append(edge)
            children.append(child)
            at[left] = child[back]
            left = np.delete(left, firsts)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, point index) arrays of all hits; roots[i] is where query i starts."""
        stack = [(np.arange(i, min(i + PAIRS, len(queries))), roots[i : i + PAIRS]) for i in range(0, len(queries), PAIRS)]
        while stack:
            q, node = stack.pop()
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            stack += self.below(q, node, d, radius)

    def nearest(self, queries: np.ndarray, roots: np.ndarray, limit: np.ndarray, radius: int, enough: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Each query's nearest point within the radius (-1: none) of those below limit[i] that fit; distances up to `enough` count as equal, and of equals the first is taken.

        A child comes after its parent, so nothing below a point beyond the limit is looked at, nor below one after a point found within `enough`."""
        best, found, limit = np.full(len(queries), radius + 1), np.full(len(queries), len(self.points)), limit.copy()
        stack = [(np.arange(i, min(i + PAIRS, len(queries))), roots[i : i + PAIRS]) for i in range(0, len(queries), PAIRS)]
        while stack:
            q, node = stack.pop()
            go = node < limit[q]
            q, node = q[go], node[go]
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            far = np.maximum(d, enough)
            hit = (far < best[q]) | (far == best[q]) & (node < found[q]) & (far <= radius)
            hit[hit] = fits(q[hit], node[hit])
            at, x, y = q[hit], node[hit], far[hit]
            closer = y < best[at]
            found[at[closer]] = len(self.points)
            np.minimum.at(best, at, y)
            won = y == best[at]
            np.minimum.at(found, at[won], x[won])
            done = at[won & (y == enough)]
            limit[done] = np.minimum(limit[done], found[done])
            stack += self.below(q, node, d, np.minimum(best[q], radius))
        return np.where(found < len(self.points), found, -1)

    def below(self, q: np.ndarray, node: np.ndarray, d: np.ndarray, radius: int | np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """What to look at next from nodes at distance d: (query index, child) along the edges d - radius to d + radius, in parts of PAIRS."""
        if not len(self.keys):
            return []
        low = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
        count = np.searchsorted(self.keys, node * 128 + d + radius, side="right") - low
        total = int(count.sum())
        starts = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
        q, node = np.repeat(q, count), self.children[starts]
        return [(q[i : i + PAIRS], node[i : i + PAIRS]) for i in range(0, total, PAIRS)]
