"""Anchors: content-chosen places in sequences, so that equal windows of two texts have the same anchor.

The anchor of a window of W units is the least-hashed run of K units in it, the leftmost of equals.  Consecutive windows
mostly share one, about 2 of each W - K + 2 places are anchors, and two windows can be equal only if their anchors
are.  So a repeat search has to group anchors only, not windows.
"""

from __future__ import annotations

import numpy as np

from feedloom.llm.vector_text import prefix, window

PLACE_BITS = 28


def sliding_min(v: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each m neighbours, from running minima of blocks of m forwards and backwards."""
    n = len(v) - m + 1
    padded = np.full(-(-len(v) // m) * m, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[m - 1 : m - 1 + n])


class Anchors:
    """Anchors of the sequences values[starts[d]:ends[d]]: for each its place, the first window it serves and how many.

    ``hash`` is of the K units at the place; ``context`` of all units that the windows served cover.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, k: int):
        self.sums = sums = prefix(values)
        self.width, self.starts, self.ends = width, starts, ends
        empty = np.zeros(0, np.int64)
        self.place = self.first = self.windows = self.owner = empty
        self.hash = self.context = np.zeros(0, np.uint64)
        if len(values) < width:
            return
        at = np.arange(len(values) - k + 1)
        grams = window(sums, at, at + k)
        low, step = np.uint64((1 << PLACE_BITS) - 1), 1 << PLACE_BITS - 1
        least = []
        for a in range(0, len(values) - width + 1, step):  # a place within a piece has PLACE_BITS bits
            piece = grams[a : a + step + width - k]
            least.append((sliding_min(piece & ~low | np.arange(len(piece), dtype=np.uint64), width - k + 1) & low).astype(np.int64) + a)
        least = np.concatenate(least)
        room = np.maximum(ends - starts - width + 1, 0)  # windows of each sequence
        owner = np.repeat(np.arange(len(starts)), room)
        first = np.arange(room.sum()) - np.repeat(room.cumsum() - room, room) + starts[owner]
        if not len(first):
            return
        place = least[first]
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.place, self.first, self.owner = place[cut], first[cut], owner[cut]
        self.windows = np.diff(np.append(cut, len(first)))
        self.hash = grams[self.place]
        self.context = window(sums, self.first, self.first + self.windows + (width - 1))


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows: which start a new combination of keys."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new
