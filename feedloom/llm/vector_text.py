"""Words and windows of texts as numpy arrays over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A fixed random value for each byte.
VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and INVERSE ** k modulo 2 ** 64 for k below n or more; kept for the task's process."""
    size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (BASE, INVERSE))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a line feed, and the place where each text starts (and the end)."""
    raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), np.append(0, size.cumsum())


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that end in a space."""
    word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).view(np.int8)))
    return edge[::2], edge[1::2]


def prefix(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, one longer than the values, for ``window``."""
    return np.append(np.uint64(0), (values * powers(len(values))[0][: len(values)]).cumsum(dtype=np.uint64))


def window(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the value sequences from starts to ends, equal for equal sequences wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return window(prefix(VALUES[data]), starts, ends)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal just for equal words, whose bytes are compared."""
    if not len(starts):
        return np.zeros(0, np.int64)
    kept = np.ascontiguousarray(data[~SPACE[data]])
    at = np.append(0, (ends - starts).cumsum()).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return np.asarray(words.dictionary_encode().indices).astype(np.int64)


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers below 2 ** 31, equal just for equal pairs."""
    return np.unique(left << 32 | right, return_inverse=True)[1].astype(np.int64)


def gram_names(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` ids, by its first place, equal just for equal runs."""
    names, size, out, done = ids, 1, None, 0
    while True:
        if width & size:
            n = len(ids) - done - size + 1
            if n <= 0:
                return np.zeros(0, np.int64)
            out = names[:n] if out is None else pair_names(out[:n], names[done : done + n])
            done += size
        if done == width:
            return out
        if len(names) <= size:
            return np.zeros(0, np.int64)
        names, size = pair_names(names[:-size], names[size:]), 2 * size
