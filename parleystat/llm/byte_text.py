"""Words of many texts at once: numpy over the joined UTF-8 bytes.

Word hashes are polynomials over the bytes, mixed to 64 bits. Prefix sums give the hash of any span, so no Python
code runs per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: `[\\x20\\x09-\\x0D]`
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for `n` places."""
    inverse = pow(_BASE, -1, 1 << 64)

    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(inverse)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    power, inverse = _powers(1 << max(16, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashed = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashed + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and where each text starts, with the end last."""
    raw = [(t or "").encode("utf-8") for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
    data = b"\n".join(raw) + b"\n" if raw else b""
    if lower:
        data = data.translate(_LOWER)
    return np.frombuffer(data, np.uint8), bounds


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not white space. No word crosses from one text to the next."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[data], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def portions(texts: list, most: int = 1 << 18):
    """Ranges of texts that together hold about `most` characters, so work arrays stay small: they and the tables of
    powers, which a worker keeps, take some 80 bytes a character."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
