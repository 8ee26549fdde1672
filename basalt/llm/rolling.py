"""Polynomial hashes of all substrings of a byte array, modulo 2**64, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone
_MIX = np.uint64(0xD6E8FEB86659FD93)
_held: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n-1, and their inverses."""
    if len(_held.get("up", ())) < n:
        size = -(-n // 65536) * 65536
        _held["up"], _held["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _held["up"], _held["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits: a polynomial's low bits depend on its last bytes alone."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums that ``spans`` takes; data are bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of data[first:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return (sums[end] - sums[first]) * down[first]
