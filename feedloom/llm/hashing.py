"""Vectorised 64-bit hashes of spans of bytes (words, prefixes, shingles)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOLS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse modulo 2**64."""
    if "p" not in _cache or len(_cache["p"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _cache[name] = np.multiply.accumulate(steps)
    return _cache["p"], _cache["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (in place)."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, wherever it stands: a polynomial
    in the bytes from running sums, moved to the origin, mixed with the length."""
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOLS[data] * powers[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array, each followed by a newline, and where each
    one starts (with the total length at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]
