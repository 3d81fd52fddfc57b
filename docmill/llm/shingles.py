"""Sets of hashed word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

from docmill.llm import common

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_C = U(0xD6E8FEB86659FD93)
_tables: list[np.ndarray] = []
common.MODELS["shingles"] = _tables.clear


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, n of each at least."""
    if not _tables or len(_tables[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        _tables[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(r), dtype=U)]), dtype=U) for r in (_R, _R_INV)]
    return _tables


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each; words are split at ASCII white space, A-Z lower-cased."""
    joined = [b" ".join(x.lower().split()) for x in raw]
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in joined], dtype=np.int64)
    buf = np.frombuffer(b" ".join(x for x in joined if x), np.uint8)
    if not len(buf):
        return np.empty(0, U), counts
    power, inverse = _powers(len(buf) + 1)
    space = np.flatnonzero(buf == 32)
    starts, ends = np.concatenate([[0], space + 1]), np.concatenate([space, [len(buf)]])
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * _C), counts


def shingle_sets(raw: list[bytes], n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; fewer words make one shingle, none an empty set."""
    h, counts = word_hashes(raw)
    out, at = [], 0
    if len(h) >= n:
        rolled = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            rolled = rolled * _C + h[j : len(h) - n + 1 + j]
        rolled = mix(rolled)
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(rolled[at : at + c - n + 1]))
        elif c:
            one = np.full(1, U(c), dtype=U)
            for x in h[at : at + c]:
                one = mix(one * _C + x)
            out.append(one)
        else:
            out.append(np.empty(0, U))
        at += c
    return out


def in_parts(raw: list[bytes], size: int = 1 << 20):
    """Index ranges of texts that together have about so many bytes."""
    start = held = 0
    for i, x in enumerate(raw):
        held += len(x)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(raw):
        yield start, len(raw)
