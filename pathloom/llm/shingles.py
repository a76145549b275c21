"""Hashes of words and of their n-grams, for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

from .mixing import mixed64

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, U), np.ones(1, U)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below ``n``."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z as a-z) of the texts in order, and each text's number of words."""
    buf = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    if not len(buf):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=sums[1:])
    h = mixed64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)


def sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``n``-word shingles; of fewer words, the whole sequence as one."""
    h, counts = word_hashes(texts)
    salted = [mixed64(h + U((j + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))) for j in range(n)]
    grams = salted[0][: max(0, len(h) - n + 1)].copy()
    for j in range(1, n):
        grams += salted[j][j : j + len(grams)]
    grams = mixed64(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            whole = sum((int(salted[j][at + j]) for j in range(c)), c * 0x2545F4914F6CDD1D) & (2**64 - 1)
            out.append(mixed64(np.array([whole], U)))
        else:
            out.append(np.zeros(0, U))
        at += c
    return out
