"""Hashed subword counts of whole texts, shared by the trained models."""

from __future__ import annotations

import numpy as np

from sextant.llm.common import lower_bytes

_PIECE = 1 << 20


def subword_counts(text: str | None, buckets: int, sizes: tuple[int, ...] = (2, 3, 4), seed: int = 0, lower: bool = True) -> np.ndarray:
    """How often each bucket is hit by the byte n-grams of the lower-cased text, white space as one space.

    Every n-gram of the whole text counts; long texts go in pieces that overlap by the longest size.
    """
    out = np.zeros(buckets, np.int64)
    raw = (text or "").encode("utf-8", "surrogatepass")
    raw = b" " + b" ".join((lower_bytes(raw) if lower else raw).split()) + b" "
    longest = max(sizes)
    for begin in range(0, len(raw), _PIECE):
        a = np.frombuffer(raw[begin : begin + _PIECE + longest - 1], np.uint8).astype(np.uint32)
        for n in sizes:
            starts = min(_PIECE, len(a) - n + 1)
            if starts <= 0:
                continue
            h = np.full(starts, (n * 0x9E3779B1 + seed * 0x85EBCA77) & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ a[k : k + starts]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - int(buckets).bit_length() + 1), minlength=buckets)
    return out
