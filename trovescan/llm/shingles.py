"""Sets of word shingles as 64-bit numbers."""

from __future__ import annotations

import hashlib

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Words whose digests a task remembers; beyond that it starts anew.
_REMEMBERED = 200_000


class Digests(dict):
    """Digests of words. One object belongs to one task and goes when that ends."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = digest = hashlib.blake2b(word, digest_size=8).digest()
        return digest


def words(text: str | None) -> list[bytes]:
    """Words between blanks (space and 0x09 to 0x0D), with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int, digests: Digests | None = None) -> np.ndarray:
    """Sorted distinct 64-bit digests of the text's shingles; of all its words if it has fewer."""
    own = words(text)
    if not own:
        return np.empty(0, np.uint64)
    if len(own) < size:
        return np.frombuffer(hashlib.blake2b(b" ".join(own), digest_size=8, person=b"short").digest(), "<u8")
    h = np.frombuffer(b"".join(map((Digests() if digests is None else digests).__getitem__, own)), "<u8")
    n = len(h) - size + 1
    x = h[:n].copy()
    for i in range(1, size):
        x = x * _ODD + h[i : i + n]
        x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return np.unique(x)
