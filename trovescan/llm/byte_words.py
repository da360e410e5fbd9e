"""Words of UTF-8 texts, taken from their bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z, keeps digits, a-z and every byte beyond ASCII, and blanks the rest.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: A longer text is split into words in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
#: Words whose digests a task remembers; beyond that it starts anew.
_REMEMBERED = 200_000


def word_lists(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for each piece of it."""
    at = 0
    while text and at < len(text):
        end = at + piece
        while end < len(text) and TABLE[text[end]] != 32:
            end += 1
        yield text[at:end].translate(TABLE).split()
        at = end


class WordDigests(dict):
    """64-bit digests of words. One object belongs to one task and goes when that ends."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = digest = hashlib.blake2b(word, digest_size=8).digest()
        return digest

    def of(self, text: bytes | None) -> np.ndarray:
        """The digests of all words of a text, in order."""
        parts = [np.frombuffer(b"".join(map(self.__getitem__, own)), "<u8") for own in word_lists(text)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def runs(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows (from, to) of an Arrow column with about ``limit`` bytes together, at least one row each."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = text.as_buffer().size if text.is_valid else 0
        if i > begin and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)
