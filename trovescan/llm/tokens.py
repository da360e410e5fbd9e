"""Ids of the public 49,408-entry word vocabulary, at the speed a corpus needs."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Ids are below this, so that two fit into one 32-bit key.
ID_LIMIT = 49_408

_WORD_END = "</w>"
#: Texts made of these characters only take the fast way: blanks, printable ASCII, Latin-1 letters.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
_BREAKS = re.compile(r"'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@\[-`{-~]+")


class WordEncoder:
    """Encodes whole texts as ``tokenizers`` does with ``add_special_tokens=False``.

    The library spends most of its time on normalising and splitting. Here a text of plain
    characters is split by two cheap substitutions, which put a zero byte behind every word, and its
    pieces are merged by the same ranks in ``tiktoken``: the zero byte stands for the word-end
    suffix. All other texts (other scripts, control characters, special token strings) go through
    ``tokenizers`` itself. Both ways give the same ids; tests/llm compares them.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
        rest = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {}
        for piece, rank in vocabulary.items():
            if piece.startswith("<|") and piece.endswith("|>"):
                continue
            ends = piece.endswith(_WORD_END)
            core = piece.removesuffix(_WORD_END)
            ranks[bytes(byte_of[c] for c in core) + b"\0" * ends] = rank
        self.merges = tiktoken.Encoding(
            "words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of one text as unsigned 32-bit numbers; none for null."""
        if not text:
            return np.empty(0, np.uint32)
        if _OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        marked = _BREAKS.sub("\0\\g<0>\0", text.lower())
        for blank in " \n\t\r":
            marked = marked.replace(blank, "\0")
        return self.merges.encode_to_numpy(marked + "\0", disallowed_special=())


@functools.cache
def word_encoder(path: str = VOCABULARY) -> WordEncoder:
    """One encoder per Python worker and vocabulary file."""
    return WordEncoder(path)
