"""Byte-level BPE: texts to ids and back, equal to the tokenizers library on the same vocabulary file."""

from __future__ import annotations

import functools
import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same where no two characters of white space are adjacent; without the look-ahead it is matched by a plain automaton.
SINGLE_SPACED = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
#: A text may be cut before a space that stands between two characters that aren't white space: no token spans such a place.
SAFE_CUT = re.compile(r" (?<=\S )(?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
_LONG_RUN = re.compile(r"\s{2000}")


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.library = Tokenizer.from_file(path)
        self._full = tiktoken.Encoding("full", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self._single = tiktoken.Encoding("single", pat_str=SINGLE_SPACED, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for t, i in ranks.items():
            self.token_bytes[i] = t
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.decimal = [str(i) for i in range(len(self.token_bytes))]
        self._cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _plain(self, text: str) -> list[int]:
        if not _TWO_SPACES.search(text):
            return self._single.encode_ordinary(text)
        if _LONG_RUN.search(text):  # on these the look-ahead pattern may run out of stack
            return self.library.encode(text, add_special_tokens=False).ids
        return self._full.encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        if any(t in text for t in self.special):
            return [i for x in self._cut_special.split(text) if x for i in ([self.special[x]] if x in self.special else self._plain(x))]
        return self._plain(text)

    def encode(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
