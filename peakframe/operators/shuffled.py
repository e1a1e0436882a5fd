"""Letters of sequences in the order of the MD5 digests of ``<digest of the sequence>:<place>``, by array operations.

Such a message is one block of MD5: eight words of the sequence's digest, and a few that depend on the place alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Messages that are worked on at once; letters whose keys are held at once, unless one sequence has more.
MESSAGES, LETTERS = 4096, 1 << 20
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDED = [np.uint32(int(abs(math.sin(k + 1)) * (1 << 32))) for k in range(64)]
_WORD = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *((7 * k) % 16 for k in range(16))]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_places = np.zeros((4, 0), np.uint32)


def place_words(n: int) -> np.ndarray:
    """Words 8, 9, 10 and 14 of the messages of the places up to n."""
    global _places
    if _places.shape[1] < n:
        size = 1 << (n - 1).bit_length()
        text = [f":{k}" for k in range(size)]
        tail = np.frombuffer(b"".join(t.encode() + b"\x80" + bytes(11 - len(t)) for t in text), "<u4").reshape(size, 3)
        _places = np.ascontiguousarray(np.column_stack([tail, np.array([8 * (32 + len(t)) for t in text], np.uint32)]).T.astype(np.uint32))
    return _places[:, :n]


def md5_heads(words: dict[int, np.ndarray]) -> np.ndarray:
    """The first eight bytes of the digests, as numbers that sort as they do; ``words`` of one block each, those not given being 0."""
    n = len(words[14])
    a, b, c, d = (np.full(n, x) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        r = k // 16
        if r == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif r == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif r == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, _ADDED[k], out=f)
        if _WORD[k] in words:
            np.add(f, words[_WORD[k]], out=f)
        s = _TURNS[r][k % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a  # what was a is written over next
    first, second = (a + _START[0]).byteswap().astype(np.uint64), (b + _START[1]).byteswap().astype(np.uint64)
    return (first << np.uint64(32)) | second


def shuffled(sequences: list[str | None]) -> list[str | None]:
    """Each sequence with its letters in that order."""
    out: list[str | None] = []
    held: list[str | None] = []
    letters = 0
    for s in sequences:
        if held and letters + len(s or "") > LETTERS:
            out += _shuffled(held)
            held, letters = [], 0
        held.append(s)
        letters += len(s or "")
    return out + _shuffled(held)


def _shuffled(sequences: list[str | None]) -> list[str | None]:
    known = [s for s in sequences if s]
    digests = [hashlib.md5(s.encode("utf-8")).hexdigest() for s in known]
    lengths = np.array([len(s) for s in known], np.int64)
    if not len(lengths):
        return list(sequences)
    fixed = np.frombuffer("".join(digests).encode(), "<u4").reshape(-1, 8).T.astype(np.uint32)
    start = np.r_[0, np.cumsum(lengths)]
    places = place_words(int(lengths.max()))
    keys = np.empty(int(start[-1]), np.uint64)
    for low in range(0, len(keys), MESSAGES):
        high = min(len(keys), low + MESSAGES)
        at = np.arange(low, high)
        s, e = int(np.searchsorted(start, low, "right")) - 1, int(np.searchsorted(start, high, "left"))
        of = np.repeat(np.arange(s, e), np.minimum(start[s + 1 : e + 1], high) - np.maximum(start[s:e], low))
        own, here = fixed[:, of], places[:, at - start[of]]
        keys[low:high] = md5_heads({**{k: own[k] for k in range(8)}, 8: here[0], 9: here[1], 10: here[2], 14: here[3]})
    out, k = [], 0
    for s in sequences:
        if not s:
            out.append(s)
            continue
        own = keys[start[k] : start[k + 1]]
        order = np.argsort(own)
        if len(own) > 1 and (np.diff(own[order]) == 0).any():  # heads alike: whole digests
            order = np.array(sorted(range(len(s)), key=lambda i, d=digests[k]: hashlib.md5(f"{d}:{i}".encode()).digest()))
        if s.isascii():
            out.append(np.frombuffer(s.encode(), np.uint8)[order].tobytes().decode())
        else:
            out.append(np.frombuffer(s.encode("utf-32-le"), np.uint32)[order].tobytes().decode("utf-32-le"))
        k += 1
    return out
