"""Exact BPE encoding and decoding that encodes what documents share only once.

A rolling hash of the last 16 bytes cuts each text into chunks by its content alone, so a passage
that many documents share has the same chunks in all of them. A chunk's ids are kept from its first
to its last place where a cut can't change the ids (``SAFE_CUT``); the rest, on either side of a
chunk join, is encoded anew: the window round the join grows, over several chunks if need be, until
it ends at such places, where the ids of both sides agree with those of the whole text.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import SAFE_CUT, Encoder, encoder
from .common import batch, map_arrow, texts

#: One place in so many is a cut, at random; a worker keeps at most so many bytes of chunks, in two generations.
MEAN_CHUNK, MAX_BYTES = 1024, 24_000_000
_FIELDS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_MULTIPLIER = 0x9E3779B1


def cuts(text: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Where the hash of the 16 bytes before it has its upper bits all set, except within a character."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= 16:
        return []
    with np.errstate(over="ignore"):
        h = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        for width in (1, 2, 4, 8):
            h = h[:-width] * np.uint32(pow(_MULTIPLIER, width, 1 << 32)) + h[width:]
    at = np.flatnonzero(h >= np.uint32((1 << 32) - (1 << 32) // mean)) + 16
    at = at[at < len(b)]
    return at[(b[at] & 0xC0) != 0x80].tolist()


class ChunkEncoder:
    def __init__(self, e: Encoder, mean: int = MEAN_CHUNK, max_bytes: int = MAX_BYTES):
        self.e, self.mean, self.max_bytes = e, mean, max_bytes
        self._young: dict[bytes, tuple] = {}
        self._old: dict[bytes, tuple] = {}
        self._held = 0
        self.encoded = self.reused = 0

    def _chunk(self, chunk: bytes) -> tuple | None:
        """(text before the first safe place, ids between the safe places, text after the last), or None without a safe place."""
        if (known := self._young.get(chunk, 0)) != 0:
            self.reused += len(chunk)
            return known
        if (known := self._old.get(chunk, 0)) == 0:
            text = chunk.decode()
            places = [m.start() for m in SAFE_CUT.finditer(text)]
            known = (text[: places[0]], self.e.encode(text[places[0] : places[-1]]), text[places[-1] :]) if places else None
            self.encoded += len(chunk)
        else:
            self.reused += len(chunk)
        self._held += len(chunk) + (len(known[1]) if known else 0) + 300
        if self._held > self.max_bytes // 2:
            self._old, self._young, self._held = self._young, {}, 0
        self._young[chunk] = known
        return known

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8")
        out, open_text, start = [], "", 0
        for stop in [*cuts(raw, self.mean), len(raw)]:
            if (part := self._chunk(raw[start:stop])) is None:
                open_text += raw[start:stop].decode()
            else:
                out += [self.e.encode(open_text + part[0]), part[1]]
                open_text = part[2]
            start = stop
        return b"".join([*out, self.e.encode(open_text)])


def encode_decode(documents: DataFrame, tokenizer: str, mean_chunk: int = MEAN_CHUNK) -> DataFrame:
    """Encode each text and decode its ids: number of ids and digests of both.

    Null text is empty (no ids). Each input row gives a row, repeated or not; a null doc_id stays null.
    An empty table gives no rows; further columns are ignored. Memory is bounded by ``MAX_BYTES`` of
    chunks and one batch of texts; nothing is shuffled.
    """

    def run(batches):
        e = encoder(tokenizer)
        chunks = ChunkEncoder(e, mean_chunk)
        for b in batches:
            counts, ids_hash, text_hash = [], [], []
            for text in b.column(1):
                ids = chunks.encode(text.as_py())
                numbers = array("I", ids)
                counts.append(len(numbers))
                ids_hash.append(hashlib.sha256(",".join(map(e.decimal.__getitem__, numbers)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(e.decode(ids).encode("utf-8")).hexdigest())
            yield batch(_FIELDS, [b.column(0), counts, ids_hash, text_hash])

    return map_arrow(texts(documents), run, SCHEMA)


def encode_ids(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The ids themselves: doc_id, ids array<int>."""
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]

    def run(batches):
        chunks = ChunkEncoder(encoder(tokenizer))
        for b in batches:
            yield batch(fields, [b.column(0), [array("I", chunks.encode(t.as_py())).tolist() for t in b.column(1)]])

    return map_arrow(texts(documents), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of doc_id, ids; null ids are an empty text."""
    fields = [("doc_id", pa.int64()), ("text", pa.string())]

    def run(batches):
        e = encoder(tokenizer)
        for b in batches:
            yield batch(fields, [b.column(0), [e.decode(array("I", ids or []).tobytes()) for ids in b.column(1).to_pylist()]])

    return map_arrow(encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids"), run, "doc_id long, text string")
