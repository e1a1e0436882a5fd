"""Pack documents into training sequences by best-fit decreasing.

A document's ids (those of its text, then the end id) are first cut into full windows, each of
which is a sequence; what remains is shorter than a window and is placed, longest first, in the
open window with the least room that still takes it. That needs to know no more of the corpus than how
many remainders there are of each length, so the driver plans on these counts (``size`` numbers at most),
and a remainder finds its place in the plan by its rank among those of its length. The sequences are those of one
best-fit decreasing run over all documents, however the input is split.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import batch, cut, map_arrow, texts

_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_CUT = [*_PIECE, ("part", pa.int64()), ("nth", pa.int64())]
_FIELDS = [*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids below are those of planned windows; a full window has its input split's number plus one above these bits.
SPLIT_BITS = 40


class OpenWindows:
    """Open windows by the room they have left, under a segment tree over the room: a node tells whether any window below it is open.

    Windows with the same room are held as ranges (first window, how many), first in, first out.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.at: list[deque] = [deque() for _ in range(size + 1)]

    def put(self, room: int, first: int, many: int, front: bool = False) -> None:
        (self.at[room].appendleft if front else self.at[room].append)((first, many))
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = True
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The least room of at least ``least``, or None."""
        node = self.leaves + least
        while not self.any[node]:
            while node & 1:  # a right child: what lies to the right is under an ancestor
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        windows = self.at[room].popleft()
        node = self.leaves + room
        if not self.at[room]:
            self.any[node] = False
            while (node := node >> 1) and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = False
        return windows


def plan(counts: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing of ``counts`` pieces by length, under ``size``.

    For each length its runs (rank, first window, pieces a window, offset): pieces from that rank on fill the windows from
    the first one on, so many in each, from that offset on. A piece goes into the tightest window that takes it; that window
    is then tighter still, so it takes pieces of the length until it has no room for one, and windows with equal room fare alike.
    """
    windows, out, fresh = OpenWindows(size), {}, 0
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank, runs = counts[n], 0, []
        while left:
            room = windows.tightest(n)
            if room is None:
                room, first, many, front = size, fresh, -(-left // (size // n)), False
                fresh += many
            else:
                (first, many), front = windows.take(room), True
            each = room // n
            whole = min(many, left // each)
            if whole:
                runs.append((rank, first, each, size - room))
                rank, left = rank + whole * each, left - whole * each
                if room - each * n:
                    windows.put(room - each * n, first, whole)
            first, many = first + whole, many - whole
            if many and left:  # fewer pieces than the next window takes
                runs.append((rank, first, left, size - room))
                windows.put(room - left * n, first, 1)
                first, many, left = first + 1, many - 1, 0
            if many:
                windows.put(room, first, many, front)
        out[n] = runs
    return out


def place(runs: list[tuple[int, int, int, int]], n: int, rank: int) -> tuple[int, int]:
    """(window, offset) of the piece with that rank among those of length ``n``."""
    start, first, each, offset = runs[bisect_right(runs, rank, key=lambda r: r[0]) - 1]
    return first + (rank - start) // each, offset + (rank - start) % each * n


def pack(documents: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document.

    Null text is empty: the document is its end id alone. Repeated rows are packed each on its own;
    a null doc_id stays null. An empty table gives no rows; further columns are ignored. Which of the documents
    with remainders of equal length gets which of their places depends on the order in which they are read; the
    windows, and so the padding, don't. The pieces (not the ids) are written once to the shared folder, and the
    remainders among them are shuffled once by split and length, to learn how many come before.
    """

    def cut_up(batches):
        e, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        part, full, seen = TaskContext.get().partitionId(), 0, [0] * size
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = memoryview(e.encode(text.as_py()) + end)
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    n = len(piece) // 4
                    if n == size:
                        nth, full = full, full + 1
                    else:
                        nth = seen[n]
                        seen[n] += 1
                    rows.append((d, start, n, zlib.crc32(piece), total, part, nth))
            if rows:
                yield batch(_CUT, list(zip(*rows, strict=True)))

    pieces = cut(map_arrow(texts(documents), cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", F.shiftleft(F.col("part") + 1, SPLIT_BITS) + F.col("nth"))
    rest = pieces.where(F.col("length") < size)
    counts = rest.groupBy("length").count().collect()  # fewer rows than a window has tokens
    runs = plan({r[0]: r[1] for r in counts}, size)
    # a row for each split and length that it has: the pieces of that length in the splits before
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = rest.groupBy("part", "length").agg(F.count("*").alias("c")).select("part", "length", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("earlier"))
    ranked = rest.join(at, ["part", "length"]).select(*[n for n, _ in _PIECE], (F.col("earlier") + F.col("nth")).alias("rank"))

    def settle(batches):
        start, first, each, offset = {}, {}, {}, {}
        for n, r in runs.items():
            start[n], first[n], each[n], offset[n] = np.array(r, np.int64).T
        for b in batches:
            n, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            sequence, places = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
                k = int(n[own[0]])
                run = np.searchsorted(start[k], rank[own], "right") - 1
                more = rank[own] - start[k][run]
                sequence[own], places[own] = first[k][run] + more // each[k][run], offset[k][run] + more % each[k][run] * k
            yield batch(_FIELDS, [*b.columns[:5], sequence, places])

    names = [n for n, _ in _FIELDS]
    return map_arrow(ranked, settle, SCHEMA).unionByName(full.select(*names[:6], F.lit(0).cast("long").alias("offset")))
