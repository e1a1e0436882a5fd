"""Count the tokens of each text under a unigram model, over a trie of its distinct words.

A word's best segmentation is the one with the highest sum of piece scores; the best score of each
prefix of the word depends on the prefix alone. A task keeps one trie of the distinct words that it meets:
a node holds the forward score of its prefix, computed once however many words begin so, and a terminal's
count is the word's. The pieces are a trie of their own with failure links, walked along with the words, so
that a node looks only at the pieces that really end there.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from .common import batch, map_arrow, texts

#: Words that a worker keeps with their counts, in two generations, and nodes of its trie, which is begun anew when full; results don't depend on either.
MAX_WORDS, MAX_NODES = 250_000, 250_000
#: Moves of the piece trie that a worker remembers beyond the trie's own edges; others are found anew by the failure links.
MAX_MOVES = 500_000
SPACE = "▁"
_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes_fallback", pa.int64())]
SCHEMA = "doc_id long, n_words long, n_tokens long, n_bytes_fallback long"


class Unigram:
    """Pieces with scores: the logarithm of a Zipf law over the vocabulary's order, which goes by falling frequency.

    A character that is no piece costs one byte piece for each of its UTF-8 bytes, each with the score of the rarest piece.
    """

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
        self.score = {p: -math.log(i + 1) - total for i, p in reversed(list(enumerate(pieces)))}
        self.longest = max(map(len, pieces), default=1)
        self.rare = -math.log(max(1, len(pieces))) - total - 1
        self._link()

    @classmethod
    def of_file(cls, path: str) -> Unigram:
        model = SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))])

    def _link(self) -> None:
        """The trie of the pieces: moves by character, failure links, and for each state the (length, score) of all pieces that end there, the longest first."""
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, float], ...]] = [()]
        for piece, s in self.score.items():
            node = 0
            for c in piece:
                if c not in self.moves[node]:
                    self.moves[node][c] = len(self.moves)
                    self.moves.append({})
                    self.ends.append(())
                node = self.moves[node][c]
            self.ends[node] = ((len(piece), s),)
        self.fail = [0] * len(self.moves)
        queue = list(self.moves[0].values())
        for node in queue:  # breadth first; grows while it is walked
            for c, child in self.moves[node].items():
                back = self.fail[node]
                while back and c not in self.moves[back]:
                    back = self.fail[back]
                self.fail[child] = self.moves[back].get(c, 0)
                queue.append(child)
            self.ends[node] += self.ends[self.fail[node]]
        self.spare = MAX_MOVES

    def _move(self, state: int, c: str) -> int:
        """The state of the longest suffix that begins a piece."""
        at = state
        while at and c not in self.moves[at]:
            at = self.fail[at]
        to = self.moves[at].get(c, 0)
        if to and self.spare:
            self.spare -= 1
            self.moves[state][c] = to
        return to

    def step(self, path: list[tuple[int, float, int, int]], c: str) -> tuple[int, float, int, int]:
        """(state, score, pieces, byte pieces) of a prefix that ends in ``c``, given those of its own prefixes from the empty one on; of equal scores that with fewer pieces, then the longer last piece."""
        state = path[-1][0]
        state = self.moves[state].get(c) or self._move(state, c)
        total, pieces, spelt = -math.inf, 0, 0
        for length, s in self.ends[state]:
            _, before, n, b = path[-length]
            s += before
            if s > total or s == total and n + 1 < pieces:
                total, pieces, spelt = s, n + 1, b
        if c not in self.score:
            _, before, n, b = path[-1]
            width = len(c.encode("utf-8", "surrogatepass"))
            s = before + width * self.rare
            if s > total or s == total and n + width < pieces:
                total, pieces, spelt = s, n + width, b + width
        return state, total, pieces, spelt


class Trie:
    """Words by their characters; each node keeps its prefix's state and forward score. Beyond ``most`` nodes prefixes are still walked, but no longer kept."""

    def __init__(self, model: Unigram, most: int = MAX_NODES):
        self.model, self.most = model, most
        self.children: list[dict[str, int] | None] = [{}]
        self.at: list[tuple[int, float, int, int]] = [(0, 0.0, 0, 0)]

    @property
    def full(self) -> bool:
        return len(self.at) >= self.most

    def count(self, word: str) -> tuple[int, int]:
        """Pieces and byte pieces of the word."""
        children, at, step, reach = self.children, self.at, self.model.step, self.model.longest
        node, path = 0, [at[0]]
        for c in word:
            if node >= 0:
                below = children[node]
                child = below.get(c) if below else None
                if child is not None:
                    node = child
                    path.append(at[node])
                    continue
            value = step(path, c)
            path.append(value)
            if node >= 0 and len(at) < self.most:
                if children[node] is None:
                    children[node] = {c: len(at)}
                else:
                    children[node][c] = len(at)
                node = len(at)
                children.append(None)
                at.append(value)
            else:
                node = -1
            if len(path) > 64 + 2 * reach:  # no piece reaches further back
                del path[:-reach]
        return path[-1][2:]


@functools.lru_cache(maxsize=2)
def _model(path: str) -> Unigram:
    return Unigram.of_file(path)


class Counts:
    def __init__(self, model: Unigram, keep: int = MAX_WORDS, nodes: int = MAX_NODES):
        self.model, self.keep = model, keep
        self.trie = Trie(model, nodes)
        self.young: dict[str, tuple[int, int]] = {}
        self.old: dict[str, tuple[int, int]] = {}

    def _count(self, word: str) -> tuple[int, int]:
        if self.trie.full:
            self.trie = Trie(self.model, self.trie.most)
        return self.trie.count(SPACE + word)

    def of(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Words, tokens and byte pieces of each text."""
        out = []
        for text in texts:
            words = Counter(text.split())
            known, old = self.young, self.old
            tokens = spelt = 0
            for w, k in words.items():
                found = known.get(w)
                if found is None:
                    found = known[w] = old.get(w) or self._count(w)
                tokens += k * found[0]
                spelt += k * found[1]
            out.append((words.total(), tokens, spelt))
            if len(known) > self.keep:
                self.old, self.young = known, {}
        return out


def count_tokens(documents: DataFrame, tokenizer: str, group: int = 1024) -> DataFrame:
    """Words (parted by white space), tokens and byte pieces of each text.

    Null or blank text has none. Each input row gives a row, repeated or not; a null doc_id stays null.
    An empty table gives no rows; further columns are ignored. Nothing is shuffled; a task holds its word
    trie (``MAX_NODES``), at most twice ``MAX_WORDS`` counted words and the words of one text.
    """

    def run(batches):
        counts = Counts(_model(tokenizer))
        for b in batches:
            for i in range(0, b.num_rows, group):
                rows = counts.of(b.column(1).slice(i, group).to_pylist())
                yield batch(_FIELDS, [b.column(0).slice(i, group), *([list(x) for x in zip(*rows, strict=True)])])

    return map_arrow(texts(documents), run, SCHEMA)
