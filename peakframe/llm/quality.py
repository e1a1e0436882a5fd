"""Quality rules: counts that rules look at, and an isolation forest over rule statistics.

Random splits isolate unusual documents after few steps; the mean path length gives the anomaly score. The forest
is grown on rows labelled good, so that it knows what is usual among them, and the threshold comes from labelled rows
that it hasn't seen. A hash of doc_id halves the labelled documents, and all of them count: the medians are those of all rows of the one half,
each tree draws its rows from all of these (as few as the method asks for), and the threshold is chosen over the scores of the whole other half. Every document is scored, in one pass that shuffles nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow, texts
from .jaccard_join import mix

TREES, TREE_ROWS, WINDOW = 100, 256, 8
#: Of the rows labelled good, at most this share may fail by the threshold.
GOOD_LOST = 0.005
#: Decimal places of a score, so that scores of any number of rows are counted in a table of bounded size.
PLACES = 6
#: Statistics that rules look at: symbols a word and share of repeated lines (their roots, as both are mostly 0), shares of capitals and of letters,
#: the commonest mark a word, characters a word. The base rule judges number of words and repeated words already.
STATISTICS = ["symbols", "repeated_lines", "upper", "letters", "top_mark", "word_length"]
#: Words at the median that each text is credited with, so that chance in short texts doesn't look unusual.
CREDIT = 60
_COUNTS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_MARKS = np.frombuffer(b"!?.,;:'\"()[]{}-_=+/\\@^~`", np.uint8)

_ODD = np.r_[_SYMBOLS, _MARKS]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        w = h * np.uint64(0x9E3779B97F4A7C15)
        have = 1
        while 2 * have <= width:
            w = w[:-have] * np.uint64(pow(0xD6E8FEB86659FD93, have, 1 << 64)) + w[have:]
            have *= 2
        if have < width:
            w = w[: n] * np.uint64(0xA0761D6478BD642F) + w[width - have : width - have + n]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    first = None
    for k in np.flatnonzero(same).tolist():  # pairs of equal hashes, checked word by word
        if k == 0 or not same[k - 1]:
            first = order[k]
        other = order[k + 1]
        if words[first : first + width] != words[other : other + width]:
            return _repeated_exactly(words, width)
        twice[first] = twice[other] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _repeated_exactly(words: list[bytes], width: int) -> int:
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def measure(text: str) -> tuple[list[int], list[float]]:
    """The five base counts and the rule statistics of a text."""
    raw = text.encode("utf-8")
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    chars = len(text) - int(by_byte[_SPACE].sum())
    symbols = int(by_byte[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper, lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    beyond = len(text) - int(by_byte[:128].sum())
    per = max(1, n)
    stats = [math.sqrt(symbols / per), math.sqrt(dup / max(1, len(lines))), upper / max(1, upper + lower), (upper + lower + beyond) / max(1, chars), int(by_byte[_ODD].max()) / per, chars / per, n, repeats]
    return [n, chars, symbols, dup, repeats], stats


def base_fails(words, repeats):
    """Under 20 words, or over 30 of a hundred in repeated windows."""
    return (words < 20) | (100 * repeats > 30 * words)


def steadied(stats: np.ndarray, median: np.ndarray) -> np.ndarray:
    """Statistics drawn to the median, the more the fewer words they rest on; the two last columns are the words and the repeated ones."""
    weight = stats[:, -2:-1]
    return (weight * stats[:, :-2] + CREDIT * median) / (weight + CREDIT)


def average_path(n: float) -> float:
    """Mean depth of a failed search among n rows, by which path lengths are scaled."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as arrays; a node holds (statistic, split, left, right), a leaf its depth and the path still to go.

    ``median`` and ``draws``, the rows that each tree is grown on, may be given where the rows themselves are too many to hold.
    """

    def __init__(self, stats: np.ndarray | None, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7, median: np.ndarray | None = None, draws: list[np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        if draws is None:
            median = np.median(stats[:, :-2], axis=0)
            draws = [stats[rng.choice(len(stats), min(tree_rows, len(stats)), replace=False)] for _ in range(trees)]
        self.median = median
        self.size = len(draws[0])
        self.deepest = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._grow(steadied(rows, median), rng) for rows in draws]

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        statistic, split, left, length = [], [], [], []
        queue = [(rows, 0)]
        for part, depth in queue:  # breadth first; grows while it is walked
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= self.deepest or len(part) <= 1 or not len(usable):
                statistic.append(-1), split.append(0.0), left.append(0), length.append(depth + average_path(len(part)))
                continue
            f = int(rng.choice(usable))
            at = max(rng.uniform(low[f], high[f]), np.nextafter(low[f], high[f]))  # so that neither side is empty, however close the ends are
            below = part[:, f] < at
            statistic.append(f), split.append(at), left.append(len(queue)), length.append(0.0)
            queue += [(part[below], depth + 1), (part[~below], depth + 1)]
        return np.array(statistic), np.array(split), np.array(left), np.array(length)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that are isolated early."""
        if not len(stats):
            return np.zeros(0)
        rows = steadied(stats, self.median)
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for statistic, split, left, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.deepest):
                f = statistic[node]
                inner = f >= 0
                node = np.where(inner, left[node] + (rows[each, np.maximum(f, 0)] >= split[node]), node)
            total += length[node]
        return np.round(np.exp2(-total / len(self.trees) / max(average_path(self.size), 1e-9)), PLACES)


def choose_threshold(scores: np.ndarray, good: np.ndarray, good_lost: float = GOOD_LOST, counts: np.ndarray | None = None) -> float:
    """The score above which most bad rows lie, with no more than a share of the good ones; above all scores if there are no bad rows. ``counts``: rows that each score stands for."""
    if not len(scores) or good.all():
        return float("inf")
    if not good.any():
        return float("-inf") if len(scores) else float("inf")
    candidates = np.unique(np.r_[scores, np.inf])
    counts = np.ones(len(scores), np.int64) if counts is None else counts

    def beyond(some):
        """Share of the rows at each candidate or above."""
        order = np.argsort(scores[some], kind="stable")
        below = np.r_[0, np.cumsum(counts[some][order])]
        return 1 - below[np.searchsorted(scores[some][order], candidates, "left")] / below[-1]

    g = np.sort(scores[good])
    lost, caught = beyond(good), beyond(~good)
    allowed = lost <= good_lost
    gain = np.where(allowed, caught - lost, -1)
    best = int(np.argmax(gain))
    if not np.isfinite(candidates[best]):
        return float("inf")
    below = g[g < candidates[best]]  # half way to the next good row
    return float((candidates[best] + below[-1]) / 2) if len(below) else float(candidates[best])


def medians(measured: DataFrame, rows: int) -> np.ndarray:
    """Exact medians of the statistics of ``rows`` rows, none of them below 0: their bits are settled 16 at a time, by counts of a bounded number of kinds."""
    last = len(STATISTICS)
    ranks = [(rows - 1) // 2, rows // 2]
    prefix, left = np.zeros((last, 2), np.uint64), np.tile(np.array(ranks, np.int64), (last, 1))
    fields = [("k", pa.int32()), ("side", pa.int32()), ("digit", pa.int64()), ("c", pa.int64())]
    for shift in (48, 32, 16, 0):

        def run(batches, shift=shift, prefix=prefix.copy()):
            out: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                x = np.array(b.column(0).to_pylist(), np.float64).reshape(-1, last + 2)[:, :last] + 0.0
                bits = np.ascontiguousarray(x.T).view(np.uint64)
                for k in range(last):
                    for side in range(2):
                        alike = bits[k] if shift == 48 else bits[k][bits[k] >> np.uint64(shift + 16) == prefix[k, side]]
                        digits = (alike >> np.uint64(shift)) & np.uint64(0xFFFF)
                        out[k, side] = out.get((k, side), 0) + np.bincount(digits.astype(np.int64), minlength=1 << 16)
            for (k, side), c in out.items():
                at = np.flatnonzero(c)
                if len(at):
                    yield batch(fields, [pa.array([k] * len(at), pa.int32()), pa.array([side] * len(at), pa.int32()), at, c[at]])

        kinds = map_arrow(measured.select("s"), run, "k int, side int, digit long, c long").groupBy("k", "side", "digit").agg(F.sum("c").alias("c")).collect()
        for k in range(last):
            for side in range(2):
                for digit, c in sorted((r.digit, r.c) for r in kinds if (r.k, r.side) == (k, side)):
                    if left[k, side] < c:
                        prefix[k, side] = (prefix[k, side] << np.uint64(16)) | np.uint64(digit)
                        break
                    left[k, side] -= c
    return prefix.view(np.float64).mean(axis=1)


def drawn_rows(measured: DataFrame, rows: int, trees: int = TREES, tree_rows: int = TREE_ROWS) -> list[np.ndarray]:
    """For each tree its rows: those of all that a hash of doc_id and the tree puts first."""
    share = min(1.0, 2 * tree_rows / max(1, rows))
    most = np.uint64(min(int(share * (1 << 64)), (1 << 64) - 1))
    fields = [("tree", pa.int32()), ("h", pa.int64()), ("s", pa.list_(pa.float64()))]
    seeds = mix(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches):
        for b in batches:
            ids = mix(np.array(b.column(0).to_pylist(), np.int64).view(np.uint64))
            stats = b.column(1).to_pylist()
            h = mix(ids[:, None] ^ seeds[None, :])
            at, tree = np.nonzero(h <= most)
            if len(at):
                yield batch(fields, [tree, (h[at, tree] ^ np.uint64(1 << 63)).view(np.int64), [stats[k] for k in at.tolist()]])

    found: dict[int, list] = {}
    for r in map_arrow(measured.select("doc_id", "s"), run, "tree int, h long, s array<double>").collect():
        found.setdefault(r.tree, []).append((r.h, r.s))
    least = min(tree_rows, rows)
    if len(found) < trees or min(map(len, found.values())) < least:
        raise RuntimeError("a tree's share of the rows is short of the number that it draws")
    return [np.array([s for _, s in sorted(found[t])[:least]]) for t in range(trees)]


def fit(documents: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from all labelled documents (label ``quality``, 1 is good); None without a good one.

    Of several labels of a doc_id the largest counts, of several texts of one the least by its statistics.
    """
    fields = [("doc_id", pa.int64()), ("s", pa.list_(pa.float64()))]

    def run(batches):
        for b in batches:
            yield batch(fields, [b.column(0), [measure(t.as_py())[1] for t in b.column(1)]])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    measured = map_arrow(texts(documents).where("doc_id is not null"), run, "doc_id long, s array<double>").groupBy("doc_id").agg(F.min("s").alias("s"))  # counts are shuffled, not texts
    words, repeats = F.element_at("s", -2), F.element_at("s", -1)
    seen = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    rows = cut(measured.join(known, "doc_id").where(~base_fails(words, repeats)).select("doc_id", "s", (F.col("y") == 1).alias("good"), seen.alias("seen")))
    grown_on = rows.where("good and seen")
    n = grown_on.count()
    if not n:
        return None
    forest = IsolationForest(None, median=medians(grown_on, n), draws=drawn_rows(grown_on, n))
    scored_fields = [("good", pa.bool_()), ("score", pa.float64())]

    def score(batches):
        for b in batches:
            if b.num_rows:
                yield batch(scored_fields, [b.column(1), forest.score(np.array(b.column(0).to_pylist()))])

    table = map_arrow(rows.where("not seen").select("s", "good"), score, "good boolean, score double").groupBy("score", "good").agg(F.count("*").alias("c")).collect()
    table = sorted((r.score, r.good, r.c) for r in table)
    return forest, choose_threshold(np.array([r[0] for r in table]), np.array([r[1] for r in table], bool), counts=np.array([r[2] for r in table], np.int64))


def assess(documents: DataFrame, model: tuple[IsolationForest, float] | None) -> DataFrame:
    """Counts, base rule and verdict of each row.

    A row is kept if neither the base rule (under 20 words, or over 30 of a hundred words in repeated
    windows) nor the forest speaks against it; without a model the base rule alone decides. Null text has no
    words. A null doc_id stays null, repeated rows are measured each, further columns are ignored, an empty
    table gives no rows.
    """
    fields = [("doc_id", pa.int64()), *_COUNTS, ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("anomaly", pa.float64())]

    def run(batches):
        for b in batches:
            measured = [measure(t.as_py()) for t in b.column(1)]
            if not measured:
                continue
            counts = np.array([m[0] for m in measured])
            failed = base_fails(counts[:, 0], counts[:, 4])
            score = model[0].score(np.array([m[1] for m in measured])) if model else np.zeros(len(counts))
            kept = ~failed & (score < model[1]) if model else ~failed
            yield batch(fields, [b.column(0), *counts.T, failed, kept, score])

    return map_arrow(texts(documents), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double")


def keep(documents: DataFrame, model: tuple[IsolationForest, float] | None) -> DataFrame:
    """The rows, all their columns, that ``assess`` keeps."""

    def run(batches):
        for b in batches:
            measured = [measure(t or "") for t in b.column("text").to_pylist()]
            if not measured:
                continue
            counts = np.array([m[0] for m in measured])
            kept = ~base_fails(counts[:, 0], counts[:, 4])
            if model:
                kept &= model[0].score(np.array([m[1] for m in measured])) < model[1]
            yield b.filter(pa.array(kept))

    return map_arrow(documents, run, documents.schema)
