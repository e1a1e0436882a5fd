"""Toxicity by maximum-scoring segments of token log-odds.

A token stands for itself and its beginnings of 3 to 8 characters, hashed into ``BUCKETS`` buckets, so that
inflected and unseen forms count as well. Each bucket's log-odds between toxic and other labelled documents, by token counts
(of n in a document 1 + ln n, so that repeats tell ever less), are drawn to a Dirichlet prior in proportion to the corpus, and by some standard errors towards 0; a
token has the most telling score of its forms, less a drift that makes ordinary text lose. One linear scan finds every maximal
passage (Ruzzo and Tompa). Under ordinary text the best score of a passage follows an extreme-value law, whose decay comes from
the score distribution and whose K from held-back documents. All significant passages of a document count together: the sum of
the r best, each less the law's location, has a tail of its own (Karlin and Altschul), and the r that surprises most is taken. A
logistic fit on the held-back documents turns that surprise, and the best score, into a probability.

The model is fitted on at most about ``SAMPLE`` labelled documents, exact copies once, which are written to the shared folder
when found; every document is scored in one pass that shuffles nothing. So documents are read twice.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, labelled_sample, map_arrow, texts

#: Labelled documents that the model is fitted on, about; buckets, weight of the prior in tokens, drift.
SAMPLE, BUCKETS, PRIOR, DRIFT = 20_000, 1 << 19, 2_000.0, 0.1
#: Standard errors that a log-odds must exceed 0 by: a form met in one document tells nothing.
SURE = 3.0
#: A passage counts as significant below this p-value. Distinct tokens whose scores a worker keeps. Lengths of the beginnings.
SIGNIFICANT, MAX_TOKENS, BEGINNINGS = 0.05, 300_000, range(3, 9)
_TOKEN = re.compile(r"\w+")


def forms(token: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the token and of its beginnings."""
    raw = [token + "|", *(token[:k] for k in BEGINNINGS if k < len(token))]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in raw]


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Score of each bucket: the difference of smoothed log-odds between the classes, drawn towards 0 by ``SURE`` standard errors."""
    n1, n0 = toxic.sum(), other.sum()
    if n1 == 0 or n0 == 0:
        return np.zeros(len(toxic), np.float32)
    alpha = prior * (toxic + other + 0.05) / (n1 + n0 + 0.05 * len(toxic))
    p1, p0 = (toxic + alpha) / (n1 + prior), (other + alpha) / (n0 + prior)
    d = np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))
    return (np.sign(d) * np.maximum(0, np.abs(d) - SURE * np.sqrt(1 / (toxic + alpha) + 1 / (other + alpha)))).astype(np.float32)


def decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of mean(exp(root * score)) = 1, the decay of the extreme-value law; 1 where there is none."""
    w = weights / max(weights.sum(), 1e-300)
    if not (w > 0).any() or (w * scores).sum() >= 0 or scores[w > 0].max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda r: float((w * np.exp(np.minimum(r * scores, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def best_sum(scores: np.ndarray) -> float:
    """Score of the best segment, 0 without a positive one."""
    if not len(scores):
        return 0.0
    c = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return float((c - np.minimum.accumulate(c)).max())


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time: each is the best within any stretch that holds no better one."""
    c = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    held: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one with a lower sum before
    for i in np.flatnonzero(np.asarray(scores) > 0).tolist():
        start, stop, before, after = i, i + 1, float(c[i]), float(c[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                held.append([start, stop, before, after, j])
                break
            start, before = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, y - x) for a, b, x, y, _ in held]


class Scorer:
    """Bucket scores, the drift, the extreme-value law's decay and log K, and the logistic fit (intercept, of surprise, of best score)."""

    def __init__(self, scores: np.ndarray, drift: float = DRIFT, rate: float = 1.0, log_k: float = 0.0, weights: tuple[float, float, float] = (-3.0, 0.0, 0.0)):
        self.scores, self.drift, self.rate, self.log_k, self.weights = scores, drift, rate, log_k, weights

    def token_score(self, token: str) -> float:
        return max((float(self.scores[f]) for f in forms(token, len(self.scores))), key=abs) - self.drift

    def token_scores(self, text: str, known: dict[str, float]) -> np.ndarray:
        if len(known) > MAX_TOKENS:
            known.clear()
        tokens = _TOKEN.findall(text.lower())
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            known.update((t, self.token_score(t)) for t in set(tokens).difference(known))
            return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))

    def surprise(self, best: float, n: int) -> float:
        """-ln of the expected number of passages with this score among n tokens of ordinary text; below -3 it tells no more."""
        return max(-3.0, self.rate * best - self.log_k - math.log(max(1, n)))

    def together(self, sums: list[float], n: int) -> float:
        """-ln of the chance that ordinary text has passages with scores like the r best of these, for the r that makes it largest.

        The sum x of r surprises has the tail exp(-x) x^(r-1) / (r! (r-1)!); trying several r costs ln 2 for each one more.
        """
        found, x = -3.0, 0.0
        for r, s in enumerate(sorted(sums, reverse=True), 1):
            more = self.surprise(s, n)
            if r > 1 and more <= 0:
                break
            x += more
            found = max(found, x if r == 1 else x - (r - 1) * (math.log(max(x, 1.0)) + math.log(2)) + math.lgamma(r + 1) + math.lgamma(r))
        return found

    def significant(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Every passage whose p-value, one less exp(-expected number), is small enough."""
        least = -math.log(-math.log1p(-SIGNIFICANT))
        if self.surprise(best_sum(scores), len(scores)) < least:
            return []
        return [p for p in passages(scores) if self.surprise(p[2], len(scores)) >= least]

    def features(self, scores: np.ndarray) -> tuple[float, float]:
        best = best_sum(scores)
        if best <= 0:
            return (-3.0, 0.0)
        alone = self.surprise(best, len(scores))  # without a surprise no other passage has one
        return (self.together([s for *_, s in passages(scores)], len(scores)) if alone > 0 else alone, best)

    def probability(self, scores: np.ndarray) -> float:
        x, y = self.features(scores)
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, self.weights[0] + self.weights[1] * x + self.weights[2] * y))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method with a small ridge; slopes below 0 are left out, as more evidence can't speak for less."""
    width = x.shape[1] if x.ndim == 2 else 0
    if not len(x) or y.all() or not y.any():
        return (-3.0 if not len(x) or not y.any() else 3.0, *[0.0] * width)
    used = list(range(width))
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, used]])
        w, penalty = np.zeros(1 + len(used)), ridge * np.diag([1e-6, *[1.0] * len(used)])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if not used or w[1:].min() >= 0:
            slopes = dict(zip(used, w[1:].tolist(), strict=True))
            return (float(w[0]), *(slopes.get(i, 0.0) for i in range(width)))
        used.pop(int(np.argmin(w[1:])))


def _fold(column) -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Scorer:
    """Log-odds from the labelled rows of folds 1 to 3, calibration on fold 4; fold 0 (crc32 of doc_id modulo 5) is never read for its labels.

    Of several labels of a doc_id the largest counts, of several texts of a labelled doc_id the least, of documents with
    one text the one with the least doc_id: what is learnt doesn't depend on the order of rows.
    """
    chosen = labelled_sample(labels, "toxic", sample, _fold("doc_id") != 0)
    rows = texts(documents).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = cut(rows.groupBy("text").agg(F.min(F.struct("doc_id", "y")).alias("first")).select("first.doc_id", "first.y", "text"))
    rows = rows.withColumn("fold", _fold("doc_id"))
    fields = [("bucket", pa.int64()), ("toxic", pa.float64()), ("other", pa.float64())]

    def count(batches):
        table = np.zeros((2, buckets))

        def settle(words):
            for y in (0, 1):
                for token, n in words[y].items():
                    for f in set(forms(token, buckets)):
                        table[y, f] += n
                words[y].clear()

        words = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words[int(y == 1)].update({t: 1 + math.log(n) for t, n in Counter(_TOKEN.findall(text.as_py().lower())).items()})
            if len(words[0]) > MAX_TOKENS:
                settle(words)
        settle(words)
        at = np.flatnonzero(table.any(axis=0))
        yield batch(fields, [at, table[1, at], table[0, at]])

    counted = map_arrow(rows.where("fold < 4").select("text", "y"), count, "bucket long, toxic double, other double")
    found = counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()  # at most one row a bucket
    table = np.zeros((2, buckets))
    table[0, found["bucket"].to_numpy()], table[1, found["bucket"].to_numpy()] = found["toxic"].to_numpy(), found["other"].to_numpy()
    scores = log_odds(table[0], table[1])
    scorer = Scorer(scores, DRIFT, decay(scores.astype(float) - DRIFT, table[1]))
    held = [("doc_id", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))]

    def measured(batches):
        known: dict[str, float] = {}
        for b in batches:
            s = [scorer.token_scores(t.as_py(), known) for t in b.column(2)]
            yield batch(held, [b.column(0), b.column(1), [len(x) for x in s], [sorted((v for *_, v in passages(x)), reverse=True) for x in s]])

    back = rows.where("fold = 4").select("doc_id", "y", "text")
    seen = sorted((d, y, n, sums) for d, y, n, sums in map_arrow(back, measured, "doc_id long, y int, n long, sums array<double>").collect())  # a fifth of the sample
    plain = [scorer.rate * sums[0] - math.log(n) for _, y, n, sums in seen if y != 1 and n > 0 and sums]
    scorer.log_k = float(np.mean(plain) - 0.5772156649) if plain else 0.0  # the mean of the law is log K plus Euler's constant
    x = [(scorer.together(sums, n), sums[0]) if sums else (-3.0, 0.0) for _, _, n, sums in seen]
    scorer.weights = logistic(np.array(x).reshape(-1, 2), np.array([y == 1 for _, y, _, _ in seen], float))
    return scorer


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """Probability and passages of each row.

    Null or empty text has no token and the score of no evidence. ``passages`` holds (start, stop, score) of the
    significant ones, in tokens. A null doc_id stays null and isn't held out; repeated rows are scored each;
    further columns are ignored; an empty table gives no rows.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
    fields = [("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", span)]

    def run(batches):
        known: dict[str, float] = {}
        for b in batches:
            scores = [scorer.token_scores(t.as_py(), known) for t in b.column(1)]
            p = [scorer.probability(x) for x in scores]
            yield batch(fields, [b.column(0), p, [int(x >= 0.5) for x in p], [[{"start": i, "stop": j, "score": s} for i, j, s in scorer.significant(x)] for x in scores]])

    return map_arrow(texts(documents), run, "doc_id long, score double, predicted int, passages array<struct<start:int,stop:int,score:double>>")


def keep(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows, all their columns, that aren't predicted toxic."""

    def run(batches):
        known: dict[str, float] = {}
        for b in batches:
            yield b.filter(pa.array([scorer.probability(scorer.token_scores(t or "", known)) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return map_arrow(documents, run, documents.schema)
