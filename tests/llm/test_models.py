import itertools
import random
import zlib

import numpy as np

from peakframe.llm import quality as Q
from peakframe.llm import toxicity as T

from .cases import awkward, empty, labels


def corpus(spark, n=600, seed=2):
    """Documents of invented words; a fifth hold insults, another fifth are junk."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        toxic, bad = int(i % 5 == 1), int(i % 5 == 3)
        if toxic:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["zzscum", "zztrash", "zzidiot"]) + rng.choice(["", "s", "y"])
        if bad:
            words = [w.upper() + rng.choice(["!!", "$$$", "###"]) for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, 1 - bad, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)


def test_passages_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.choice([-2, -1, -0.5, 1, 2, 3]) for _ in range(rng.randint(0, 12))]
        segments = {(a, b): sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2)}
        assert abs(T.best_sum(np.array(s, float)) - max([0, *segments.values()])) < 1e-9
        got = T.passages(np.array(s, float))
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(got)) and all(v > 0 for _, _, v in got)
        assert [(a, b) for a, b, _ in got] == maximal(s, 0, len(s)) and all(abs(v - segments[a, b]) < 1e-9 for a, b, v in got)


def maximal(s, start, stop):
    """By the definition: the best segment, the shortest and first of equal ones, then the same on either side of it."""
    found = [(sum(s[a:b]), a - b, -a, b) for a in range(start, stop) for b in range(a + 1, stop + 1)]
    if not found or max(found)[0] <= 0:
        return []
    _, width, a, b = max(found)
    return [*maximal(s, start, -a), (-a, b), *maximal(s, b, stop)]


def test_passages_count_together():
    model = T.Scorer(np.zeros(8), rate=1.0)
    alone, three = model.together([9.0], 100), model.together([9.0, 9.0, 9.0], 100)
    assert abs(alone - (9 - np.log(100))) < 1e-12 and three > 2 * alone > model.together([9.0, 1.0], 100) > 0
    assert model.together([], 100) == model.together([0.5], 10_000) == -3.0 and model.together([9.0] * 2000, 5000) > 100


def test_extreme_value_decay():
    scores, weights = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    r = T.decay(scores, weights)
    assert abs(0.75 * np.exp(-r) + 0.25 * np.exp(r) - 1) < 1e-6 and r > 0


def test_toxicity_on_held_out_rows(spark):
    docs, marks = corpus(spark)
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    hidden = labels(spark, [(r.doc_id, r.quality, r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 else 1 - r.toxic) for r in marks.collect()])  # wrong labels in the held-out fold
    scored = T.score(docs, T.fit(docs, hidden)).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)


def test_toxicity_awkward(spark):
    docs, marks = corpus(spark, 200)
    model = T.fit(docs, marks)
    rows = T.score(awkward(spark), model).collect()
    assert len(rows) == awkward(spark).count() and not any(r.predicted for r in rows if r.doc_id in (4, 5, 6, 13))
    assert T.keep(awkward(spark), model).columns == awkward(spark).columns
    assert T.score(empty(spark), model).count() == 0
    for m in (labels(spark), labels(spark, [(1, 1, 0)]), labels(spark, [(None, None, None)])):
        assert all(not r.predicted for r in T.score(docs.limit(5), T.fit(docs, m)).collect())


def brute_measure(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", " ", "\n", "\t", "é", "#", "\x1c", " ", "漢"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    texts += ["a b c d e f g h " * 5, "x " * 40, "one two\n" * 9]
    for t in texts:
        assert Q.measure(t)[0] == brute_measure(t)
    docs = awkward(spark, texts)
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.assess(docs, None).collect())
    want = []
    for r in docs.collect():
        c = brute_measure(r.text or "")
        want.append((r.doc_id or -1, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == sorted(want)


def test_hash_ties_are_checked_word_by_word(monkeypatch):
    words = [bytes([97 + i % 3]) for i in range(40)] + [b"q%d" % i for i in range(30)]
    want = Q._repeated_exactly(words, 8)
    assert Q.repeated_words(words) == want > 0
    monkeypatch.setattr(Q, "hash", lambda w: 1, raising=False)  # every window looks alike
    assert Q.repeated_words(words) == want


def test_quality_verdict(spark):
    docs, marks = corpus(spark)
    model = Q.fit(docs, marks)
    truth = {r.doc_id: r.quality for r in marks.collect()}
    rows = Q.assess(docs, model).collect()
    assert all(r.kept is False for r in rows if r.base_failed)
    good, bad = [r for r in rows if truth[r.doc_id] == 1], [r for r in rows if truth[r.doc_id] == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)
    assert {r.doc_id for r in Q.keep(docs, model).collect()} == {r.doc_id for r in rows if r.kept}
    assert Q.fit(docs, labels(spark)) is None and Q.assess(empty(spark), model).count() == 0 and Q.keep(empty(spark), model).count() == 0
    assert Q.keep(awkward(spark), model).columns == awkward(spark).columns


def test_isolation_scores():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(500, 4)), np.full((500, 2), 500.0)])
    x[0, :4] = 12
    s = Q.IsolationForest(x).score(x)
    assert s.argmax() == 0 and s[0] > 0.6 and Q.average_path(256) > 9
    good = np.arange(500) != 0
    assert s[0] >= Q.choose_threshold(s, good) > np.sort(s)[-2]
    assert Q.choose_threshold(s, np.ones(500, bool)) == np.inf


def test_isolation_of_nearly_equal_rows():
    x = np.full((300, 6), 0.1)
    x[::2, 0] = np.nextafter(0.1, 1)
    x[::3, 1] = np.nextafter(np.nextafter(0.1, 1), 1)
    assert np.isfinite(Q.IsolationForest(x).score(x)).all() and np.isfinite(Q.IsolationForest(x[:1]).score(x)).all()
