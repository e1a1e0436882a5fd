import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from peakframe.llm import jaccard_join as J

from ..conftest import SMALL
from .cases import awkward, empty


def brute(rows):
    """(class_id, n_links) by row; rows: (doc_id, text)."""
    sets = [frozenset(J.shingles(t or "").tolist()) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in g if x is not None), default=None) for k, g in groups.items()}
    return [(d, least[find(i)] if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)]


def near_copies(n, groups=3, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(25))], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect()) == sorted(brute([tuple(r) for r in docs.collect()]))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect()) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_split_groups(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 2_000)  # some ten classes in a part
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(40, 1))], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect()) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_prefixes_are_shortened_until_the_recall(spark):
    close = [" ".join(f"w{i}x{k}" for i in range(300)) + f" end{j}" for k in range(30) for j in range(3)]  # similarity about 0.98
    far = sorted(set(near_copies(20)))
    for texts, depth in ((close, J.LONGEST), (far, J.match_depth())):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        classes = J.sketch(docs).selectExpr("f1", "f2", "doc_id rep", "1L n", "size weight", "keys")
        found, ended, measured = J.match(docs, classes, target=J.TARGET if depth == J.LONGEST else 0.999999)
        assert ended == depth and (measured >= J.TARGET or ended == J.match_depth())
        assert found.agg(F.sum("links")).first()[0] == sum(n for *_, n in brute(list(enumerate(texts))))


def test_chains_do_not_compare_all_with_all(spark):
    words = [f"w{i}" for i in range(2300)]
    docs = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 300])) for i in range(200)], "doc_id long, text string")  # each like its next ones
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect()) == sorted(brute([tuple(r) for r in docs.collect()]))
    classes = J.sketch(docs).selectExpr("f1", "f2", "doc_id rep", "1L n", "size weight", "keys")
    at = J.shared_nodes(classes, 0)
    assert max(r["count"] for r in J.blocks(at, J.homes_of(at, 0)).groupBy("a", "b").count().collect()) < 60


def test_awkward(spark):
    docs = awkward(spark)
    rows = J.join(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].class_id == 1 and by_id[1].n_links == by_id[2].n_links == 3 and by_id[1].kept and not by_id[2].kept
    assert by_id[4].n_links == by_id[5].n_links == 0 and by_id[4].class_id == 4
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(7) == 2 and ids.count(11) == 1
    repeated = docs.where("doc_id = 7").unionByName(docs.where("doc_id = 7"))
    assert J.keep_one(repeated).count() == 2
    assert J.join(empty(spark)).count() == 0 and J.keep_one(empty(spark)).count() == 0


def test_overlaps_and_recall():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 120).astype(np.uint64)) for _ in range(60)]
    got = J.overlaps(sets)
    for i, j in combinations(range(60), 2):
        assert got[i, j] == got[j, i] == len(np.intersect1d(sets[i], sets[j]))
    d = J.match_depth()
    assert J.recall(J.THRESHOLD, d) >= J.TARGET > J.recall(J.THRESHOLD, d + 1)


def test_words():
    assert len(J.word_hashes("A-b, C's ÉT é_x")) == 7 and (J.word_hashes("ab cd") == J.word_hashes("AB, cd!")).all()
    assert len(J.shingles("one two")) == 1 and len(J.shingles("")) == 0 and (J.shingles("a b c d e") == J.shingles("a b c d e")).all()
    assert not (J.shingles("a b") == J.shingles("b a")).all()
    x = J.shingles(" ".join(map(str, range(100_000))))
    assert len(x) == 99_996


def test_hot_copies_stay_linear(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text that a third of all rows hold word for word").alias("text"))
    r = J.join(docs).agg(F.count_distinct("class_id"), F.min("n_links"), F.max("n_links")).first()
    assert tuple(r) == (1, 2999, 2999)
