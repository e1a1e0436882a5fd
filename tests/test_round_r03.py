"""Findings of the second round that were settled in the third."""

import hashlib
import random
import time
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakframe.llm import jaccard_join as J
from peakframe.llm import quality as Q
from peakframe.operators import kernels as K
from peakframe.operators import library as L
from peakframe.operators import pair_blocks as B
from peakframe.operators import pairs as P
from peakframe.operators import peak_lists as M
from peakframe.operators import peaks as T
from peakframe.operators import proteins as R
from peakframe.operators import shuffled as S
from peakframe.plans.catalog import QUERIES

from .conftest import SMALL
from .llm.test_jaccard_join import near_copies


def _shuffles(spark):
    """Shuffles whose files are still kept."""
    return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def test_join_lets_go_of_its_shuffles(spark, monkeypatch):
    """Shuffles that nothing refers to don't pile up on the disk until the driver's memory is full."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(12))], "doc_id long, text string")
    before = _shuffles(spark)
    held = []
    monkeypatch.setattr(J, "homes_of", lambda *a, f=J.homes_of: (held.append(_shuffles(spark) - before), f(*a))[1])
    drawn = J.sketch(docs).where("size > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.lit(200).alias("weight"))
    J.match(docs, J.cut(drawn), target=2.0)
    time.sleep(1)
    held.append(_shuffles(spark) - before)
    assert len(held) == 4 and held[-1] < 1.5 * held[1]


def test_quality_is_fitted_on_all_labelled_rows(spark, monkeypatch):
    """More labelled rows than any sample held: medians are those of all, and each row can be drawn and counts for the threshold."""
    n = 24_000
    docs = spark.range(n).selectExpr("id doc_id", "repeat(concat('word', cast(id % 7 as string), ' Other, text more of it! '), 5 + cast(id % 11 as int)) text")
    marks = spark.range(n).selectExpr("id doc_id", "cast(id % 10 > 0 as int) quality", "0 toxic")
    monkeypatch.setattr(Q, "base_fails", lambda words, repeats: words < 0)
    told = {}
    monkeypatch.setattr(Q, "medians", lambda m, rows, f=Q.medians: told.update(grown=rows, median=f(m, rows), rows=m.collect()) or told["median"])
    monkeypatch.setattr(Q, "choose_threshold", lambda *a, f=Q.choose_threshold, **k: (told.update(counted=int(k["counts"].sum())), f(*a, **k))[1])
    assert Q.fit(docs, marks) is not None
    good = n * 9 // 10
    assert told["grown"] + told["counted"] > good and told["grown"] == len(told["rows"]) and n / 2.2 < told["counted"] < n / 1.8
    assert told["grown"] + told["counted"] == n - sum(1 for r in marks.selectExpr("quality", "pmod(xxhash64(doc_id, 3), 2) h").collect() if r.quality == 0 and r.h == 0)
    assert (told["median"] == np.median(np.array([r.s for r in told["rows"]])[:, :-2], axis=0)).all()


def test_threshold_by_counts():
    rng = np.random.default_rng(3)
    scores, good = np.round(rng.random(5000) ** 2, 2), rng.random(5000) < 0.8
    scores[good] *= 0.5
    kinds, counts = np.unique(np.stack([scores, good], 1), axis=0, return_counts=True)
    assert Q.choose_threshold(kinds[:, 0], kinds[:, 1] == 1, counts=counts) == Q.choose_threshold(scores, good)


def _spectra(spark, n=260, seed=5, low=100.0, high=140.0):
    rng = np.random.default_rng(seed)
    spectra, peaks = [], []
    for k in range(n):
        spectra.append((int(k), float(round(rng.uniform(low, high), 1)) if k % 9 else 111.0, 1))
        for no in range(int(rng.integers(0, 9))):
            peaks.append((int(k), no + 1, float(rng.integers(100, 400)) / 1.5, float(rng.integers(1, 6))))
    s = spark.createDataFrame([*spectra, (9001, None, 1), (9002, float("nan"), 1), (9003, 111.0, 1)], "spec_idx long, parent_mass double, parent_charge int")
    return s, spark.createDataFrame([*peaks, (7777, 1, 100.0, 1.0)], "spec_idx long, peak_no int, mz double, intensity double")


def _rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("part,elements", [(8192, 1 << 18), (7, 64)])
def test_pairs_in_blocks_equal_joins(spark, monkeypatch, part, elements):
    """In one part or in many, block by block as by joins of the pairs."""
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "ELEMENTS", elements)
    s, p = _spectra(spark)
    pairs = P.candidate_pairs(s, 0.0, 0.5)
    both = ("spec1", "spec2")
    want = _rows(P.all_shifts(p, pairs, 10.0, 2), *both, "shift", "matches", "score")
    assert want and _rows(P.shifts_within(p, s, 0.5, 10.0, 2), *both, "shift", "matches", "score") == want
    assert _rows(P.shifts_within(p, s, 0.5, 10.0, 2, best=True), *both, "shift", "matches", "score") == _rows(P.best_shift(P.all_shifts(p, pairs, 10.0, 2)), *both, "shift", "matches", "score")
    unit = T.transform_l2(T.bin_peaks(p, 10.0), "sqrt").withColumnRenamed("intensity", "value")
    assert _rows(P.full_cosine_within(unit, s, 0.5), *both, "cosine", "shared") == _rows(P.full_cosine(unit, pairs), *both, "cosine", "shared")
    assert _rows(P.dot_bias_within(unit, s, 0.5), *both, "share") == _rows(P.dot_bias(unit, pairs), *both, "share")
    for ratio, peaks in ((0.0, T.transform_l2(p, "sqrt")), (0.55, T.transform_l2(p, "sqrt")), (0.0, T.transform_l2(p.withColumn("peak_no", F.col("peak_no") % 4), "sqrt"))):
        got = _rows(P.cosine_pairs(peaks, s, 0.3, 0.1, 20.0, 0.2, 2, ratio), *both, "cosine", "matched", "delta")
        with monkeypatch.context() as m:
            m.setattr(P, "regular", lambda *a: False)
            assert got and got == _rows(P.cosine_pairs(peaks, s, 0.3, 0.1, 20.0, 0.2, 2, ratio), *both, "cosine", "matched", "delta")


def test_irregular_rows_take_the_joins(spark):
    s, p = _spectra(spark, 40)
    assert P.regular(s, p, ("mz", "intensity", "peak_no")) and not P.regular(s.unionByName(s.limit(1)), p, ("mz",))
    for odd in (None, float("nan"), float("inf")):
        assert not P.regular(s, p.unionByName(spark.createDataFrame([(1, 99, odd, 1.0)], p.schema)), ("mz",))
    twice = s.unionByName(s.where("spec_idx < 20"))
    pairs = P.candidate_pairs(twice, 0.0, 0.5)
    columns = ("spec1", "spec2", "shift", "matches", "score")
    assert _rows(P.shifts_within(p, twice, 0.5, 10.0, 2), *columns) == _rows(P.all_shifts(p, pairs, 10.0, 2), *columns)


@pytest.mark.parametrize("elements", [1 << 18, 64])
def test_kernels_in_blocks_equal_the_kernels(spark, monkeypatch, elements):
    monkeypatch.setattr(B, "ELEMENTS", elements)
    s, p = _spectra(spark)
    rows = {r.id: r for r in B.with_arrays(s, p).where("at is not null and not isnan(at)").collect()}
    pairs = [(a, b, rows[b].at - rows[a].at) for a in rows for b in rows if a < b and abs(rows[b].at - rows[a].at) <= 0.5]
    peaks = {k: list(zip(r.mz, r.value, strict=True)) for k, r in rows.items()}
    run = lambda kernel, columns: sorted(map(tuple, B.compare(B.with_arrays(s, p), s, ("mz", "value"), 0.0, 0.5, kernel, f"spec1 long, spec2 long, {columns}").collect()))
    want = []
    for a, b, delta in pairs:
        one, two, n = K.overlap_score(peaks[a], peaks[b], -delta, 20.0)
        want.append((a, b, round(one, 6), round(two, 6), n))
    assert max(w[-1] for w in want) > 2 and run(partial(B.chains, tol=20.0, gap=57.0), "score1 double, score2 double, matched int") == sorted(want)
    want = []
    for a, b, delta in pairs:
        score, chosen = K.overlap_score_merged(peaks[a], peaks[b], -delta, 20.0)
        want.append((a, b, round(score, 6), len(chosen)))
    assert run(partial(B.merged_sets, tol=20.0, gap=57.0), "score double, matched int") == sorted(want)
    want = [(a, b, round(m, 6), round(i, 6)) for a, b, _ in pairs for m, i, _ in K.merge_lists(*([(m, i, 10.0) for m, i in peaks[k]] for k in (a, b)))]
    assert run(partial(B.merged_lists, tol=10.0), "mz double, intensity double") == sorted(want)


def test_rounding_as_python():
    x = np.r_[np.random.default_rng(4).random(2000) * 50, (np.arange(4000) + 0.5) / 1e6, -2.5e-6, 1e300, 0.0]
    assert B.round_as_python(x, 6).tolist() == [round(v, 6) for v in x.tolist()]


def test_pairs_are_not_shuffled(spark):
    """What is exchanged are the tables and their lists: no join, no aggregation of pairs."""
    for name in ("pairs_greedy_cosine", "pairs_full_cosine", "pairs_dot_bias", "pairs_all_shifts", "pairs_best_shift", "kernel_overlap_scores", "kernel_overlap_merged", "kernel_merge_lists"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
        above = plan[: plan.index("MapInArrow")]
        assert "Join" not in above and "Aggregate" not in above and plan.count("SortMergeJoin") == 1, name


@pytest.mark.parametrize("part,elements", [(8192, 1 << 18), (7, 64)])
def test_search_in_blocks_equals_joins(spark, monkeypatch, part, elements):
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "ELEMENTS", elements)
    s, p = _spectra(spark)
    q = s.select(F.col("spec_idx").alias("query"), F.col("parent_mass").alias("query_mz"))
    q = q.unionByName(q.where("query < 9").withColumn("query_mz", F.col("query_mz") + 0.2))  # a query of two masses
    lib = s.where("spec_idx % 2 = 0").selectExpr("spec_idx lib_idx", "parent_mass + 0.1 parent_mz", "cast(1 + spec_idx % 3 as int) library_quality")
    unit = T.transform_l2(T.bin_peaks(p, 50.0), "sqrt")
    side = lambda name: unit.select(F.col("spec_idx").alias(name), "bin", F.col("intensity").alias("value"))
    columns = ("query", "lib_idx", "score", "hit")
    joined = L.similarity(L.candidates(q.distinct(), lib, 0.5, 2), side("query"), side("lib_idx"))
    joined = joined.groupBy("query", "lib_idx", "query_mz").agg(F.round(F.first("score") / F.count("*"), 6).alias("score"))
    for k, least in ((2, 0.1), (3, 0.0)):
        got = _rows(L.search(q.where("query >= 9"), lib, side("query"), side("lib_idx"), 0.5, k, least, 2, 6), *columns)
        assert got and got == _rows(L.top_hits(joined.where("query >= 9"), k, least), *columns)
    twice = L.search(q, lib, side("query"), side("lib_idx"), 0.5, 2, 0.0, 2, 6).where("query < 9").groupBy("query").agg(F.count("*").alias("c"), F.max("hit").alias("h"))
    assert all(r.c == r.h <= 2 for r in twice.collect())  # both masses' hits are ranked together


@pytest.mark.parametrize("part", [200_000, 5])
def test_bin_candidates_equal_all_meetings(spark, monkeypatch, part):
    monkeypatch.setattr(M, "BIN_PART", part)
    monkeypatch.setattr(B, "ELEMENTS", 512 if part == 5 else B.ELEMENTS)
    _, p = _spectra(spark)
    p = p.unionByName(spark.createDataFrame([(None, 1, 100.0, 1.0), (5, 50, None, 1.0)] + [(8000, k, float(k), 1.0) for k in range(400)], p.schema))
    bins = {}
    for r in p.collect():
        if r.spec_idx is not None and r.mz is not None:
            bins.setdefault(r.spec_idx, set()).add(int(r.mz // 2))
    for least in (1, 2, 3):
        want = sorted((a, b, len(x & y)) for a, x in bins.items() if a % 10 == 0 for b, y in bins.items() if a != b and len(x & y) >= least)
        assert want and _rows(M.bin_candidates(p.where("spec_idx % 10 = 0"), p, 2.0, least), "query", "spec_idx", "bins") == want


def test_searches_make_no_candidate_rows(spark):
    for name, joins in (("library_search", 2), ("pairs_bin_candidates", 0)):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
        above = plan[: plan.index("MapInArrow")]
        assert "Join" not in above and plan.count("SortMergeJoin") == joins, name


def test_shuffled_by_digests(spark, monkeypatch):
    """Letters by the digest of each place, whatever sequences are worked on together; one pass over the texts, no row or lambda for a letter."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACDEFG\u00e9\U0001d49c") for _ in range(n)) for n in (0, 1, 2, 5, 9, 10, 11, 99, 101, 1234, 12345)] + [None, "", "AAAA"]

    def slow(s):
        d = hashlib.md5(s.encode()).hexdigest()
        return "".join(s[i] for i in sorted(range(len(s)), key=lambda i: hashlib.md5(f"{d}:{i}".encode()).hexdigest()))

    want = [slow(s) if s else s for s in texts]
    assert S.shuffled(texts) == want
    monkeypatch.setattr(S, "LETTERS", 50)
    monkeypatch.setattr(S, "MESSAGES", 7)
    assert S.shuffled(texts) == want
    monkeypatch.setattr(S, "md5_heads", lambda words: np.zeros(len(words[14]), np.uint64))  # heads alike
    assert S.shuffled(texts) == want
    p = spark.createDataFrame([(k, None if k == 3 else f"p{k}", t) for k, t in enumerate(texts)], "prot_idx long, id string, seq string")
    df = R.shuffled_decoys(p)
    assert sorted(map(str, df.collect())) == sorted(str(r) for r in [*p.collect(), *spark.createDataFrame([(k, None if k == 3 else f"XXXp{k}", t) for k, t in enumerate(want)], p.schema).collect()])
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "md5" not in plan and "Union" not in plan
