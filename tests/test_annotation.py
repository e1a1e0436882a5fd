from peakframe.operators import annotation as A
from peakframe.operators import library as L
from peakframe.operators import reports as R


def test_best_peptide_and_vectors(spark):
    # b and y ions of GAS: b1 58.03, b2 129.07, y1 106.05, y2 177.09
    peaks = spark.createDataFrame([(1, 1, 58.03, 2.0), (1, 2, 129.07, 3.0), (1, 3, 177.09, 1.0), (1, 4, 300.0, 9.0)], "spec_idx long, peak_no int, mz double, intensity double")
    candidates = spark.createDataFrame([(1, "GAS"), (1, "SAG")], "spec_idx long, peptide string")
    best = A.best_peptide(peaks, candidates, 0.02).first()
    assert (best.peptide, best.score, best.matched) == ("GAS", 6.0, 3)
    hits = A.annotate(peaks, candidates.where("peptide = 'GAS'"), 0.02)
    assert A.extract_ions(hits, ["b", "y"], 2).first().vector == [2.0, 3.0, 0.0, 1.0]


def test_substitution_penalties(spark):
    m = spark.createDataFrame([("A", "A", 4), ("A", "R", -1), ("R", "A", -1), ("R", "R", 5)], "a string, b string, score int")
    assert {(r.a, r.b): r.penalty for r in A.substitution_penalties(m).collect()} == {("A", "A"): 0, ("A", "R"): -5, ("R", "A"): -6, ("R", "R"): 0}


def test_target_and_decoy_tie_gives_nothing(spark):
    rows = [(1, 1, 0.8, False, 0.0), (1, 2, 0.8, True, 0.0), (2, 1, 0.9, False, 0.12), (2, 2, 0.5, True, 0.0), (3, 5, 0.4, True, 0.0)]
    df = spark.createDataFrame(rows, "query int, lib_idx int, score double, is_decoy boolean, dot_bias double")
    got = {r.query: (r.lib_idx, r.is_decoy, round(r.score, 6)) for r in L.target_or_decoy(df, "bias").collect()}
    assert got == {2: (1, False, round(0.9 * 0.6 + 0.4 * 0.4 - 0.12, 6)), 3: (5, True, round(0.4 * 0.6 + 0.4 * 0.4, 6))}


def test_library_functions(spark):
    from pyspark.sql import functions as F

    lib = spark.createDataFrame([(1, "PEPTIDE", 2)], "lib_idx int, peptide string, charge int")
    both = L.with_decoys(lib).collect()
    assert len(both) == 2 and sorted(both[1].peptide) == sorted("PEPTIDE") and both[1].is_decoy
    row = spark.range(1).select(L.empirical_cdf(F.array(F.struct(F.lit(0.1).alias("bucket"), F.lit(0.3).alias("p")), F.struct(F.lit(0.6).alias("bucket"), F.lit(0.7).alias("p"))), F.lit(0.5)).alias("c")).first()
    assert row.c == 0.3
    t = spark.createDataFrame([(i, i % 2) for i in range(10)], "k int, g int")
    assert [r.k for r in R.page(t, "k", 1, 2, "g", "1").collect()] == [3, 5]
    assert R.differences(t, t, ["k"]).count() == 0
