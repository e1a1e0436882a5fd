"""Findings of the second round on the catalog's queries."""

import duckdb
from pyspark.sql import functions as F

from peakframe.operators import annotation as A
from peakframe.operators import pairs as Q
from peakframe.operators import proteins as R
from peakframe.operators.components import _with_least
from peakframe.plans import views as V
from peakframe.plans.catalog import QUERIES

from .conftest import SMALL
from .test_catalog import _key


def test_pairs_are_rounded_as_the_sql_does(spark, tmp_path):
    """Prices whose quotients lie next to a half, where decimal and binary rounding differ."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS o_orderkey, i % 1501 AS o_custkey, 1000 + i * 12.5 + 0.0::DOUBLE AS o_totalprice FROM range(40000) t(i)) TO '{tmp_path}/orders.parquet'")
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    found = c.execute(V.with_views("pairs") + " SELECT spec1, spec2, score1, score2, shift1, shift2 FROM pairs").fetchall()
    got = V.pairs(spark, str(tmp_path)).select("spec1", "spec2", "score1", "score2", "shift1", "shift2").collect()
    assert sorted(map(_key, got)) == sorted(map(_key, found))


def _executed(df):
    """The physical plan as the planner chose it, without a run."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_ions_are_not_broadcast(spark):
    """The peptides of many spectra look like a small table, and their ions are not."""
    for name in ("annotate_ions", "annotate_error_histogram", "annotate_best_peptide", "annotate_ion_vectors", "annotate_ion_cosine"):
        plan = _executed(QUERIES[name](spark, SMALL))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_annotation_within_rows_equals_all_comparisons(spark):
    peaks = [(s, k, 50.0 + 37.03 * k + s, float(k)) for s in range(6) for k in range(12)] + [(9, 1, float("nan"), 1.0), (None, 1, 72.0, 1.0)]
    p = spark.createDataFrame(peaks, "spec_idx long, peak_no int, mz double, intensity double")
    m = spark.createDataFrame([(0, "GAS"), (1, "ACDK"), (1, "SAG"), (3, ""), (4, None), (9, "GAS"), (77, "GAS"), (None, "GAS")], "spec_idx long, peptide string")
    got = sorted(tuple(r) for r in A.annotate(p, m, 3.0).select("spec_idx", "peptide", "ion", "position", "peak_no").collect())
    ions = A.theoretical(m).where("spec_idx is not null").collect()
    assert got == sorted((i.spec_idx, i.peptide, i.ion, i.position, k) for i in ions for s, k, mz, _ in peaks if s == i.spec_idx and abs(i.ion_mz - mz) <= 3.0 + 1e-6) and got


def test_jumps_are_not_broadcast(spark):
    plan = _executed(QUERIES["pairs_jumps"](spark, SMALL))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_matches_of_listed_pairs_move_no_pairs(spark):
    """Pairs with their peak lists: the joins are those of the inputs, and the rows those of pairs without lists."""
    df = QUERIES["pairs_matched_shifted"](spark, SMALL)
    assert _executed(df).count("SortMergeJoin") == 3  # lists to spectra on both sides, and the candidates
    plain = Q.matched_peaks(V.peaks(spark, SMALL), Q.candidate_pairs(V.spectra(spark, SMALL), 0.0, 0.5), 20.0, F.col("delta"))
    cols = ["spec1", "spec2", "i", "j"]
    got = sorted(map(tuple, df.select(cols).collect()))
    assert got and got == sorted(map(tuple, plain.select(cols).collect()))


def test_protein_searches_shuffle_no_texts(spark):
    for name in ("protein_occurrences", "protein_search", "protein_coverage", "protein_total_coverage", "protein_mass_search"):
        plan = _executed(QUERIES[name](spark, SMALL))
        assert "kmer" not in plan and plan.count("MapInArrow") == 1 and "Window" not in plan, name


def test_occurrences_by_both_ways(spark):
    texts = [(1, "ACDACDACDEFG"), (2, "AAAAAAAA"), (3, ""), (4, None), (5, "ĀCDEFGĀCDEFG"), (6, "acdefgACDEFG")]
    peptides = ["ACD", "AA", "ACDEFG", "CDEFG", "ĀCDEFG", "W", "AAAAAAA", "", None]
    p = spark.createDataFrame(texts, "prot_idx long, seq string")
    w = spark.createDataFrame([(x,) for x in peptides], "peptide string")
    want = sorted((x, k, i) for k, t in texts for x in peptides if x and t for i in range(len(t)) if t.startswith(x, i))
    for sent in (0, 100):
        assert sorted(map(tuple, R.occurrences(p, w, sent=sent).collect())) == want


def test_stars_are_not_broadcast(spark):
    e = spark.createDataFrame([(2, 1), (3, 1), (4, 3)], "u long, v long")
    df = _with_least(e, e.groupBy("u").agg(F.min("v").alias("m")))
    assert "SortMergeJoin" in _executed(df) and "Broadcast" not in _executed(df) and sorted(map(tuple, df.select("u", "v", "m").collect())) == [(2, 1, 1), (3, 1, 1), (4, 3, 3)]
