"""Queries that match theoretical ions, peptides and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.peptides import RESIDUE_MASS
from ..operators import annotation as A
from ..operators import psms as M
from . import views as V
from .registry import query

W = V.with_views
MASS = "(SELECT * FROM (VALUES " + ", ".join(f"('{r}', {m}::DOUBLE)" for r, m in RESIDUE_MASS.items()) + ") t(r, m))"
#: Peptides of eight residues for every spectrum, from the letters of its number.
LETTERS = "GASPVTCLNDQKEMHFRYW"
CAND = W("peaks", "spectra") + f""", c AS (SELECT spec_idx, array_to_string([substr('{LETTERS}', CAST(1 + (spec_idx * k + k * k) % 19 AS INTEGER), 1) FOR k IN range(1, 9)], '') AS peptide FROM spectra),
l AS (SELECT spec_idx, peptide, i, t.m FROM c, range(1, 9) u(i), {MASS} t WHERE t.r = substr(peptide, CAST(i AS INTEGER), 1)),
x AS (SELECT spec_idx, peptide, 'b' AS ion, i AS position, sum(m) OVER (PARTITION BY spec_idx ORDER BY i) + 1.007825035 AS ion_mz FROM l UNION ALL SELECT spec_idx, peptide, 'y', 9 - i, sum(m) OVER (PARTITION BY spec_idx ORDER BY i DESC) + 18.010564686 + 1.007825035 FROM l),
a AS (SELECT x.*, peak_no, mz, intensity FROM x JOIN peaks p ON p.spec_idx = x.spec_idx AND abs(ion_mz - mz) <= 5.000001 WHERE position < 8)"""


def _candidates(spark, d):
    letter = lambda k: F.substring(F.lit(LETTERS), (1 + (F.col("spec_idx") * k + k * k) % 19).cast("int"), F.lit(1))
    return V.spectra(spark, d).select("spec_idx", F.concat(*[letter(k) for k in range(1, 9)]).alias("peptide"))


def _annotated(spark, d):
    return A.annotate(V.peaks(spark, d), _candidates(spark, d), 5.0)


@query(CAND + " SELECT spec_idx, peptide, ion, position, round(ion_mz, 4) AS ion_mz, peak_no, round(mz, 4) AS mz FROM a")
def annotate_ions(spark, d):
    return _annotated(spark, d).select("spec_idx", "peptide", "ion", F.col("position").cast("long").alias("position"), F.round("ion_mz", 4).alias("ion_mz"), "peak_no", F.round("mz", 4).alias("mz"))


@query(CAND + " SELECT CAST(floor((mz - ion_mz) / 0.5) AS BIGINT) AS bin, count(*) AS ions FROM a GROUP BY 1")
def annotate_error_histogram(spark, d):
    return A.error_histogram(_annotated(spark, d), 0.5)


@query(CAND + ", h AS (SELECT DISTINCT spec_idx, peptide, peak_no, mz, intensity FROM a) SELECT spec_idx, peptide, sum(intensity) AS score, count(*) AS matched FROM h GROUP BY spec_idx, peptide QUALIFY row_number() OVER (PARTITION BY spec_idx ORDER BY sum(intensity) DESC, peptide) = 1")
def annotate_best_peptide(spark, d):
    return A.best_peptide(V.peaks(spark, d), _candidates(spark, d), 5.0)


@query(CAND + ", v AS (SELECT spec_idx, ion, position, sum(intensity) AS i FROM a GROUP BY ALL), s AS (SELECT DISTINCT spec_idx FROM v), k AS (SELECT spec_idx, ion, position FROM s, (VALUES ('b'), ('y')) t(ion), range(1, 8) r(position)) SELECT k.spec_idx, k.ion, CAST(k.position AS BIGINT) AS position, coalesce(i, 0) AS value FROM k LEFT JOIN v ON v.spec_idx = k.spec_idx AND v.ion = k.ion AND v.position = k.position")
def annotate_ion_vectors(spark, d):
    v = A.extract_ions(_annotated(spark, d), ["b", "y"], 7).select("spec_idx", F.posexplode("vector").alias("p", "value"))
    return v.select("spec_idx", F.when(F.col("p") < 7, "b").otherwise("y").alias("ion"), (F.col("p") % 7 + 1).cast("long").alias("position"), "value")


@query(
    W("pairs") + """, s AS (SELECT unnest([shift1, shift2]) AS s FROM pairs), b AS (SELECT abs(CAST(trunc(s / 0.5) AS BIGINT)) AS bin, count(*) AS n FROM s GROUP BY 1),
    f AS (SELECT bin, CASE WHEN n <= 1 OR bin * 0.5 > 90 THEN 0 ELSE n / (SELECT count(*) FROM s) END AS f FROM b) SELECT bin, round(CASE WHEN f > 0 THEN greatest(ln(greatest(f, 1e-6) / (SELECT max(f) FROM f)), -8) ELSE -8 END, 6) AS penalty FROM f"""
)
def annotate_mod_penalties(spark, d):
    return A.penalties(M.modification_frequency(V.pairs(spark, d), 0.5), -8.0).withColumn("penalty", F.round("penalty", 6))


@query(
    W("pairs") + """, k AS (SELECT o_orderkey AS spec_idx, concat('P', o_custkey % 11) AS peptide FROM orders WHERE o_orderkey % 4 = 0), e AS (SELECT spec1 AS spec_idx, spec2 AS source, score1 FROM pairs UNION ALL SELECT spec2, spec1, score1 FROM pairs),
    n AS (SELECT e.spec_idx, peptide, source, score1 AS score FROM e JOIN k ON k.spec_idx = source WHERE e.spec_idx NOT IN (SELECT spec_idx FROM k)) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY spec_idx ORDER BY score DESC, source, peptide) = 1"""
)
def annotate_propagate(spark, d):
    known = V.table(spark, d, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey spec_idx", "concat('P', o_custkey % 11) peptide")
    return A.propagate(V.pairs(spark, d), known)


@query(
    W("psms") + """, a AS (SELECT scan * 8 + psm_no AS spec_idx, CASE WHEN db_index % 3 = 0 THEN 'AC(S,79.97)K' ELSE 'ACSK' END AS annotation, charge, score FROM psms),
    p AS (SELECT * FROM a WHERE annotation = 'ACSK' QUALIFY row_number() OVER (PARTITION BY charge ORDER BY score DESC, spec_idx) = 1)
    SELECT a.spec_idx, a.annotation, 'ACSK' AS bare, a.charge, p.spec_idx AS plain_idx, p.score AS plain_score FROM a JOIN p ON p.charge = a.charge WHERE a.annotation <> 'ACSK'"""
)
def annotate_pair_modified(spark, d):
    p = V.psms(spark, d).selectExpr("scan * 8 + psm_no spec_idx", "case when db_index % 3 = 0 then 'AC(S,79.97)K' else 'ACSK' end annotation", "charge", "score")
    return A.pair_modified(p)


@query(
    W("peaks", "spectra") + """, s AS (SELECT spec_idx, spec_idx AS survey_idx, parent_mass / 3 AS parent_mz FROM spectra), t AS (SELECT spec_idx, survey_idx, z AS charge, parent_mz + 1.007825035 / z AS isotope FROM s, range(1, 4) r(z)),
    g AS (SELECT t.spec_idx, charge, sum(intensity) AS i FROM t JOIN peaks p ON p.spec_idx = survey_idx AND abs(isotope - mz) <= 20.000001 GROUP BY ALL) SELECT spec_idx, CAST(charge AS INTEGER) AS charge FROM g QUALIFY row_number() OVER (PARTITION BY spec_idx ORDER BY i DESC, charge) = 1"""
)
def annotate_guess_charge(spark, d):
    s = V.spectra(spark, d).select("spec_idx", F.col("spec_idx").alias("survey_idx"), (F.col("parent_mass") / 3).alias("parent_mz"))
    return A.guess_charge(s, V.peaks(spark, d), [1, 2, 3], 20.0)
