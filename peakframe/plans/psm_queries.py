"""Queries on matches: target-decoy control, filters, consensus, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import psm_filters as S
from ..operators import psms as M
from . import views as V
from .registry import query

W = V.with_views
PSMS = W("psms")
TOP = """, top AS (SELECT * FROM psms QUALIFY row_number() OVER (PARTITION BY scan, spectrum_file{more} ORDER BY score DESC, db_index, annotation_id, psm_no, p_value, is_decoy) = 1)"""
CURVE = """, ranked AS (SELECT *, sum(CAST(is_decoy AS BIGINT)) OVER w AS d, row_number() OVER w AS rnk FROM top WINDOW w AS (ORDER BY score DESC, db_index, annotation_id, psm_no, p_value, is_decoy, scan, spectrum_file)),
f AS (SELECT *, CASE WHEN rnk = d THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, d * 1.0::DOUBLE / (rnk - d)) END AS fdr FROM ranked),
q AS (SELECT *, min(fdr) OVER (ORDER BY rnk DESC ROWS UNBOUNDED PRECEDING) AS q FROM f)"""
OUT = " SELECT scan, spectrum_file, score, is_decoy, round(fdr, 9) AS fdr, round(q, 9) AS q, rnk AS rank FROM q"


def _curve(df):
    return df.select("scan", "spectrum_file", "score", "is_decoy", F.round("fdr", 9).alias("fdr"), F.round("q", 9).alias("q"), F.col("rank").cast("long").alias("rank"))


@query(PSMS + TOP.format(more="") + CURVE + OUT)
def fdr_q_values(spark, d):
    return _curve(M.concatenated_fdr(V.psms(spark, d)))


@query(PSMS + TOP.format(more=", is_decoy") + CURVE + OUT)
def fdr_separate(spark, d):
    return _curve(M.separate_fdr(V.psms(spark, d)))


@query(PSMS + TOP.format(more="") + CURVE + OUT + " WHERE q <= 0.501")
def fdr_cutoff(spark, d):
    return _curve(M.fdr_cutoff(M.concatenated_fdr(V.psms(spark, d)), 0.501))


@query(PSMS + TOP.format(more="") + " SELECT scan, spectrum_file, db_index, annotation_id, score FROM top")
def psm_top_hit(spark, d):
    return M.top_hit(V.psms(spark, d)).select("scan", "spectrum_file", "db_index", "annotation_id", "score")


@query(PSMS + " SELECT annotation_id, charge, scan, spectrum_file, score FROM psms QUALIFY row_number() OVER (PARTITION BY annotation_id, charge ORDER BY score DESC, db_index, psm_no, p_value, is_decoy, scan, spectrum_file, envelope) = 1")
def psm_best_per_peptide(spark, d):
    return M.best_per_peptide(V.psms(spark, d)).select("annotation_id", "charge", "scan", "spectrum_file", "score")


@query(
    PSMS + """, m AS (SELECT scan % 997 AS cluster_id, annotation_id % 13 AS annotation_id, p_value FROM psms), v AS (SELECT cluster_id, annotation_id, count(*) AS votes, min(p_value) AS p_value FROM m GROUP BY ALL)
    SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, p_value, annotation_id) = 1"""
)
def psm_cluster_consensus(spark, d):
    return M.cluster_consensus(V.psms(spark, d).selectExpr("scan % 997 cluster_id", "annotation_id % 13 annotation_id", "p_value"))


#: An annotation with one or two modifications for each match.
ANNOTATED = "concat('AC', CASE WHEN annotation_id % 3 = 0 THEN '(ST,79.97)' WHEN annotation_id % 3 = 1 THEN '(M,15.99)' ELSE 'K' END, 'LE', CASE WHEN db_index % 2 = 0 THEN '(Q,-17.03)' ELSE 'R' END)"


def _annotated(spark, d):
    return V.psms(spark, d).withColumn("annotation", F.expr(ANNOTATED))


MODS = PSMS + f""", a AS (SELECT {ANNOTATED} AS annotation FROM psms), m AS (SELECT unnest(regexp_extract_all(annotation, '\\(([A-Z]+,-?[0-9.]+)\\)', 1)) AS m FROM a),
r AS (SELECT split_part(m, ',', 1) AS residues, CAST(round(CAST(split_part(m, ',', 2) AS DOUBLE)) AS BIGINT) AS mod FROM m),
c AS (SELECT unnest(string_split(residues, '')) AS residue, mod, 1.0 / length(residues) AS w FROM r)"""


@query(MODS + " SELECT residue, mod, round(sum(w), 4) AS weight FROM c GROUP BY ALL")
def mod_counts(spark, d):
    return M.modification_counts(_annotated(spark, d)).select("residue", "mod", F.round("weight", 4).alias("weight"))


@query(MODS + " SELECT mod, " + ", ".join(f"round(coalesce(sum(w) FILTER (residue = '{r}'), 0), 4) AS {r}" for r in "STMQ") + ", round(sum(w), 4) AS total FROM c GROUP BY mod")
def mod_matrix(spark, d):
    wide = M.modification_matrix(_annotated(spark, d), list("STMQ"))
    return wide.select("mod", *[F.round(c, 4).alias(c) for c in [*"STMQ", "total"]])


@query(PSMS + f", a AS (SELECT scan, psm_no, db_index, {ANNOTATED} AS annotation FROM psms) SELECT * FROM a WHERE annotation NOT LIKE '%(Q%' AND annotation NOT LIKE '%79.97%'")
def mod_filter(spark, d):
    return M.filter_by_mods(_annotated(spark, d), [15.99], 1).select("scan", "psm_no", "db_index", "annotation")


@query(
    W("pairs") + """, s AS (SELECT unnest([shift1, shift2]) AS s FROM pairs), b AS (SELECT abs(CAST(trunc(s / 0.5) AS BIGINT)) AS bin, count(*) AS n FROM s GROUP BY 1)
    SELECT bin, round(CASE WHEN n <= 1 OR bin * 0.5 > 90 THEN 0 ELSE n / (SELECT count(*) FROM s) END, 9) AS frequency FROM b"""
)
def mod_frequency(spark, d):
    return M.modification_frequency(V.pairs(spark, d), 0.5).select("bin", F.round("frequency", 9).alias("frequency"))


@query()
def parsimony(spark, d):
    return M.parsimony(V.psms(spark, d).where("not is_decoy").select("scan", "db_index"))


@query(
    W("spectra") + """, s AS (SELECT spec_idx, frag_type, floor(parent_mass / 1500) AS parent_mass FROM spectra),
    n AS (SELECT *, CASE WHEN parent_mass IS DISTINCT FROM lag(parent_mass) OVER (PARTITION BY frag_type ORDER BY spec_idx) THEN 1 ELSE 0 END AS new FROM s),
    r AS (SELECT *, sum(new) OVER (PARTITION BY frag_type ORDER BY spec_idx ROWS UNBOUNDED PRECEDING) AS run FROM n),
    x AS (SELECT *, row_number() OVER (PARTITION BY frag_type, run ORDER BY spec_idx) - 1 AS nth FROM r)
    SELECT spec_idx, frag_type, CAST(run AS BIGINT) AS run, CAST(nth // 2 AS BIGINT) AS piece, CAST(nth % 2 AS BIGINT) AS place FROM x"""
)
def psm_paired_scans(spark, d):
    s = V.spectra(spark, d).select("spec_idx", "frag_type", F.floor(F.col("parent_mass") / 1500).alias("parent_mass"))
    return M.paired_scans(s, 2, ["frag_type"]).select("spec_idx", "frag_type", F.col("run").cast("long").alias("run"), F.col("piece").cast("long").alias("piece"), F.col("place").cast("long").alias("place"))


@query(PSMS + " SELECT DISTINCT db_index FROM psms")
def filter_distinct(spark, d):
    return S.distinct_values(V.psms(spark, d), "db_index")


@query(PSMS + " SELECT scan, psm_no FROM psms WHERE spectrum_file = 'F' AND charge = 2 AND psm_no = 1")
def filter_select_keys(spark, d):
    return S.select_equal(V.psms(spark, d), spectrum_file="F", charge=2, psm_no=1).select("scan", "psm_no")


@query(W("spectra") + " SELECT * FROM spectra WHERE frag_type = 'O'")
def filter_activation(spark, d):
    return S.by_activation(V.spectra(spark, d), "O")


@query(W("psms", "spectra") + " SELECT scan, psm_no, p.charge FROM psms p JOIN spectra s ON scan = spec_idx WHERE coalesce(CASE WHEN p.charge <> 1 THEN p.charge END, parent_charge) IN (2, 3)")
def filter_charge(spark, d):
    p = V.psms(spark, d).withColumn("charge0", F.col("charge")).withColumn("charge", F.when(F.col("charge") == 1, -1).otherwise(F.col("charge")))
    j = p.join(V.spectra(spark, d).select(F.col("spec_idx").alias("scan"), "parent_charge"), "scan")
    return S.by_charge(j, [2, 3], "parent_charge").select("scan", "psm_no", F.col("charge0").alias("charge"))


@query(PSMS + " SELECT scan, psm_no, p_value, envelope FROM psms WHERE p_value <= 0.03 AND envelope <= 0.05")
def filter_p_value_envelope(spark, d):
    return S.by_envelope(S.by_p_value(V.psms(spark, d), 0.03), 0.05).select("scan", "psm_no", "p_value", "envelope")


@query(PSMS + f", a AS (SELECT scan, psm_no, {ANNOTATED} AS annotation FROM psms) SELECT * FROM a WHERE NOT regexp_matches(annotation, '[MK]')")
def filter_residues(spark, d):
    return S.without_residues(_annotated(spark, d), "MK").select("scan", "psm_no", "annotation")


@query(W("spectra", "psms") + " SELECT * FROM spectra WHERE spec_idx IN (SELECT scan FROM psms WHERE is_decoy)")
def filter_with_match(spark, d):
    return S.with_match(V.spectra(spark, d), V.psms(spark, d).where("is_decoy").withColumnRenamed("scan", "spec_idx"))


@query(PSMS + " SELECT scan, spectrum_file, psm_no FROM psms QUALIFY count(*) OVER (PARTITION BY scan, spectrum_file) = 1")
def filter_single_interpretation(spark, d):
    return S.single_interpretation(V.psms(spark, d), ["scan", "spectrum_file"]).select("scan", "spectrum_file", "psm_no")


@query(W("spectra") + " SELECT * FROM spectra WHERE spec_idx BETWEEN 1 AND 30 OR spec_idx = 77 OR spec_idx BETWEEN 1000 AND 2000")
def filter_range_list(spark, d):
    return S.by_range_list(V.spectra(spark, d), "spec_idx", "1-30,77,1000-2000")


@query(PSMS + f", a AS (SELECT scan, psm_no, {ANNOTATED} AS annotation FROM psms) SELECT scan, psm_no FROM a WHERE annotation LIKE '%(%'")
def filter_modified(spark, d):
    return _annotated(spark, d).where(S.is_modified()).select("scan", "psm_no")


@query(PSMS + " SELECT scan, psm_no, db_index FROM psms WHERE db_index IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def filter_target_proteins(spark, d):
    targets = V.table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("db_index"))
    return S.proteins_of(V.psms(spark, d), targets).select("scan", "psm_no", "db_index")


@query(
    PSMS + """, l AS (SELECT db_index, charge, max(score) AS score FROM psms WHERE spectrum_file = 'F' GROUP BY ALL), n AS (SELECT db_index, charge, max(score) AS score FROM psms WHERE spectrum_file = 'O' GROUP BY ALL)
    SELECT coalesce(l.db_index, n.db_index) AS db_index, coalesce(l.charge, n.charge) AS charge, greatest(l.score, n.score) AS score, CASE WHEN n.score IS NULL OR l.score >= n.score THEN 'F' ELSE 'O' END AS source FROM l FULL JOIN n ON l.db_index = n.db_index AND l.charge = n.charge"""
)
def library_keep_better(spark, d):
    side = lambda f: V.psms(spark, d).where(F.col("spectrum_file") == f).groupBy("db_index", "charge").agg(F.max("score").alias("score")).withColumn("source", F.lit(f))
    return M.keep_better(side("F"), side("O"), ["db_index", "charge"])
