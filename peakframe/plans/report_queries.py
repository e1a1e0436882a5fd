"""Queries on libraries, reports and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import psms as M
from ..operators import reports as R
from . import views as V
from .registry import query
from .psm_queries import CURVE, PSMS, TOP

W = V.with_views
SEARCH = W("library", "spectra") + ", q AS (SELECT spec_idx AS query, parent_mass AS query_mz, parent_charge FROM spectra), c AS (SELECT query, lib_idx, query_mz, parent_mz, abs(query_mz - parent_mz) / parent_mz * 1e6 AS ppm, round(1 - abs(query_mz - parent_mz), 6) AS score, lib_idx % 2 = 1 AS is_decoy, CASE WHEN lib_idx % 3 = 0 THEN 0.12 ELSE 0.0 END::DOUBLE AS dot_bias FROM q JOIN library ON abs(query_mz - parent_mz) <= 0.5 WHERE library_quality <= 2)"


def _searched(spark, d):
    q = V.spectra(spark, d).selectExpr("spec_idx query", "parent_mass query_mz")
    c = L.candidates(q, V.library(spark, d), 0.5, 2)
    return c.withColumns({"score": F.round(1 - F.abs(F.col("query_mz") - F.col("parent_mz")), 6), "is_decoy": F.col("lib_idx") % 2 == 1, "dot_bias": F.when(F.col("lib_idx") % 3 == 0, 0.12).otherwise(0.0)})


@query(SEARCH + " SELECT query, lib_idx, round(ppm, 4) AS ppm, score FROM c")
def library_candidates(spark, d):
    return _searched(spark, d).select("query", "lib_idx", F.round("ppm", 4).alias("ppm"), "score")


@query(
    W("library", "spectra", "peaks") + """, q AS (SELECT spec_idx AS query, parent_mass AS query_mz FROM spectra), c AS (SELECT query, lib_idx FROM q JOIN library ON abs(query_mz - parent_mz) <= 0.5 AND library_quality <= 2),
    b AS (SELECT spec_idx, CAST(floor(mz / 50 + 0.5) AS BIGINT) AS bin, sum(intensity) AS i FROM peaks GROUP BY ALL), u AS (SELECT spec_idx, bin, sqrt(i) / sqrt(sum(i) OVER (PARTITION BY spec_idx)) AS value FROM b),
    s AS (SELECT query, lib_idx, round(coalesce((SELECT sum(x.value * y.value) FROM u x JOIN u y ON x.bin = y.bin WHERE x.spec_idx = query AND y.spec_idx = lib_idx), 0), 6) AS score FROM c)
    SELECT query, lib_idx, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, lib_idx) AS INTEGER) AS hit FROM s WHERE score >= 0.1 QUALIFY hit <= 2"""
)
def library_search(spark, d):
    """Spectra against the library by their peaks; an entry's peaks are those of the spectrum with its number."""
    from ..operators import peaks as P

    q = V.spectra(spark, d).selectExpr("spec_idx query", "parent_mass query_mz")
    unit = P.transform_l2(P.bin_peaks(V.peaks(spark, d), 50.0), "sqrt")
    side = lambda name: unit.select(F.col("spec_idx").alias(name), "bin", F.col("intensity").alias("value"))
    return L.search(q, V.library(spark, d), side("query"), side("lib_idx"), 0.5, 2, 0.1, 2, 6)


@query(SEARCH + " SELECT query, lib_idx, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, lib_idx) AS INTEGER) AS hit FROM c WHERE score >= 0.6 QUALIFY hit <= 3")
def library_top_hits(spark, d):
    return L.top_hits(_searched(spark, d), 3, 0.6).select("query", "lib_idx", "score", "hit")


@query(
    SEARCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY query, is_decoy ORDER BY score DESC, lib_idx) AS r FROM c),
    g AS (SELECT query, coalesce(max(score) FILTER (NOT is_decoy AND r = 1), 0) AS t1, coalesce(max(score) FILTER (NOT is_decoy AND r = 2), 0) AS t2, coalesce(max(score) FILTER (is_decoy AND r = 1), 0) AS d1, coalesce(max(score) FILTER (is_decoy AND r = 2), 0) AS d2,
    max(lib_idx) FILTER (NOT is_decoy AND r = 1) AS ti, max(lib_idx) FILTER (is_decoy AND r = 1) AS di, max(dot_bias) FILTER (NOT is_decoy AND r = 1) AS tb, max(dot_bias) FILTER (is_decoy AND r = 1) AS db FROM r GROUP BY query)
    SELECT query, CASE WHEN t1 > d1 THEN ti ELSE di END AS lib_idx, t1 < d1 AS is_decoy, round(CASE WHEN t1 > d1 THEN t1 * 0.6 + (t1 - greatest(t2, d1)) * 0.4 - tb ELSE d1 * 0.6 + (d1 - greatest(t1, d2)) * 0.4 - db END, 6) AS score FROM g WHERE t1 > d1 AND ti IS NOT NULL OR t1 < d1 AND di IS NOT NULL"""
)
def library_target_or_decoy(spark, d):
    return L.target_or_decoy(_searched(spark, d), "bias").withColumn("score", F.round("score", 6))


@query(PSMS + TOP.format(more="") + CURVE + " SELECT round(k * 0.01::DOUBLE, 4) AS threshold, CAST((SELECT count(*) FROM q WHERE NOT is_decoy AND q <= k * 0.01 + 1e-11) AS BIGINT) AS hits FROM range(0, 61) t(k)")
def library_fdr_sweep(spark, d):
    s = L.fdr_sweep(M.concatenated_fdr(V.psms(spark, d)), 0.6, 0.01)
    return s.select(F.round("threshold", 4).alias("threshold"), F.col("hits").cast("long").alias("hits"))


@query(
    W("pairs") + """, s AS (SELECT spec1 % 50 AS g, spec1 AS a, spec2 AS b, score1 AS score FROM pairs), e AS (SELECT g, a AS member, score FROM s UNION ALL SELECT g, b, score FROM s), t AS (SELECT g, member, sum(score) AS total FROM e GROUP BY ALL)
    SELECT g AS "group", member, round(total, 6) AS total FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY total DESC, member) = 1"""
)
def library_representatives(spark, d):
    s = V.pairs(spark, d).selectExpr("spec1 % 50 as `group`", "spec1 a", "spec2 b", "score1 score")
    return L.representatives(s).withColumn("total", F.round("total", 6))


@query(W("peaks") + ', x AS (SELECT spec_idx % 100 AS g, spec_idx AS member, CAST(floor(mz / 50) AS BIGINT) AS position, intensity AS value FROM peaks), m AS (SELECT g, count(DISTINCT member) AS n FROM x GROUP BY g) SELECT x.g AS "group", position, round(sum(value) / n, 9) AS value FROM x JOIN m ON m.g = x.g GROUP BY x.g, position, n')
def library_average(spark, d):
    x = V.peaks(spark, d).select((F.col("spec_idx") % 100).alias("group"), F.col("spec_idx").alias("member"), F.floor(F.col("mz") / 50).alias("position"), F.col("intensity").alias("value"))
    return L.average_vectors(x).withColumn("value", F.round("value", 9))


@query(W("library") + ", n AS (SELECT lib_idx, parent_mz + 1 AS parent_mz, library_quality, compound_name, charge FROM library WHERE lib_idx % 10 = 0) SELECT * FROM n UNION ALL SELECT * FROM library WHERE lib_idx NOT IN (SELECT lib_idx FROM n)")
def library_upsert(spark, d):
    lib = V.library(spark, d)
    return L.upsert(lib, lib.where("lib_idx % 10 = 0").withColumn("parent_mz", F.col("parent_mz") + 1), ["lib_idx"])


@query(
    W("psms") + """ SELECT scan, psm_no, db_index, round(0.5 * exp(-0.1 * (power(p_value * 10 - 0.3, 2) + power(envelope * 10 - 0.2, 2))) - 0.8 * exp(-0.1 * (power(p_value * 10 - 0.9, 2) + power(envelope * 10 - 0.1, 2))) - 0.05, 6) AS svm,
    round(greatest(-1, least(1, -1 + 2 * (score - 20000) / 40000)), 9) AS scaled FROM psms"""
)
def library_svm(spark, d):
    features = F.array(F.col("p_value") * 10, F.col("envelope") * 10)
    svm = L.rbf_score(features, [[0.3, 0.2], [0.9, 0.1]], [0.5, -0.8], 0.1, 0.05)
    return V.psms(spark, d).select("scan", "psm_no", "db_index", F.round(svm, 6).alias("svm"), F.round(L.scale_feature(F.col("score"), 20000.0, 60000.0), 9).alias("scaled"))


@query(W("library") + " SELECT * FROM library WHERE CAST(charge AS VARCHAR) = '2' ORDER BY parent_mz, lib_idx LIMIT 25 OFFSET 50")
def report_page(spark, d):
    return R.page(V.library(spark, d), "parent_mz", 50, 25, "charge", "2", ties=["lib_idx"])


@query(W("library") + " SELECT * FROM library WHERE CAST(charge AS VARCHAR) = '3' ORDER BY lib_idx LIMIT 1")
def report_find(spark, d):
    return R.find(V.library(spark, d), "charge", "3", "lib_idx")


@query(W("library") + ", n AS (SELECT parent_mz, (row_number() OVER (ORDER BY parent_mz, lib_idx) - 1) // 37 AS page FROM library) SELECT CAST(page AS BIGINT) AS page, min(parent_mz) AS first, max(parent_mz) AS last FROM n GROUP BY page")
def report_page_ranges_of_ties(spark, d):
    return R.page_ranges(V.library(spark, d), "parent_mz", 37, "lib_idx")


@query(W("library") + ", n AS (SELECT lib_idx, (row_number() OVER (ORDER BY lib_idx) - 1) // 37 AS page FROM library) SELECT CAST(page AS BIGINT) AS page, min(lib_idx) AS first, max(lib_idx) AS last FROM n GROUP BY page")
def report_page_ranges(spark, d):
    return R.page_ranges(V.library(spark, d), "lib_idx", 37)


@query(W("library") + " SELECT lib_idx, parent_mz, library_quality, CASE WHEN charge = 1 THEN 'changed' ELSE compound_name END AS compound_name, charge FROM library")
def report_update(spark, d):
    return R.update(V.library(spark, d), F.col("charge") == 1, "compound_name", "changed")


@query(W("library") + " SELECT lib_idx, 'compound_name' AS \"column\", compound_name AS \"left\", 'changed' AS \"right\" FROM library WHERE charge = 1")
def report_differences(spark, d):
    lib = V.library(spark, d).drop("parent_mz")
    return R.differences(lib, R.update(lib, F.col("charge") == 1, "compound_name", "changed"), ["lib_idx"])


@query(W("spectra") + " SELECT CAST(floor((parent_mass - 500) / 100) AS BIGINT) AS bucket, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM spectra WHERE parent_mass >= 500 AND parent_mass < 2500 GROUP BY 1")
def report_histogram(spark, d):
    return R.histogram(V.spectra(spark, d), "parent_mass", 500.0, 2500.0, 20, True).select("bucket", F.round("share", 9).alias("share"))


@query(W("clusters") + " SELECT cluster_id, count(*) AS spectra, sum(precursor_intensity) AS precursor_intensity, " + ", ".join(f"count(*) FILTER (file_group = '{g}') AS group_{g}" for g in ("en", "fr", "de", "es")) + " FROM clusters GROUP BY cluster_id")
def report_cluster_summary(spark, d):
    return R.cluster_summary(V.clusters(spark, d), ["en", "fr", "de", "es"])


CONTIGS = "WITH c AS (SELECT l_suppkey AS prot_idx, l_orderkey AS contig, l_linenumber AS spectra, CAST(l_quantity AS INTEGER) AS length, l_partkey % 7 AS peptide FROM lineitem)"


def _contigs(spark, d):
    return V.table(spark, d, "lineitem").selectExpr("l_suppkey prot_idx", "l_orderkey contig", "l_linenumber spectra", "cast(l_quantity as int) length", "l_partkey % 7 peptide")


@query(CONTIGS + " SELECT prot_idx, count(*) AS contigs, CAST(sum(spectra) AS BIGINT) AS spectra, round(avg(spectra), 9) AS per_contig, max(length) AS longest, first(contig ORDER BY length DESC, contig) AS longest_contig, count(DISTINCT peptide) AS peptides FROM c GROUP BY ROLLUP (prot_idx)")
def report_project_stats(spark, d):
    return R.project_stats(_contigs(spark, d)).withColumn("per_contig", F.round("per_contig", 9))


@query(CONTIGS + ", p AS (SELECT s_suppkey AS prot_idx, s_name AS id FROM supplier), x AS (SELECT prot_idx, count(DISTINCT contig) AS contigs, CAST(sum(spectra) AS BIGINT) AS spectra FROM c WHERE length > 48 GROUP BY 1) SELECT p.prot_idx, id, contigs, spectra, p.prot_idx * 3 AS covered, round(p.prot_idx / 7.0::DOUBLE, 1) AS percent FROM p JOIN x ON x.prot_idx = p.prot_idx")
def report_proteins(spark, d):
    p = V.table(spark, d, "supplier").selectExpr("s_suppkey prot_idx", "s_name id")
    cover = p.selectExpr("prot_idx", "prot_idx * 3 covered", "prot_idx / 7.0D percent")
    return R.protein_table(_contigs(spark, d).where("length > 48"), p, cover)


@query("SELECT l_shipmode AS label, round(avg(CASE WHEN l_discount > 0.05 THEN 100.0 ELSE 0 END), 9) AS accuracy, count(*) AS calls FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1")
def report_accuracy(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_discount") > 0.05).alias("correct"))
    return R.accuracy_by(rows, "label").withColumn("accuracy", F.round("accuracy", 9))


ANN = W("peaks", "spectra") + ", a AS (SELECT spec_idx, mz, intensity, CASE peak_no % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'y' END AS ion, peak_no % 5 AS position FROM peaks), s AS (SELECT spec_idx, 8 AS length, parent_mass / 2 AS peptide_mass FROM spectra)"


def _annotated(spark, d):
    p = V.peaks(spark, d).selectExpr("spec_idx", "mz", "intensity", "case peak_no % 3 when 0 then 'b' when 1 then 'y' end ion", "peak_no % 5 position")
    return p, V.spectra(spark, d).selectExpr("spec_idx", "8 length", "parent_mass / 2 peptide_mass")


@query(
    ANN + """ SELECT a.spec_idx, round(coalesce(sum(intensity) FILTER (ion IS NOT NULL AND mz >= 57.0214637230 AND mz <= peptide_mass - 37), 0) / sum(intensity) FILTER (mz >= 57.0214637230 AND mz <= peptide_mass - 37) * 100, 4) AS explained_intensity,
    round(count(*) FILTER (ion IS NOT NULL AND mz >= 57.0214637230 AND mz <= peptide_mass - 37) / nullif(count(*) FILTER (mz >= 57.0214637230 AND mz <= peptide_mass - 37), 0) * 100, 4) AS explained_peaks,
    round(count(ion) * 100 / 14, 4) AS observed_ions, round(count(DISTINCT position) FILTER (ion IS NOT NULL) * 100 / 7, 4) AS observed_breaks, count(*) AS total_peaks FROM a JOIN s ON a.spec_idx = s.spec_idx GROUP BY a.spec_idx"""
)
def stats_annotation(spark, d):
    x = R.annotation_stats(*_annotated(spark, d), 2)
    return x.select("spec_idx", *[F.round(c, 4).alias(c) for c in ("explained_intensity", "explained_peaks", "observed_ions", "observed_breaks")], "total_peaks")


@query(ANN + " SELECT spec_idx, round(count(*) FILTER (ion = 'b') * 100 / count(*), 4) AS b_percent, round(count(*) FILTER (ion = 'y') * 100 / count(*), 4) AS y_percent, round(coalesce(sum(intensity) FILTER (ion IN ('b', 'y')), 0) * 100 / sum(intensity), 4) AS by_intensity FROM a GROUP BY spec_idx")
def stats_by_ions(spark, d):
    x = R.by_intensity(_annotated(spark, d)[0])
    return x.select("spec_idx", *[F.round(c, 4).alias(c) for c in ("b_percent", "y_percent", "by_intensity")])


@query(
    W("spectra") + """, m AS (SELECT spec_idx, parent_mass / parent_charge AS mz, parent_charge AS z, (parent_mass - 18.5 + 18.010564686 + parent_charge * 1.007825035) / parent_charge AS mono FROM spectra)
    SELECT spec_idx, round(CASE WHEN abs(mz - mono) > abs(mz - (mono + 1.007825035 / z)) THEN mz - (mono + 1.007825035 / z) ELSE mz - mono END / mono * 1e6, 4) AS ppm FROM m"""
)
def stats_parent_mass_error(spark, d):
    s = V.spectra(spark, d)
    return s.select("spec_idx", F.round(R.parent_mass_error_ppm(F.col("parent_mass") / F.col("parent_charge"), F.col("parent_mass") - 18.5, F.col("parent_charge")), 4).alias("ppm"))


@query(W("spectra") + " SELECT spec_idx, parent_mass, frag_type FROM spectra WHERE frag_type = 'O' UNION ALL SELECT spec_idx + 1000000, parent_mass, frag_type FROM spectra WHERE frag_type = 'F'")
def sets_append(spark, d):
    s = V.spectra(spark, d).select("spec_idx", "parent_mass", "frag_type")
    return M.merge_results(s.where("frag_type = 'O'"), s.where("frag_type = 'F'").withColumn("spec_idx", F.col("spec_idx") + 1_000_000))


@query(W("psms") + " SELECT db_index, charge FROM psms WHERE score > 50000 INTERSECT SELECT db_index, charge FROM psms WHERE is_decoy")
def sets_intersect(spark, d):
    p = V.psms(spark, d)
    return p.where("score > 50000").select("db_index", "charge").intersect(p.where("is_decoy").select("db_index", "charge"))


@query(W("psms") + " SELECT annotation_id FROM psms WHERE NOT is_decoy EXCEPT ALL SELECT annotation_id FROM psms WHERE is_decoy")
def sets_except_all(spark, d):
    p = V.psms(spark, d)
    return p.where("not is_decoy").select("annotation_id").exceptAll(p.where("is_decoy").select("annotation_id"))


MATCHES = W("spectra", "psms", "clusters") + ", m AS (SELECT scan AS spec_idx, annotation_id AS annotation, score FROM psms WHERE psm_no <= 2), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY spec_idx ORDER BY score DESC, annotation) = 1)"


def _matches(spark, d):
    return V.psms(spark, d).where("psm_no <= 2").selectExpr("scan spec_idx", "annotation_id annotation", "score")


@query(MATCHES + ", c AS (SELECT spec_idx, min(cluster_id) AS cluster_id FROM clusters GROUP BY 1) SELECT s.spec_idx, parent_mass, parent_charge, frag_type, cluster_id, annotation, score FROM spectra s LEFT JOIN c ON c.spec_idx = s.spec_idx LEFT JOIN t ON t.spec_idx = s.spec_idx")
def report_input_spectra(spark, d):
    return R.input_table(V.spectra(spark, d), V.clusters(spark, d), _matches(spark, d))


@query(MATCHES + ", x AS (SELECT DISTINCT cluster_id, spec_idx FROM clusters), y AS (SELECT x.*, annotation, score FROM x LEFT JOIN t ON t.spec_idx = x.spec_idx) SELECT cluster_id, count(*) AS spectra, count(score) AS matched, first(annotation ORDER BY score DESC NULLS LAST, annotation) AS annotation, max(score) AS score FROM y GROUP BY cluster_id")
def report_clusters(spark, d):
    return R.cluster_table(V.clusters(spark, d), _matches(spark, d))


@query(CONTIGS + ", p AS (SELECT s_suppkey AS prot_idx, s_name AS id FROM supplier) SELECT c.prot_idx, contig, CAST(sum(spectra) AS BIGINT) AS spectra, count(DISTINCT peptide) AS peptides, max(length) AS length, min(id) AS id FROM c LEFT JOIN p ON p.prot_idx = c.prot_idx GROUP BY 1, 2")
def report_contigs(spark, d):
    return R.contig_table(_contigs(spark, d), V.table(spark, d, "supplier").selectExpr("s_suppkey prot_idx", "s_name id"))
