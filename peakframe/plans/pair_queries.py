"""Queries on pairs of spectra and on their graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import pairs as Q
from . import views as V
from .registry import query

W = V.with_views
CAND = ", cand AS (SELECT a.spec_idx AS spec1, b.spec_idx AS spec2, b.parent_mass - a.parent_mass AS delta FROM spectra a JOIN spectra b ON a.spec_idx < b.spec_idx AND abs(a.parent_mass - b.parent_mass) <= 0.5)"


def _candidates(spark, d):
    return Q.candidate_pairs(V.spectra(spark, d), 0.0, 0.5)


def _listed(spark, d):
    """The same candidates with both peak lists."""
    return Q.candidate_pairs(Q.with_lists(V.spectra(spark, d), V.peaks(spark, d)), 0.0, 0.5, keep=("p",))


@query(W("spectra") + " SELECT a.spec_idx AS spec1, b.spec_idx AS spec2, round(b.parent_mass - a.parent_mass, 6) AS delta FROM spectra a JOIN spectra b ON a.spec_idx < b.spec_idx AND abs(a.parent_mass - b.parent_mass) <= 0.1")
def pairs_candidates(spark, d):
    return Q.candidate_pairs(V.spectra(spark, d), 0.0, 0.1).select("spec1", "spec2", F.round("delta", 6).alias("delta"))


@query(
    W("spectra") + """, j AS (SELECT * FROM (VALUES (57.0214637230::DOUBLE), (71.0371137870::DOUBLE), (99.068413915::DOUBLE)) t(jump)),
    x AS (SELECT a.spec_idx, a.parent_mass, a.parent_mass + jump * sign AS place, jump FROM spectra a, j, (VALUES (1), (-1)) t(sign))
    SELECT DISTINCT least(x.spec_idx, b.spec_idx) AS spec1, greatest(x.spec_idx, b.spec_idx) AS spec2, jump FROM x JOIN spectra b ON b.parent_mass BETWEEN place - 0.020001 AND place + 0.020001 AND x.spec_idx <> b.spec_idx"""
)
def pairs_jumps(spark, d):
    return Q.jump_pairs(V.spectra(spark, d), [57.0214637230, 71.0371137870, 99.068413915], 0.01)


MATCH = CAND + ", m AS (SELECT spec1, spec2, delta, a.peak_no AS i, b.peak_no AS j, a.mz AS mz1, b.mz AS mz2, a.intensity AS int1, b.intensity AS int2 FROM cand JOIN peaks a ON a.spec_idx = spec1 JOIN peaks b ON b.spec_idx = spec2)"


@query(W("spectra", "peaks") + MATCH + " SELECT spec1, spec2, i, j, round(mz1, 6) AS mz1, round(mz2, 6) AS mz2 FROM m WHERE abs(mz1 - mz2) <= 20.000001")
def pairs_matched_peaks(spark, d):
    return Q.matched_peaks(V.peaks(spark, d), _listed(spark, d), 20.0).select("spec1", "spec2", "i", "j", F.round("mz1", 6).alias("mz1"), F.round("mz2", 6).alias("mz2"))


@query(W("spectra", "peaks") + MATCH + " SELECT spec1, spec2, i, j, round(mz1, 6) AS mz1, round(mz2, 6) AS mz2 FROM m WHERE abs(mz1 - (mz2 + delta)) <= 20.000001")
def pairs_matched_shifted(spark, d):
    return Q.matched_within(V.peaks(spark, d), V.spectra(spark, d), 0.5, 20.0, 6)


@query(
    W("spectra", "peaks") + CAND + """ SELECT spec1, spec2, 1 AS side, a.peak_no AS peak, round(a.mz, 6) AS mz FROM cand JOIN peaks a ON a.spec_idx = spec1 WHERE EXISTS (SELECT 1 FROM peaks b WHERE b.spec_idx = spec2 AND abs(a.mz - b.mz) <= 20.000001)
    UNION ALL SELECT spec1, spec2, 2, b.peak_no, round(b.mz, 6) FROM cand JOIN peaks b ON b.spec_idx = spec2 WHERE EXISTS (SELECT 1 FROM peaks a WHERE a.spec_idx = spec1 AND abs(a.mz - b.mz) <= 20.000001)"""
)
def pairs_peaks_with_partner(spark, d):
    return Q.peaks_with_partner(V.peaks(spark, d), _candidates(spark, d), 20.0).select("spec1", "spec2", "side", "peak", F.round("mz", 6).alias("mz"))


@query()
def pairs_greedy_cosine(spark, d):
    from ..operators import peaks as P

    unit = P.transform_l2(V.peaks(spark, d), "sqrt")
    return Q.cosine_pairs(unit, V.spectra(spark, d), 0.1, 0.05, 20.0, 0.2, 2)


BINS = ", b AS (SELECT spec_idx, CAST(floor(mz / 10.0 + 0.5) AS BIGINT) AS bin, sum(intensity) AS i FROM peaks GROUP BY ALL), u AS (SELECT spec_idx, bin, sqrt(i) / sqrt(sum(i) OVER (PARTITION BY spec_idx)) AS value FROM b)"


def _binned(spark, d):
    from ..operators import peaks as P

    return P.transform_l2(P.bin_peaks(V.peaks(spark, d), 10.0), "sqrt").withColumnRenamed("intensity", "value")


@query(W("spectra", "peaks") + CAND + BINS + " SELECT spec1, spec2, round(sum(x.value * y.value), 6) AS cosine, count(*) AS shared FROM cand JOIN u x ON x.spec_idx = spec1 JOIN u y ON y.spec_idx = spec2 AND x.bin = y.bin GROUP BY ALL")
def pairs_full_cosine(spark, d):
    return Q.full_cosine_within(_binned(spark, d), V.spectra(spark, d), 0.5).select("spec1", "spec2", F.round("cosine", 6).alias("cosine"), "shared")


@query(
    W("spectra", "peaks") + CAND + BINS + """, x AS (SELECT spec1, spec2, sqrt(sum(power(x.value * y.value, 2))) / sum(x.value * y.value) AS share FROM cand JOIN u x ON x.spec_idx = spec1 JOIN u y ON y.spec_idx = spec2 AND x.bin = y.bin GROUP BY ALL)
    SELECT spec1, spec2, round(share, 6) AS share, CASE WHEN share < 0.1 OR share > 0.35 AND share <= 0.4 THEN 0.12 WHEN share > 0.4 AND share <= 0.45 THEN 0.18 WHEN share > 0.45 THEN 0.24 ELSE 0 END::DOUBLE AS bias FROM x"""
)
def pairs_dot_bias(spark, d):
    return Q.dot_bias_within(_binned(spark, d), V.spectra(spark, d), 0.5).select("spec1", "spec2", F.round("share", 6).alias("share"), "bias")


SHIFTS = ", h AS (SELECT spec1, spec2, CAST(floor((mz1 - mz2) / 10.0 + 0.5) AS BIGINT) AS shift, count(*) AS matches, sum(int1 * int2) AS score FROM m GROUP BY ALL HAVING count(*) >= 2)"


@query(W("spectra", "peaks") + MATCH + SHIFTS + " SELECT spec1, spec2, shift, matches, score FROM h")
def pairs_all_shifts(spark, d):
    return Q.shifts_within(V.peaks(spark, d), V.spectra(spark, d), 0.5, 10.0, 2)


@query(W("spectra", "peaks") + MATCH + SHIFTS + " SELECT spec1, spec2, shift, matches, score FROM h QUALIFY row_number() OVER (PARTITION BY spec1, spec2 ORDER BY score DESC, abs(shift), shift) = 1")
def pairs_best_shift(spark, d):
    return Q.shifts_within(V.peaks(spark, d), V.spectra(spark, d), 0.5, 10.0, 2, best=True)


MEANS = ", e AS (SELECT spec1 AS spec_idx, score1 AS s FROM pairs UNION ALL SELECT spec2, score2 FROM pairs), st AS (SELECT spec_idx, count(*) AS n, avg(s) AS mean, sqrt(greatest(0, avg(s * s) - power(avg(s), 2))) AS sd FROM e GROUP BY ALL)"


@query(W("pairs") + MEANS + " SELECT spec_idx, n, round(mean, 9) AS mean, round(sd, 5) AS sd FROM st")
def pairs_score_means(spark, d):
    return Q.score_means(V.pairs(spark, d)).select("spec_idx", "n", F.round("mean", 9).alias("mean"), F.round("sd", 5).alias("sd"))


def _phi(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    tail = f"0.39894228::DOUBLE * exp(-{z} * {z} / 2) * {t} * (((((1.330274429::DOUBLE * {t}) - 1.821255978) * {t} + 1.781477937) * {t} - 0.356563782) * {t} + 0.319381530)"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


PVAL = MEANS + f""", z AS (SELECT p.*, (score1 - a.mean) / a.sd AS z1, (score2 - b.mean) / b.sd AS z2 FROM pairs p JOIN st a ON a.spec_idx = spec1 JOIN st b ON b.spec_idx = spec2 WHERE a.sd >= 1e-6 AND b.sd >= 1e-6),
pv AS (SELECT *, 1 - ({_phi('z1')}) AS p1, 1 - ({_phi('z2')}) AS p2 FROM z)"""


@query(W("pairs") + PVAL + " SELECT spec1, spec2, round(p1, 5) AS p1, round(p2, 5) AS p2 FROM pv")
def pairs_p_values(spark, d):
    p = V.pairs(spark, d)
    return Q.p_values(p, Q.score_means(p)).select("spec1", "spec2", F.round("p1", 5).alias("p1"), F.round("p2", 5).alias("p2"))


@query(W("pairs") + PVAL + " SELECT spec1, spec2 FROM pv WHERE p1 <= 0.4 AND p2 <= 0.4")
def pairs_filter_aligns(spark, d):
    p = V.pairs(spark, d)
    return Q.filter_aligns(p, Q.score_means(p), 0.4).select("spec1", "spec2")


RATIO = ", ".join(
    f"(SELECT coalesce(sum(intensity) FILTER (mz > 56 AND mz <= o - 56 OR mz > greatest(pm{k} - o + 56, o - 56) AND mz <= pm{k} - 56), 0) FROM peaks WHERE spec_idx = spec{k}) AS t{k}" for k in (1, 2)
)


@query(
    W("pairs", "peaks", "spectra") + f""", x AS (SELECT p.*, a.parent_mass AS pm1, b.parent_mass AS pm2, least(a.parent_mass, b.parent_mass) AS o FROM pairs p JOIN spectra a ON a.spec_idx = spec1 JOIN spectra b ON b.spec_idx = spec2), y AS (SELECT *, {RATIO} FROM x)
    SELECT spec1, spec2, round(greatest(0, CASE WHEN t1 - score1 > 1 THEN score1 / (t1 - score1) ELSE 1 END), 6) AS ratio1, round(greatest(0, CASE WHEN t2 - score2 > 1 THEN score2 / (t2 - score2) ELSE 1 END), 6) AS ratio2 FROM y"""
)
def pairs_match_ratios(spark, d):
    r = Q.match_ratios(V.pairs(spark, d), V.peaks(spark, d), V.spectra(spark, d))
    return r.select("spec1", "spec2", F.round("ratio1", 6).alias("ratio1"), F.round("ratio2", 6).alias("ratio2"))


@query(W("spectra") + " SELECT a.spec_idx AS light, b.spec_idx AS heavy, 8.0142::DOUBLE AS label FROM spectra a JOIN spectra b ON a.parent_charge = b.parent_charge AND abs(b.parent_mass - 8.0142 - a.parent_mass) <= 0.050001")
def pairs_silac(spark, d):
    return Q.silac_pairs(V.spectra(spark, d), [8.0142], 0.05)


@query(
    W("pairs") + """, p AS (SELECT s_suppkey AS spec_idx, s_nationkey AS peptide, s_suppkey % 3 AS charge, s_suppkey % 7 AS first, s_suppkey % 7 + 5 + s_suppkey % 4 AS last FROM supplier),
    t AS (SELECT a.spec_idx AS spec1, b.spec_idx AS spec2, least(a.last, b.last) - greatest(a.first, b.first) + 1 AS overlap FROM p a JOIN p b ON a.peptide = b.peptide AND a.charge = b.charge AND a.spec_idx < b.spec_idx)
    SELECT CAST((overlap >= 4)::INT + (overlap >= 6)::INT AS INTEGER) AS class, count(*) AS pairs, count(*) FILTER ((spec1 + spec2) % 3 = 0) AS detected, round(count(*) FILTER ((spec1 + spec2) % 3 = 0) / count(*), 9) AS sensitivity FROM t WHERE overlap > 0 GROUP BY 1"""
)
def pairs_quality(spark, d):
    p = V.table(spark, d, "supplier").selectExpr("s_suppkey spec_idx", "s_nationkey peptide", "s_suppkey % 3 charge", "s_suppkey % 7 first", "s_suppkey % 7 + 5 + s_suppkey % 4 last")
    a, b = p.select(F.col("spec_idx").alias("spec1"), "peptide", "charge"), p.select(F.col("spec_idx").alias("spec2"), "peptide", "charge")
    detected = a.join(b, ["peptide", "charge"]).where("spec1 < spec2 and (spec1 + spec2) % 3 = 0").select("spec1", "spec2")
    return Q.quality_of_pairs(p, detected, [4, 6]).withColumn("sensitivity", F.round("sensitivity", 9))


@query(
    W("peaks") + """, a AS (SELECT CAST(floor(mz / 0.01 + 0.5) AS BIGINT) AS bin, sum(intensity) AS int1 FROM peaks WHERE spec_idx % 2 = 0 GROUP BY 1), b AS (SELECT CAST(floor(mz / 0.01 + 0.5) AS BIGINT) AS bin, sum(intensity) AS int2 FROM peaks WHERE spec_idx % 2 = 1 GROUP BY 1)
    SELECT a.bin, int1, int2 FROM a JOIN b ON a.bin = b.bin"""
)
def pairs_binned_match(spark, d):
    p = V.peaks(spark, d)
    return Q.binned_match(p.where("spec_idx % 2 = 0"), p.where("spec_idx % 2 = 1"), 0.01)


TAGS = ", t AS (SELECT spec_idx, CAST(floor(mz / 0.5::DOUBLE) AS BIGINT) AS tag FROM peaks)"


@query(W("peaks") + TAGS + " SELECT a.spec_idx AS spec1, b.spec_idx AS spec2, count(*) AS common FROM t a JOIN t b ON a.tag = b.tag AND a.spec_idx < b.spec_idx GROUP BY ALL HAVING count(*) >= 2")
def pairs_common_tags(spark, d):
    return Q.tag_pairs(V.peaks(spark, d).select("spec_idx", F.floor(F.col("mz") / 0.5).alias("tag")), 2)


REACH = ", e AS (SELECT spec1 AS u, spec2 AS v FROM pairs WHERE score1 > 0.8 UNION SELECT spec2, spec1 FROM pairs WHERE score1 > 0.8), r(node, reached) AS (SELECT u, u FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reached), cc AS (SELECT node, min(reached) AS component FROM r GROUP BY node)"


#: Option of the graph operators here: edges count from this score on.
LEAST = 0.8


def _strong(spark, d):
    return G.strong_edges(V.pairs(spark, d), LEAST)


@query(W("pairs") + REACH + " SELECT component, count(*) AS nodes FROM cc GROUP BY component")
def graph_component_sizes(spark, d):
    return G.component_sizes(_strong(spark, d))


@query(W("pairs") + REACH + ", big AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS s FROM cc GROUP BY component HAVING count(*) >= 4) SELECT node, coalesce(s, -1) AS set FROM cc LEFT JOIN big ON cc.component = big.component")
def graph_merge_sets(spark, d):
    return G.merge_sets(_strong(spark, d), 4)


@query(W("pairs") + REACH + ", big AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS s FROM cc GROUP BY component HAVING count(*) >= 4) SELECT spec1, spec2, s AS set FROM pairs JOIN cc ON node = spec1 JOIN big ON cc.component = big.component WHERE score1 > 0.8")
def graph_split_by_set(spark, d):
    e = _strong(spark, d)
    return G.split_by_set(e, G.merge_sets(e, 4)).select("spec1", "spec2", "set")


@query()
def graph_cap_component(spark, d):
    return G.cap_component_size(_strong(spark, d).select("spec1", "spec2", "score1"), 6)


@query(
    "WITH u AS (SELECT l_orderkey AS spec1, l_orderkey + l_linenumber AS spec2, min(l_quantity) - 25 AS shift1, max(l_discount) * 100 AS shift2 FROM lineitem GROUP BY 1, 2)" + """, t AS (SELECT ab.spec1 AS a, ab.spec2 AS b, bc.spec2 AS c, [ab.shift1, ab.shift2] AS x, [bc.shift1, bc.shift2] AS y, [ac.shift1, ac.shift2] AS z FROM u ab JOIN u bc ON ab.spec2 = bc.spec1 JOIN u ac ON ac.spec1 = ab.spec1 AND ac.spec2 = bc.spec2),
    l AS (SELECT *, CASE WHEN abs(x[1]) > abs(x[2]) THEN x[1] ELSE x[2] END AS lx, CASE WHEN abs(y[1]) > abs(y[2]) THEN y[1] ELSE y[2] END AS ly, CASE WHEN abs(z[1]) > abs(z[2]) THEN z[1] ELSE z[2] END AS lz FROM t),
    o AS (SELECT a, b, c, CASE WHEN abs(lx) >= abs(ly) AND abs(lx) >= abs(lz) THEN [lx] WHEN abs(ly) >= abs(lz) THEN [ly] ELSE [lz] END AS m, CASE WHEN abs(lx) >= abs(ly) AND abs(lx) >= abs(lz) THEN y WHEN abs(ly) >= abs(lz) THEN x ELSE x END AS p, CASE WHEN abs(lx) >= abs(ly) AND abs(lx) >= abs(lz) THEN z WHEN abs(ly) >= abs(lz) THEN z ELSE y END AS q FROM l),
    ok AS (SELECT * FROM o WHERE abs(m[1] - p[1] - q[1]) <= 0.5 OR abs(m[1] - p[1] - q[2]) <= 0.5 OR abs(m[1] - p[2] - q[1]) <= 0.5 OR abs(m[1] - p[2] - q[2]) <= 0.5)
    SELECT a AS spec1, b AS spec2 FROM ok UNION SELECT b, c FROM ok UNION SELECT a, c FROM ok"""
)
def graph_triangles(spark, d):
    rows = V.table(spark, d, "lineitem").selectExpr("l_orderkey spec1", "l_orderkey + l_linenumber spec2", "l_quantity", "l_discount")
    u = rows.groupBy("spec1", "spec2").agg((F.min("l_quantity") - 25).alias("shift1"), (F.max("l_discount") * 100).alias("shift2"))
    return G.filter_triangles(u, 0.5).select("spec1", "spec2")


@query(
    W("pairs") + """, n AS (SELECT spec1 AS node, score1 FROM pairs UNION ALL SELECT spec2, score1 FROM pairs), c AS (SELECT node, min(score1) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score1 DESC) AS r FROM n) WHERE r <= 1 GROUP BY node)
    SELECT p.* FROM pairs p JOIN c a ON a.node = spec1 JOIN c b ON b.node = spec2 WHERE score1 >= a.cut AND score1 >= b.cut AND abs(shift1) >= 10"""
)
def graph_top_k_edges(spark, d):
    return G.top_k_edges(V.pairs(spark, d), 1, True, least_shift=10.0)


@query(W("pairs") + " SELECT * FROM pairs WHERE score1 > 0.5 AND (spec1, spec2) IN (SELECT (spec1, spec2) FROM pairs WHERE score2 > 0.5)")
def graph_intersect_pairs(spark, d):
    p = V.pairs(spark, d)
    return G.intersect_pairs(p.where("score1 > 0.5"), p.where("score2 > 0.5"))


@query(W("pairs") + ", n AS (SELECT DISTINCT spec2 FROM pairs) SELECT spec2 AS value, row_number() OVER (ORDER BY spec2) - 1 AS index FROM n")
def graph_renumber(spark, d):
    return G.renumber(V.pairs(spark, d), "spec2")
