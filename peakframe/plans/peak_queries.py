"""Queries on peak lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peaks as P
from . import views as V
from .registry import query

W = V.with_views
PEAKS = W("peaks")


def _r(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query(PEAKS + " SELECT spec_idx, peak_no, round(mz, 6) AS mz, round(intensity * 100.0 / sum(intensity) OVER (PARTITION BY spec_idx), 6) AS intensity FROM peaks")
def peaks_normalize_total(spark, d):
    return P.normalize_total(V.peaks(spark, d)).select("spec_idx", "peak_no", *_r("mz", "intensity"))


@query(PEAKS + " SELECT spec_idx, peak_no, round(mz, 6) AS mz, round(intensity / sqrt(sum(intensity * intensity) OVER (PARTITION BY spec_idx)), 6) AS intensity FROM peaks")
def peaks_normalize_l2(spark, d):
    return P.normalize_l2(V.peaks(spark, d)).select("spec_idx", "peak_no", *_r("mz", "intensity"))


@query(PEAKS + " SELECT spec_idx, peak_no, round(sqrt(intensity) / sqrt(sum(intensity) OVER (PARTITION BY spec_idx)), 6) AS intensity FROM peaks")
def peaks_sqrt_l2(spark, d):
    return P.transform_l2(V.peaks(spark, d), "sqrt").select("spec_idx", "peak_no", *_r("intensity"))


@query(PEAKS + " SELECT spec_idx, peak_no, round(intensity / max(intensity) OVER (PARTITION BY spec_idx), 6) AS intensity FROM peaks")
def peaks_normalize_max(spark, d):
    return P.normalize_max(V.peaks(spark, d)).select("spec_idx", "peak_no", *_r("intensity"))


@query(W("dense_peaks") + " SELECT spec_idx, round(sum(intensity), 6) AS tic FROM dense_peaks GROUP BY spec_idx")
def peaks_total_ion_current(spark, d):
    return P.total_ion_current(V.dense_peaks(spark, d)).select("spec_idx", *_r("tic"))


@query(W("peaks", "spectra") + " SELECT s.spec_idx, round(count(p.spec_idx) / s.parent_mass, 6) AS density FROM spectra s LEFT JOIN peaks p ON p.spec_idx = s.spec_idx GROUP BY s.spec_idx, s.parent_mass")
def peaks_density(spark, d):
    return P.peak_density(V.peaks(spark, d), V.spectra(spark, d)).select("spec_idx", *_r("density"))


@query(PEAKS + " SELECT spec_idx, CAST(floor(mz / 1.0005 + 0.5) AS BIGINT) AS bin, round(sum(intensity), 6) AS intensity FROM peaks GROUP BY ALL")
def peaks_bin(spark, d):
    return P.bin_peaks(V.peaks(spark, d), 1.0005).select("spec_idx", "bin", *_r("intensity"))


@query(PEAKS + " SELECT spec_idx, peak_no, floor(mz + 0.5) AS mz, intensity FROM peaks")
def peaks_round(spark, d):
    return P.round_peaks(V.peaks(spark, d))


@query(PEAKS + " SELECT * FROM peaks WHERE intensity >= 25")
def peaks_min_intensity(spark, d):
    return P.min_intensity(V.peaks(spark, d), 25.0)


@query(PEAKS + ", least AS (SELECT *, min(mz) OVER (PARTITION BY spec_idx) AS low FROM peaks WHERE mz >= 57.0214637230) SELECT spec_idx, peak_no, mz, intensity FROM least WHERE mz <= 500 OR mz = low")
def peaks_mass_range(spark, d):
    return P.mass_range(V.peaks(spark, d), 57.0214637230, 500.0)


@query(PEAKS + " SELECT * FROM peaks QUALIFY count(*) OVER (PARTITION BY spec_idx) >= 5")
def peaks_min_peaks(spark, d):
    return P.min_peaks(V.peaks(spark, d), 5)


@query(PEAKS + " SELECT * FROM peaks QUALIFY row_number() OVER (PARTITION BY spec_idx ORDER BY intensity DESC, mz, peak_no) <= 3")
def peaks_top_k(spark, d):
    return P.top_k(V.peaks(spark, d), 3)


@query(PEAKS + " SELECT * FROM peaks QUALIFY row_number() OVER (PARTITION BY spec_idx, floor(mz / 200) ORDER BY intensity DESC, mz, peak_no) <= 1")
def peaks_bucket_top_k(spark, d):
    return P.bucket_top_k(V.peaks(spark, d), 200.0, 1)


@query(
    PEAKS + """ SELECT spec_idx, peak_no, mz, intensity FROM peaks p WHERE (SELECT count(*) FROM peaks q WHERE q.spec_idx = p.spec_idx AND q.mz >= p.mz - 100 AND q.mz < p.mz + 100
    AND (q.intensity > p.intensity OR q.intensity = p.intensity AND q.mz > p.mz)) < 2"""
)
def peaks_window_top_k(spark, d):
    return P.window_top_k(V.peaks(spark, d), -100.0, 100.0, 2)


@query(PEAKS + " SELECT spec_idx, peak_no, mz, intensity FROM peaks p WHERE (SELECT count(DISTINCT q.intensity) FROM peaks q WHERE q.spec_idx = p.spec_idx AND abs(q.mz - p.mz) < 100 AND q.intensity > p.intensity) < 2")
def peaks_rank_filter(spark, d):
    return P.rank_filter(V.peaks(spark, d), 100.0, 2)


@query(
    W("dense_peaks") + """, r AS (SELECT *, row_number() OVER (PARTITION BY spec_idx ORDER BY intensity, mz, peak_no) AS rn, count(*) OVER (PARTITION BY spec_idx) AS n FROM dense_peaks),
    b AS (SELECT spec_idx, avg(intensity) + 2 * stddev_pop(intensity) AS bar FROM r WHERE rn <= n // 4 AND n >= 10 GROUP BY spec_idx)
    SELECT r.spec_idx, peak_no, mz, round(intensity, 6) AS intensity FROM r LEFT JOIN b ON r.spec_idx = b.spec_idx WHERE bar IS NULL OR intensity > bar"""
)
def peaks_noise_filter(spark, d):
    return P.noise_filter(V.dense_peaks(spark, d), 2.0).select("spec_idx", "peak_no", "mz", *_r("intensity"))


@query(W("peaks", "spectra") + " SELECT p.* FROM peaks p JOIN spectra s ON p.spec_idx = s.spec_idx WHERE mz <= parent_mass / parent_charge - 17 OR mz >= parent_mass / parent_charge + 15")
def peaks_precursor_filter(spark, d):
    return P.precursor_filter(V.peaks(spark, d), V.spectra(spark, d))


@query(
    W("peaks", "spectra") + """, r AS (SELECT *, row_number() OVER (PARTITION BY spec_idx ORDER BY intensity, mz, peak_no) - 1 AS rn, count(*) OVER (PARTITION BY spec_idx) AS n FROM peaks),
    m AS (SELECT spec_idx, intensity AS med FROM r WHERE rn = n // 2)
    SELECT r.spec_idx, peak_no, mz, intensity FROM r JOIN m ON r.spec_idx = m.spec_idx JOIN spectra s ON s.spec_idx = r.spec_idx
    WHERE NOT (intensity >= 0.5 * med AND EXISTS (SELECT 1 FROM range(1, 5) t(z) WHERE z <= parent_charge AND abs(mz - (parent_mass + (z - 1) * 1.007825035) / z) <= 50))"""
)
def peaks_charge_reduced(spark, d):
    return P.charge_reduced_filter(V.peaks(spark, d), V.spectra(spark, d), 50.0, 0.5)


@query(W("peaks", "spectra") + " SELECT p.spec_idx, peak_no, round(parent_mass - 1.007825035 - mz, 6) AS mz, intensity FROM peaks p JOIN spectra s ON p.spec_idx = s.spec_idx")
def peaks_reverse(spark, d):
    return P.reverse_peaks(V.peaks(spark, d), V.spectra(spark, d)).select("spec_idx", "peak_no", *_r("mz"), "intensity")


@query(W("peaks", "spectra") + " SELECT p.spec_idx, peak_no, round((mz + 100) - parent_mass * floor((mz + 100) / parent_mass), 4) AS mz, intensity FROM peaks p JOIN spectra s ON p.spec_idx = s.spec_idx")
def peaks_rotate(spark, d):
    return P.rotate_peaks(V.peaks(spark, d), V.spectra(spark, d), 100.0).select("spec_idx", "peak_no", F.round("mz", 4).alias("mz"), "intensity")


@query(
    W("peaks", "spectra") + """ SELECT a.spec_idx, round(a.mz, 6) AS mz, a.intensity, round(b.mz, 6) AS mz2, b.intensity AS intensity2 FROM peaks a JOIN peaks b ON a.spec_idx = b.spec_idx
    JOIN spectra s ON s.spec_idx = a.spec_idx WHERE abs(a.mz + b.mz - (parent_mass - 1.007825035)) <= 20.000001 AND a.mz <= b.mz"""
)
def peaks_symmetric_pairs(spark, d):
    return P.symmetric_pairs(V.peaks(spark, d), V.spectra(spark, d), 20.0).select("spec_idx", *_r("mz"), "intensity", *_r("mz2"), "intensity2")


@query(
    W("peaks", "spectra") + """, need AS (SELECT DISTINCT p.spec_idx, parent_mass - 1.007825035 - mz AS c FROM peaks p JOIN spectra s ON p.spec_idx = s.spec_idx WHERE parent_mass - 1.007825035 - mz >= 0)
    SELECT spec_idx, round(mz, 6) AS mz, intensity FROM peaks UNION ALL
    SELECT spec_idx, round(c, 6), 0.0 FROM need n WHERE NOT EXISTS (SELECT 1 FROM peaks q WHERE q.spec_idx = n.spec_idx AND abs(q.mz - n.c) <= 20.000001)"""
)
def peaks_make_symmetric(spark, d):
    return P.make_symmetric(V.peaks(spark, d), V.spectra(spark, d), 20.0).select("spec_idx", *_r("mz"), "intensity")


@query(
    W("peaks", "spectra") + """, e AS (SELECT spec_idx, unnest([0.0::DOUBLE, parent_mass - 1.007825035 - 18.010564686]) AS e FROM spectra)
    SELECT spec_idx, round(mz, 6) AS mz, intensity FROM peaks UNION ALL
    SELECT spec_idx, round(e, 6), 0.1 FROM e WHERE NOT EXISTS (SELECT 1 FROM peaks q WHERE q.spec_idx = e.spec_idx AND abs(q.mz - e.e) <= 15.000001)"""
)
def peaks_add_endpoints(spark, d):
    return P.add_endpoints(V.peaks(spark, d), V.spectra(spark, d), 15.0).select("spec_idx", *_r("mz"), "intensity")


@query(
    W("peaks", "spectra") + """ SELECT p.spec_idx, peak_no, mz, CASE WHEN mz <= 100 OR abs(mz - (parent_mass - 1.007825035 - 18.010564686)) <= 100 THEN max(intensity) OVER (PARTITION BY p.spec_idx) ELSE intensity END AS intensity
    FROM peaks p JOIN spectra s ON p.spec_idx = s.spec_idx"""
)
def peaks_maximize_endpoints(spark, d):
    return P.maximize_endpoints(V.peaks(spark, d), V.spectra(spark, d), 100.0)


@query(PEAKS + " SELECT spec_idx, peak_no, mz, intensity, round(mz * 20 * 1e-6, 9) AS tol FROM peaks")
def peaks_ppm_tolerance(spark, d):
    return P.ppm_tolerance(V.peaks(spark, d), 20.0).withColumn("tol", F.round("tol", 9))


@query(W("peaks", "spectra") + " SELECT p.spec_idx, peak_no, round(mz * parent_charge - (parent_charge - 1) * 1.007825035, 6) AS mz, intensity FROM peaks p JOIN spectra s ON p.spec_idx = s.spec_idx")
def peaks_to_charge_one(spark, d):
    joined = V.peaks(spark, d).join(V.spectra(spark, d).select("spec_idx", "parent_charge"), "spec_idx")
    return P.to_charge_one(joined, F.col("parent_charge")).select("spec_idx", "peak_no", *_r("mz"), "intensity")


@query(
    W("peaks", "spectra") + """, t AS (SELECT spec_idx, parent_mass / 2 AS target FROM spectra)
    SELECT t.spec_idx, round(target, 6) AS target, round(mz, 6) AS mz, round(abs(mz - target), 6) AS gap FROM t JOIN peaks p ON p.spec_idx = t.spec_idx
    QUALIFY row_number() OVER (PARTITION BY t.spec_idx, target ORDER BY abs(mz - target), mz, intensity) = 1"""
)
def peaks_closest(spark, d):
    targets = V.spectra(spark, d).select("spec_idx", (F.col("parent_mass") / 2).alias("target"))
    return P.closest_peak(V.peaks(spark, d), targets).select("spec_idx", *_r("target", "mz", "gap"))


@query(
    W("peaks", "spectra") + """ SELECT s.spec_idx, round(parent_mass / 3, 6) AS target, peak_no, round(mz, 6) AS mz, intensity FROM spectra s JOIN peaks p ON p.spec_idx = s.spec_idx WHERE abs(parent_mass / 3 - mz) <= 50.000001"""
)
def peaks_find_in_range(spark, d):
    targets = V.spectra(spark, d).select("spec_idx", (F.col("parent_mass") / 3).alias("target"))
    return P.find_in_range(V.peaks(spark, d), targets, 50.0).select("spec_idx", *_r("target"), "peak_no", *_r("mz"), "intensity")


@query(
    PEAKS + """, n AS (SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY spec_idx ORDER BY mz, peak_no) <= 30 THEN 0 ELSE 1 END AS new FROM peaks),
    g AS (SELECT *, sum(new) OVER (PARTITION BY spec_idx ORDER BY mz, peak_no ROWS UNBOUNDED PRECEDING) AS run FROM n),
    x AS (SELECT *, row_number() OVER (PARTITION BY spec_idx, run ORDER BY intensity DESC, mz) AS rn, sum(intensity) OVER (PARTITION BY spec_idx, run) AS total FROM g)
    SELECT spec_idx, round(mz, 6) AS mz, round(total, 6) AS intensity FROM x WHERE rn = 1"""
)
def peaks_consolidate(spark, d):
    return P.consolidate(V.peaks(spark, d), 30.0).select("spec_idx", *_r("mz", "intensity"))


@query(PEAKS + " SELECT spec_idx, round(sum(mz * intensity) / sum(intensity), 2) AS mz, round(sum(intensity), 2) AS intensity FROM peaks GROUP BY spec_idx")
def peaks_weighted_average(spark, d):
    return P.weighted_average(V.peaks(spark, d), ["spec_idx"]).select("spec_idx", F.round("mz", 2).alias("mz"), F.round("intensity", 2).alias("intensity"))


@query(PEAKS + " SELECT spec_idx, round(first(mz ORDER BY intensity DESC, mz), 6) AS mz, round(sum(intensity), 6) AS intensity FROM peaks GROUP BY spec_idx")
def peaks_merge_most_intense(spark, d):
    return P.merge_ranges(V.peaks(spark, d), ["spec_idx"], "intense").select("spec_idx", *_r("mz", "intensity"))


@query(
    W("peaks", "spectra") + """, t AS (SELECT spec_idx, k AS part, parent_mass / k AS mono, i AS isotope, parent_mass / k + i * 1.007825035 / parent_charge AS target FROM spectra, range(0, 3) r(i), range(4, 6) q(k))
    SELECT t.spec_idx, round(mono, 6) AS mono, CAST(isotope AS INTEGER) AS isotope, round(coalesce(sum(intensity), 0), 6) AS intensity FROM t LEFT JOIN peaks p ON p.spec_idx = t.spec_idx AND abs(target - mz) <= 10.000001 GROUP BY t.spec_idx, mono, isotope"""
)
def peaks_envelope(spark, d):
    precursors = V.spectra(spark, d).select("spec_idx", F.explode(F.array(F.col("parent_mass") / 4, F.col("parent_mass") / 5)).alias("mono"), F.col("parent_charge").alias("charge"))
    return P.envelope(V.peaks(spark, d), precursors, 3, 10.0).select("spec_idx", F.round("mono", 6).alias("mono"), "isotope", *_r("intensity"))


@query(
    W("peaks", "spectra") + """, ions AS (SELECT * FROM (VALUES ('b', 1.0073::DOUBLE, 0.8::DOUBLE), ('y', 19.0184::DOUBLE, 0.85::DOUBLE), ('b-h2o', -17.0033::DOUBLE, 0.3::DOUBLE)) t(name, mass_offset, prob)),
    seen AS (SELECT s.spec_idx, parent_mass / 2 AS mass, name, prob, count(mz) > 0 AS seen FROM spectra s CROSS JOIN ions LEFT JOIN peaks p ON p.spec_idx = s.spec_idx AND abs(parent_mass / 2 + mass_offset - mz) <= 25.000001 GROUP BY ALL)
    SELECT spec_idx, round(mass, 6) AS mass, round(sum(CASE WHEN seen THEN ln(prob / 0.1) ELSE ln((1 - prob) / 0.9) END), 6) AS score FROM seen GROUP BY ALL"""
)
def peaks_probabilistic_score(spark, d):
    ions = spark.sql("SELECT * FROM VALUES ('b', 1.0073D, 0.8D), ('y', 19.0184D, 0.85D), ('b-h2o', -17.0033D, 0.3D) t(name, mass_offset, prob)")
    candidates = V.spectra(spark, d).select("spec_idx", (F.col("parent_mass") / 2).alias("mass"))
    return P.peak_scores(V.peaks(spark, d), candidates, ions, 25.0, 0.1).select("spec_idx", *_r("mass", "score"))


@query(PEAKS + " SELECT spec_idx, CASE WHEN intensity > 25 THEN 'b' ELSE 'y' END AS ion, round(sum(intensity), 6) AS intensity FROM peaks GROUP BY ALL")
def peaks_isotope_combine(spark, d):
    ion = F.concat(F.when(F.col("intensity") > 25, "b").otherwise("y"), F.when(F.col("peak_no") % 2 == 0, "-iso").otherwise(""))
    return P.isotope_combine(V.peaks(spark, d).withColumn("ion", ion)).select("spec_idx", "ion", *_r("intensity"))
