"""Queries on whole peak lists, orders and indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import peak_lists as L
from ..operators import psms as M
from . import views as V
from .annotation_queries import CAND, _annotated
from .registry import query

W = V.with_views
PEAKS = W("peaks")
#: A second list for each spectrum: its peaks three daltons up and at a third of the intensity.
OTHER = ", other AS (SELECT spec_idx, peak_no, mz + 3 AS mz, intensity / 3.0::DOUBLE AS intensity FROM peaks WHERE peak_no % 2 = 0)"


def _other(spark, d):
    return V.peaks(spark, d).where("peak_no % 2 = 0").selectExpr("spec_idx", "peak_no", "mz + 3 mz", "intensity / 3.0D intensity")


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(PEAKS + " SELECT *, CAST(row_number() OVER (PARTITION BY spec_idx ORDER BY mz, intensity, peak_no) - 1 AS INTEGER) AS place FROM peaks")
def list_sort(spark, d):
    return L.sort_peaks(V.peaks(spark, d))


@query(
    PEAKS + """, n AS (SELECT spec_idx, min(mz) / 2 AS mz, 1.0::DOUBLE AS intensity FROM peaks GROUP BY spec_idx), l AS (SELECT spec_idx, max(peak_no) AS last FROM peaks GROUP BY spec_idx)
    SELECT spec_idx, CAST(peak_no AS INTEGER) AS peak_no, round(mz, 6) AS mz, CAST(intensity AS DOUBLE) AS intensity FROM peaks UNION ALL SELECT n.spec_idx, CAST(last + 1 AS INTEGER), round(mz, 6), intensity FROM n JOIN l ON n.spec_idx = l.spec_idx"""
)
def list_insert(spark, d):
    p = V.peaks(spark, d)
    new = p.groupBy("spec_idx").agg((F.min("mz") / 2).alias("mz")).withColumn("intensity", F.lit(1.0))
    return L.insert_peaks(p, new).select("spec_idx", F.col("peak_no").cast("int").alias("peak_no"), *_r("mz"), F.col("intensity").cast("double").alias("intensity"))


@query(PEAKS + ", o AS (SELECT *, row_number() OVER (PARTITION BY spec_idx ORDER BY mz, intensity, peak_no) - 1 AS place FROM peaks) SELECT spec_idx, peak_no, mz, intensity FROM o WHERE place NOT IN (0, 2)")
def list_remove_at(spark, d):
    return L.remove_at(V.peaks(spark, d), [0, 2])


@query(PEAKS + OTHER + " SELECT a.spec_idx, round((a.mz * a.intensity + (b.mz - 1) * b.intensity) / (a.intensity + b.intensity), 6) AS mz, round(greatest(a.intensity, b.intensity), 6) AS intensity FROM peaks a JOIN other b ON a.spec_idx = b.spec_idx AND abs(a.mz - (b.mz - 1)) <= 20.000001")
def list_merge_common(spark, d):
    return L.merge_common(V.peaks(spark, d), _other(spark, d), -1.0, 20.0, "max").select("spec_idx", *_r("mz", "intensity"))


#: Peaks by mass alone, so that a spectrum's list has a peak once.
ONCE = ", once AS (SELECT spec_idx, CAST(row_number() OVER (PARTITION BY spec_idx ORDER BY mz) AS INTEGER) AS peak_no, mz, sum(intensity) AS intensity FROM peaks GROUP BY spec_idx, mz), new AS (SELECT spec_idx, peak_no, mz + 7.13 * peak_no AS mz, intensity / 3.0::DOUBLE AS intensity FROM once WHERE peak_no % 2 = 0)"


@query(
    PEAKS + ONCE + """, t AS (SELECT a.spec_idx, a.peak_no, b.peak_no AS new_no, b.mz AS mz2, b.intensity AS int2 FROM once a JOIN new b ON a.spec_idx = b.spec_idx AND abs(a.mz - b.mz) <= 20.000001 QUALIFY row_number() OVER (PARTITION BY b.spec_idx, b.peak_no ORDER BY abs(a.mz - b.mz), a.mz) = 1),
    m AS (SELECT spec_idx, peak_no, sum(int2) AS i, sum(mz2 * int2) AS mi FROM t GROUP BY ALL)
    SELECT o.spec_idx, round(CASE WHEN i IS NULL THEN mz ELSE (mz * intensity + mi) / (intensity + i) END, 6) AS mz, round(intensity + coalesce(i, 0), 6) AS intensity FROM once o LEFT JOIN m ON m.spec_idx = o.spec_idx AND m.peak_no = o.peak_no
    UNION ALL SELECT n.spec_idx, round(mz, 6), round(intensity, 6) FROM new n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.spec_idx = n.spec_idx AND t.new_no = n.peak_no)"""
)
def list_merge_closest(spark, d):
    once = V.peaks(spark, d).groupBy("spec_idx", "mz").agg(F.sum("intensity").alias("intensity")).withColumn("peak_no", F.row_number().over(Window.partitionBy("spec_idx").orderBy("mz")))
    new = once.where("peak_no % 2 = 0").selectExpr("spec_idx", "peak_no", "mz + 7.13D * peak_no mz", "intensity / 3.0D intensity")
    return L.merge_closest(once, new, 20.0).select("spec_idx", *_r("mz", "intensity"))


@query(
    W("peaks", "spectra") + """, s AS (SELECT spec_idx, frag_type, floor(parent_mass / 1500) AS pm FROM spectra), n AS (SELECT *, CASE WHEN pm IS DISTINCT FROM lag(pm) OVER (PARTITION BY frag_type ORDER BY spec_idx) THEN 1 ELSE 0 END AS new FROM s),
    r AS (SELECT spec_idx, concat(frag_type, sum(new) OVER (PARTITION BY frag_type ORDER BY spec_idx ROWS UNBOUNDED PRECEDING)) AS run FROM n)
    SELECT run, CAST(floor(mz / 50 + 0.5) AS BIGINT) AS bin, round(sum(mz * intensity), 4) AS moment, sum(intensity) AS intensity, count(DISTINCT p.spec_idx) AS spectra FROM peaks p JOIN r ON r.spec_idx = p.spec_idx GROUP BY 1, 2"""
)
def list_merge_runs(spark, d):
    s = V.spectra(spark, d).select("spec_idx", "frag_type", F.floor(F.col("parent_mass") / 1500).alias("parent_mass"))
    runs = M.paired_scans(s, 2, ["frag_type"]).select("spec_idx", F.concat("frag_type", F.col("run").cast("string")).alias("run"))
    return L.merge_runs(V.peaks(spark, d), runs, 50.0).select("run", "bin", F.round(F.col("mz") * F.col("intensity"), 4).alias("moment"), "intensity", "spectra")


@query(PEAKS + " SELECT round(avg(intensity), 9) AS intensity FROM peaks")
def list_average_intensity(spark, d):
    return L.average_intensity(V.peaks(spark, d)).withColumn("intensity", F.round("intensity", 9))


@query(W("spectra") + " SELECT CAST(floor(parent_mass / 10 + 0.5) AS BIGINT) AS bin, count(*) AS spectra, min(spec_idx) AS first FROM spectra GROUP BY 1")
def list_mass_histogram(spark, d):
    return L.mass_histogram(V.spectra(spark, d), 10.0)


@query(
    W("pairs") + """, o AS (SELECT spec1, shift1, row_number() OVER (PARTITION BY spec1 % 500 ORDER BY shift1, spec1) AS k, spec1 % 500 AS g FROM pairs), r(g, k, last, kept) AS (SELECT g, k, shift1, true FROM o WHERE k = 1 UNION ALL
    SELECT o.g, o.k, CASE WHEN o.shift1 - r.last <= 2 THEN r.last ELSE o.shift1 END, o.shift1 - r.last > 2 FROM r JOIN o ON o.g = r.g AND o.k = r.k + 1) SELECT g AS "group", last AS shift FROM r WHERE kept"""
)
def pairs_unique_shifts(spark, d):
    g = V.pairs(spark, d).groupBy((F.col("spec1") % 500).alias("group")).agg(F.collect_list("shift1").alias("s"))
    return g.select("group", F.explode(L.unique_shifts(F.col("s"), 2.0)).alias("shift"))


@query(W("psms") + ", o AS (SELECT spectrum_file, score, row_number() OVER (PARTITION BY spectrum_file ORDER BY score) - 1 AS place, count(*) OVER (PARTITION BY spectrum_file) AS n FROM psms) SELECT spectrum_file, " + ", ".join(f"max(score) FILTER (place = n * {k} // 4) AS q{k}" for k in (1, 2, 3)) + " FROM o GROUP BY spectrum_file")
def stats_quartiles(spark, d):
    return L.quartiles(V.psms(spark, d), "score", ["spectrum_file"])


@query(W("pairs") + " SELECT * FROM pairs ORDER BY score1 + score2 DESC, spec1, spec2, shift1, shift2")
def pairs_sorted(spark, d):
    return L.sort_pairs(V.pairs(spark, d))


@query(W("library") + " SELECT *, row_number() OVER (ORDER BY parent_mz, lib_idx) - 1 AS place FROM library")
def library_sorted(spark, d):
    from ..operators.graph import renumber

    lib = V.library(spark, d).withColumn("key", F.struct("parent_mz", "lib_idx"))
    return lib.join(renumber(lib, "key"), F.col("key") == F.col("value")).select("lib_idx", "parent_mz", "library_quality", "compound_name", "charge", F.col("index").alias("place"))


@query(W("clusters") + " SELECT c.* FROM clusters c WHERE cluster_id IN (SELECT cluster_id FROM clusters WHERE spec_idx % 50 = 0)")
def cluster_members(spark, d):
    c = V.clusters(spark, d)
    return L.members_of(c, L.clusters_of(c, c.where("spec_idx % 50 = 0")))


@query(W("psms") + " SELECT scan, spectrum_file, psm_no, score FROM psms")
def psm_explode(spark, d):
    lists = V.psms(spark, d).groupBy("scan", "spectrum_file").agg(F.collect_list(F.struct("psm_no", "score")).alias("psms"))
    return M.explode_matches(lists)


@query(PEAKS + ", b AS (SELECT DISTINCT spec_idx, CAST(floor(mz / 1.0::DOUBLE) AS BIGINT) AS bin FROM peaks) SELECT q.spec_idx AS query, s.spec_idx, count(*) AS bins FROM b q JOIN b s ON q.bin = s.bin AND q.spec_idx <> s.spec_idx WHERE q.spec_idx % 50 = 0 GROUP BY ALL HAVING count(*) >= 2")
def pairs_bin_candidates(spark, d):
    p = V.peaks(spark, d)
    return L.bin_candidates(p.where("spec_idx % 50 = 0"), p, 1.0, 2)


@query(PEAKS + OTHER + ", a AS (SELECT spec_idx, floor(mz / 50) AS bin, sum(intensity) AS x FROM peaks GROUP BY ALL), b AS (SELECT spec_idx, floor(mz / 50) AS bin, sum(intensity) AS y FROM other GROUP BY ALL) SELECT a.spec_idx, round(sum(x * y), 6) AS product, count(*) AS bins FROM a JOIN b ON a.spec_idx = b.spec_idx AND a.bin = b.bin GROUP BY a.spec_idx")
def list_bin_product(spark, d):
    return L.bin_product(V.peaks(spark, d), _other(spark, d), 50.0, ["spec_idx"]).withColumn("product", F.round("product", 6))


@query(
    CAND + f""", {V.SQL_PAIRS}, v AS (SELECT spec_idx, ion, position, sum(intensity) AS value FROM a GROUP BY ALL), n AS (SELECT spec_idx, sqrt(sum(value * value)) AS norm FROM v GROUP BY spec_idx), e AS (SELECT DISTINCT spec1, spec2 FROM pairs)
    SELECT e.spec1, e.spec2, round(coalesce((SELECT sum(x.value * y.value) FROM v x JOIN v y ON x.ion = y.ion AND x.position = y.position WHERE x.spec_idx = spec1 AND y.spec_idx = spec2) / (n1.norm * n2.norm), 0), 6) AS cosine FROM e JOIN n n1 ON n1.spec_idx = spec1 JOIN n n2 ON n2.spec_idx = spec2"""
)
def annotate_ion_cosine(spark, d):
    v = _annotated(spark, d).groupBy("spec_idx", "ion", "position").agg(F.sum("intensity").alias("value"))
    return L.ion_cosine(v, V.pairs(spark, d).select("spec1", "spec2").distinct()).withColumn("cosine", F.round("cosine", 6))


@query(
    W("pairs") + """, l AS (SELECT * FROM pairs WHERE spec1 % 5 <> 0 AND spec2 % 5 <> 0), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT spec1 AS node FROM l UNION SELECT spec2 FROM l))
    SELECT a.i AS u, b.i AS v, score1 FROM l JOIN n a ON a.node = spec1 JOIN n b ON b.node = spec2"""
)
def graph_compress(spark, d):
    p = V.pairs(spark, d)
    gone = p.select(F.explode(F.array("spec1", "spec2")).alias("node")).where("node % 5 = 0")
    return L.compress_graph(p, gone)


@query(W("psms") + ", a AS (SELECT scan, score FROM psms WHERE psm_no < 4), b AS (SELECT scan, score FROM psms WHERE psm_no > 1) SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def report_file_differences(spark, d):
    p = V.psms(spark, d)
    return L.compare_files(p.where("psm_no < 4").select("scan", "score"), p.where("psm_no > 1").select("scan", "score"))


@query(W("library") + " SELECT lib_idx, ('0x' || substr(md5(compound_name), 1, 15))::BIGINT AS hash, list_reverse(list_sort(string_split(compound_name, ' ')))[1] AS last, len(list_distinct(string_split(compound_name, ' '))) AS words, array_to_string(list_sort(list_distinct([lower(trim(x)) FOR x IN string_split(compound_name, ' ') IF x <> ''])), '+') AS parts FROM library")
def text_functions(spark, d):
    n = F.col("compound_name")
    parts = L.text_parts(n, " ")
    return V.library(spark, d).select("lib_idx", L.peptide_hash(n).alias("hash"), F.sort_array(F.split(n, " "), False)[0].alias("last"), F.size(F.array_distinct(F.split(n, " "))).cast("long").alias("words"), F.array_join(F.array_sort(F.array_distinct(parts)), "+").alias("parts"))


@query("SELECT n, k, CAST(round(factorial(CAST(n AS INTEGER)) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(n - k AS INTEGER)))) AS BIGINT) AS ways FROM range(0, 21) a(n), range(0, 21) b(k) WHERE k <= n")
def stats_binomials(spark, d):
    return spark.range(21).withColumnRenamed("id", "n").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).withColumn("ways", L.combinations(F.col("n"), F.col("k")))
