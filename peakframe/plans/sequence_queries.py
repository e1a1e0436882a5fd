"""Queries on peptide annotations and protein sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import peptides as P
from ..operators import proteins as R
from . import views as V
from .registry import query
from .psm_queries import ANNOTATED

W = V.with_views
ANN = W("psms") + f", a AS (SELECT DISTINCT concat('K.', {ANNOTATED}, CASE WHEN charge = 2 THEN '[57.02]' ELSE '' END, '.R') AS annotation FROM psms), b AS (SELECT annotation, substr(annotation, 3, length(annotation) - 4) AS s FROM a)"
#: Peptides: each sequence cut after K and R.
CLEAVED = "[^KR]*[KR]|[^KR]+$"
PEP = W("proteins") + f", pep AS (SELECT DISTINCT unnest(regexp_extract_all(seq, '{CLEAVED}')) AS peptide FROM proteins)"
MASS = "(SELECT * FROM (VALUES " + ", ".join(f"('{r}', {m}::DOUBLE)" for r, m in P.RESIDUE_MASS.items()) + ") t(r, m))"


def _ann(spark, d):
    a = F.concat(F.lit("K."), F.expr(ANNOTATED), F.when(F.col("charge") == 2, "[57.02]").otherwise(""), F.lit(".R"))
    return V.psms(spark, d).select(a.alias("annotation")).distinct()


def _pep(spark, d):
    return V.proteins(spark, d).select(F.explode(F.regexp_extract_all("seq", F.lit(CLEAVED), 0)).alias("peptide")).distinct()


STRIP = "regexp_replace(s, '\\(([A-Z]+),[^)]*\\)', '\\1', 'g')"


@query(ANN + f" SELECT annotation, {STRIP} AS stripped, regexp_replace({STRIP}, '[^A-Z]', '', 'g') AS bare, concat('*.', s, '.*') AS ends FROM b")
def peptide_strip(spark, d):
    return _ann(spark, d).select("annotation", P.strip_mods(P.strip_ends("annotation")).alias("stripped"), P.unmodified("annotation").alias("bare"), P.add_ends("annotation").alias("ends"))


@query(
    ANN + f""", n AS (SELECT annotation, regexp_replace({STRIP}, '[^A-Z]', '', 'g') AS bare, [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(s, '[,\\[](-?[0-9.]+)[\\])]', 1)] AS shifts FROM b),
    l AS (SELECT annotation, unnest(string_split(bare, '')) AS r FROM n), m AS (SELECT annotation, sum(t.m) AS residues FROM l JOIN {MASS} t ON l.r = t.r GROUP BY annotation)
    SELECT n.annotation, round(coalesce(list_sum(shifts), 0), 4) AS mod_mass, round(residues + coalesce(list_sum(shifts), 0), 4) AS mass FROM n JOIN m ON m.annotation = n.annotation"""
)
def peptide_masses(spark, d):
    return _ann(spark, d).select("annotation", F.round(P.mod_mass("annotation"), 4).alias("mod_mass"), F.round(P.peptide_mass("annotation"), 4).alias("mass"))


@query(
    ANN + f""", t AS (SELECT annotation, s, regexp_extract_all(s, '\\([A-Z]+,-?[0-9.]+\\)|\\[-?[0-9.]+\\]|[A-Z]') AS t FROM b)
    SELECT annotation, CAST(length(regexp_replace({STRIP}, '[^A-Z]', '', 'g')) + (length(s) - length(replace(s, '[', ''))) AS INTEGER) AS length, CAST(len(t) AS INTEGER) AS jumps, CAST(length(s) - length(replace(s, '[', '')) AS INTEGER) AS gaps,
    array_to_string(list_reverse(t), '') AS reversed, true AS valid FROM t"""
)
def peptide_structure(spark, d):
    return _ann(spark, d).select("annotation", P.peptide_length("annotation").alias("length"), P.jump_count("annotation").alias("jumps"), P.gap_count("annotation").alias("gaps"), P.reverse_peptide("annotation").alias("reversed"), P.is_valid("annotation").alias("valid"))


@query(PEP + " SELECT peptide, i AS n, substr(peptide, 1, i) AS prefix, right(peptide, i) AS suffix FROM (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS i FROM pep)")
def peptide_prefix_suffix(spark, d):
    both = F.arrays_zip(P.prefixes("peptide").alias("p"), P.suffixes("peptide").alias("s"))
    return _pep(spark, d).select("peptide", F.posexplode(both).alias("n", "x")).select("peptide", (F.col("n") + 1).cast("long").alias("n"), F.col("x.p").alias("prefix"), F.col("x.s").alias("suffix"))


@query(
    PEP + f""", l AS (SELECT peptide, i, t.m FROM (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS i, unnest(string_split(peptide, '')) AS r FROM pep) u JOIN {MASS} t ON t.r = u.r)
    SELECT peptide, i AS position, round(sum(m) OVER (PARTITION BY peptide ORDER BY i), 2) AS prefix_mass FROM l"""
)
def peptide_prefix_masses(spark, d):
    return _pep(spark, d).select("peptide", F.posexplode(P.prefix_masses("peptide")).alias("p", "m")).select("peptide", (F.col("p") + 1).cast("long").alias("position"), F.round("m", 2).alias("prefix_mass"))


@query(
    PEP + f""", l AS (SELECT peptide, i, t.m FROM (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS i, unnest(string_split(peptide, '')) AS r FROM pep) u JOIN {MASS} t ON t.r = u.r),
    x AS (SELECT peptide, 'b' AS ion, i AS position, sum(m) OVER (PARTITION BY peptide ORDER BY i) + 1.007825035 AS mz FROM l UNION ALL SELECT peptide, 'y', length(peptide) + 1 - i, sum(m) OVER (PARTITION BY peptide ORDER BY i DESC) + 18.010564686 + 1.007825035 FROM l)
    SELECT peptide, ion, position, round(mz, 2) AS mz FROM x WHERE position < length(peptide)"""
)
def peptide_theoretical_ions(spark, d):
    return _pep(spark, d).select("peptide", F.explode(P.theoretical_ions("peptide")).alias("x")).select("peptide", "x.ion", F.col("x.position").cast("long").alias("position"), F.round("x.mz", 2).alias("mz"))


@query(PEP + " SELECT peptide, CAST(hamming(peptide, reverse(peptide)) AS INTEGER) AS differ FROM pep")
def peptide_hamming(spark, d):
    return _pep(spark, d).select("peptide", P.hamming("peptide", F.reverse("peptide")).alias("differ"))


@query(
    PEP + """, l AS (SELECT peptide, unnest(range(0, length(peptide))) AS i, unnest(string_split(peptide, '')) AS r FROM pep),
    f AS (SELECT peptide, i, r, row_number() OVER (PARTITION BY peptide ORDER BY i) AS place, row_number() OVER (PARTITION BY peptide ORDER BY md5(concat(peptide, ':2:', i))) AS drawn FROM l WHERE r NOT IN ('R', 'K', 'P')),
    x AS (SELECT peptide, i, r FROM l WHERE r IN ('R', 'K', 'P') UNION ALL SELECT a.peptide, a.i, b.r FROM f a JOIN f b ON a.peptide = b.peptide AND a.place = b.drawn) SELECT peptide, string_agg(r, '' ORDER BY i) AS decoy FROM x GROUP BY peptide"""
)
def peptide_decoys(spark, d):
    return _pep(spark, d).select("peptide", P.decoy_peptide("peptide", F.lit(2)).alias("decoy"))


@query(PEP + " SELECT peptide, translate(peptide, 'LK', 'IQ') AS folded FROM pep")
def peptide_fold(spark, d):
    return _pep(spark, d).select("peptide", P.fold_residues("peptide").alias("folded"))


@query(
    ANN + """, t AS (SELECT annotation, regexp_extract_all(s, '\\([A-Z]+,-?[0-9.]+\\)|\\[-?[0-9.]+\\]|[A-Z]') AS t FROM b), u AS (SELECT annotation, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM t),
    n AS (SELECT *, CASE WHEN x LIKE '[%' THEN 0 ELSE length(regexp_replace(x, '[^A-Z]', '', 'g')) END AS n FROM u), p AS (SELECT *, sum(n) OVER (PARTITION BY annotation ORDER BY i) AS position FROM n)
    SELECT annotation, CAST(regexp_extract(x, '(-?[0-9.]+)[\\])]$', 1) AS DOUBLE) AS mass, CAST(position AS INTEGER) AS position, CAST(n AS INTEGER) AS length FROM p WHERE NOT regexp_full_match(x, '[A-Z]')"""
)
def peptide_mods_positions(spark, d):
    return _ann(spark, d).select("annotation", F.explode(P.mods_and_positions("annotation")).alias("m")).select("annotation", "m.mass", "m.position", "m.length")


@query(W("proteins") + " SELECT * FROM proteins UNION ALL SELECT prot_idx, concat('XXX', id), reverse(seq) FROM proteins")
def protein_decoys_reversed(spark, d):
    return R.reversed_decoys(V.proteins(spark, d))


@query(
    W("proteins") + """, l AS (SELECT prot_idx, id, md5(seq) AS d, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS r FROM proteins WHERE seq <> ''), x AS (SELECT prot_idx, concat('XXX', id) AS id, string_agg(r, '' ORDER BY md5(concat(d, ':', i))) AS seq FROM l GROUP BY prot_idx, id, d),
    a AS (SELECT prot_idx, id, seq FROM proteins UNION ALL SELECT * FROM x UNION ALL SELECT prot_idx, concat('XXX', id), seq FROM proteins WHERE seq = '') SELECT prot_idx, id, md5(seq) AS digest FROM a"""
)
def protein_decoys_shuffled(spark, d):
    return R.shuffled_decoys(V.proteins(spark, d)).select("prot_idx", "id", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(W("proteins") + ", s AS (SELECT prot_idx, seq, unnest(range(0, length(seq) - 3)) AS i FROM proteins) SELECT substr(seq, i + 1, 4) AS kmer, count(*) AS places, count(DISTINCT prot_idx) AS proteins FROM s GROUP BY 1")
def protein_kmers(spark, d):
    return R.kmer_index(V.proteins(spark, d), 4).groupBy("kmer").agg(F.count("*").alias("places"), F.count_distinct("prot_idx").alias("proteins"))


PEPS = W("proteins") + ", pep AS (SELECT DISTINCT substr(seq, 3, 9) AS peptide FROM proteins WHERE prot_idx % 50 = 0 AND length(seq) >= 12)"


def _some(spark, d):
    return V.proteins(spark, d).where("prot_idx % 50 = 0 and length(seq) >= 12").select(F.substring("seq", 3, 9).alias("peptide")).distinct()


@query(PEPS + " SELECT peptide, prot_idx FROM pep JOIN proteins ON instr(seq, peptide) > 0")
def protein_search(spark, d):
    return R.proteins_with(V.proteins(spark, d), _some(spark, d))


@query(PEPS + ", x AS (SELECT peptide, prot_idx, seq FROM pep JOIN proteins ON instr(seq, peptide) > 0) SELECT peptide, prot_idx, CAST(i AS INTEGER) AS start FROM x, range(0, 40000) t(i) WHERE i < length(seq) AND substr(seq, i + 1, length(peptide)) = peptide")
def protein_occurrences(spark, d):
    return R.occurrences(V.proteins(spark, d), _some(spark, d))


@query(PEPS + ", x AS (SELECT peptide, prot_idx, instr(seq, peptide) - 1 AS f FROM pep JOIN proteins ON instr(seq, peptide) > 0), r AS (SELECT DISTINCT prot_idx, unnest(range(f, f + 9)) AS residue FROM x) SELECT round((SELECT count(*) FROM r) * 100.0::DOUBLE / (SELECT sum(length(seq)) FROM proteins), 6) AS percent")
def protein_total_coverage(spark, d):
    return R.total_coverage(_coverage(spark, d)).withColumn("percent", F.round("percent", 6))


@query(
    PEPS + """, x AS (SELECT peptide, prot_idx, instr(seq, peptide) - 1 AS f FROM pep JOIN proteins ON instr(seq, peptide) > 0), r AS (SELECT prot_idx, unnest(range(f, f + 9)) AS residue FROM x), n AS (SELECT prot_idx, residue, count(*) AS n FROM r GROUP BY ALL),
    c AS (SELECT prot_idx, count(*) AS covered, avg(n) AS redundancy FROM n GROUP BY prot_idx)
    SELECT p.prot_idx, coalesce(covered, 0) AS covered, CAST(length(seq) AS INTEGER) AS length, round(coalesce(covered * 100.0 / nullif(length(seq), 0), 0), 4) AS percent, round(redundancy, 6) AS redundancy FROM proteins p LEFT JOIN c ON c.prot_idx = p.prot_idx"""
)
def protein_coverage(spark, d):
    return _coverage(spark, d).withColumns({"percent": F.round("percent", 4), "redundancy": F.round("redundancy", 6)})


def _coverage(spark, d):
    p = V.proteins(spark, d)
    hits = R.occurrences(p, _some(spark, d)).groupBy("peptide", "prot_idx").agg(F.min("start").alias("first")).select("prot_idx", "first", (F.col("first") + 8).alias("last"))
    return R.coverage(p, hits)


@query(
    W("proteins") + f""", w AS (SELECT prot_idx AS tag_id, substr(seq, 8, 4) AS tag, substr(seq, 5, 3) AS a, substr(seq, 12, 3) AS b FROM proteins WHERE prot_idx % 50 = 0 AND length(seq) >= 20),
    mass(r, m) AS {MASS}, tags AS (SELECT tag_id, tag, (SELECT sum(m) FROM mass, range(1, 4) t(i) WHERE r = substr(a, CAST(i AS INTEGER), 1)) AS prefix_mass, (SELECT sum(m) FROM mass, range(1, 4) t(i) WHERE r = substr(b, CAST(i AS INTEGER), 1)) AS suffix_mass FROM w),
    l AS (SELECT prot_idx, seq, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS r FROM proteins), c AS (SELECT prot_idx, i, sum(m) OVER (PARTITION BY prot_idx ORDER BY i) AS total FROM l JOIN mass ON l.r = mass.r UNION ALL SELECT prot_idx, 0, 0.0 FROM proteins),
    h AS (SELECT tag_id, prot_idx, i - 1 AS start, prefix_mass, suffix_mass, seq FROM l JOIN tags ON substr(seq, i, 4) = tag),
    e AS (SELECT h.*, x.total AS t1, y.total AS t2 FROM h JOIN c x ON x.prot_idx = h.prot_idx AND x.i = h.start JOIN c y ON y.prot_idx = h.prot_idx AND y.i = h.start + 4),
    b AS (SELECT tag_id, e.prot_idx, start, min(start - y.i) AS before FROM e JOIN range(1, 13) w(n) ON true JOIN c y ON y.prot_idx = e.prot_idx AND y.i = start - n WHERE abs(t1 - y.total - prefix_mass) <= 0.1001 GROUP BY ALL),
    f AS (SELECT tag_id, e.prot_idx, start, min(y.i - start - 4) AS after FROM e JOIN range(1, 13) w(n) ON true JOIN c y ON y.prot_idx = e.prot_idx AND y.i = start + 4 + n WHERE abs(y.total - t2 - suffix_mass) <= 0.1001 GROUP BY ALL)
    SELECT b.tag_id, b.prot_idx, CAST(b.start AS INTEGER) AS start, 2 AS flanks, substr(seq, b.start - before + 1, before + 4 + after) AS peptide FROM b JOIN f ON b.tag_id = f.tag_id AND b.prot_idx = f.prot_idx AND b.start = f.start JOIN proteins p ON p.prot_idx = b.prot_idx"""
)
def protein_tag_search(spark, d):
    p = V.proteins(spark, d)
    tags = V.proteins(spark, d).where("prot_idx % 50 = 0 and length(seq) >= 20").select(F.col("prot_idx").alias("tag_id"), F.substring("seq", 8, 4).alias("tag"), P.peptide_mass(F.substring("seq", 5, 3)).alias("prefix_mass"), P.peptide_mass(F.substring("seq", 12, 3)).alias("suffix_mass"))
    return R.find_tags(p, tags, 4, 0.1, 2)


@query(
    W("proteins") + """, s AS (SELECT seq, unnest(range(0, length(seq) - 4)) AS i FROM proteins), t AS (SELECT DISTINCT substr(seq, i + 1, 5) AS tag FROM s), c AS (SELECT tag, unnest(range(0, 32)) AS c FROM t)
    SELECT DISTINCT tag, array_to_string([CASE WHEN substr(tag, k, 1) IN ('I', 'L') THEN CASE WHEN (c >> (k - 1)) & 1 = 0 THEN 'I' ELSE 'L' END WHEN substr(tag, k, 1) IN ('Q', 'K') THEN CASE WHEN (c >> (k - 1)) & 1 = 0 THEN 'Q' ELSE 'K' END ELSE substr(tag, k, 1) END FOR k IN [1, 2, 3, 4, 5]], '') AS spelling FROM c"""
)
def protein_equivalent_tags(spark, d):
    return R.equivalent_tags(R.kmer_index(V.proteins(spark, d), 5).select(F.col("kmer").alias("tag")).distinct())


@query(
    W("proteins") + f""", l AS (SELECT prot_idx, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS r FROM proteins), c AS (SELECT prot_idx, i, sum(m) OVER (PARTITION BY prot_idx ORDER BY i) AS total FROM l JOIN {MASS} t ON l.r = t.r UNION ALL SELECT prot_idx, 0, 0.0 FROM proteins),
    w AS (SELECT prot_idx, i, total, [lead(total, 1) OVER o, lead(total, 2) OVER o, lead(total, 3) OVER o, lead(total, 4) OVER o, lead(total, 5) OVER o] AS ahead FROM c WINDOW o AS (PARTITION BY prot_idx ORDER BY i)),
    u AS (SELECT prot_idx, i AS start, total, unnest(ahead) AS later, unnest([1, 2, 3, 4, 5]) AS n FROM w), g AS (SELECT prot_idx, start, start + n - 1 AS stop, later - total AS gap FROM u WHERE later IS NOT NULL),
    q AS (SELECT * FROM (VALUES (1, 300.15::DOUBLE), (2, 411.2::DOUBLE)) t(mass_id, mass)) SELECT prot_idx, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, mass_id, round(gap, 4) AS gap FROM g JOIN q ON abs(gap - mass) <= 0.050001"""
)
def protein_mass_search(spark, d):
    masses = spark.sql("SELECT * FROM VALUES (1, 300.15D), (2, 411.2D) t(mass_id, mass)")
    return R.mass_to_peptides(V.proteins(spark, d), masses, 0.05, 5).select("prot_idx", "start", "stop", "mass_id", F.round("gap", 4).alias("gap"))
