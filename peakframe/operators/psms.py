"""Operators on peptide-spectrum matches: target-decoy control, consensus, modification counts, parsimony.

A match has scan, spectrum_file, db_index, annotation_id, charge, score, p_value, is_decoy; orders that decide
results end in columns that tell rows apart, so ties don't depend on the order of rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut_lineage
from .kernels import per_group

TIES = ["db_index", "annotation_id", "psm_no", "p_value", "is_decoy"]


def _best_first(df: DataFrame, ascending: bool = False) -> list[Column]:
    return [F.asc("score") if ascending else F.desc("score"), *[F.asc(c) for c in TIES if c in df.columns]]


def top_hit(psms: DataFrame, keys: tuple[str, ...] = ("scan", "spectrum_file"), ascending: bool = False) -> DataFrame:
    """The best match of each spectrum, by a sort-free aggregation."""
    lead = F.col("score") if ascending else -F.col("score")
    ties = [F.col(c) for c in TIES if c in psms.columns]
    rest = [F.col(c) for c in psms.columns if c not in {*keys, "score", *TIES}]
    best = F.min(F.struct(lead.alias("__lead"), *ties, F.col("score"), *rest)).alias("b")
    return psms.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in psms.columns])


def q_values(hits: DataFrame, scale: float = 1.0, keys: tuple[str, ...] = ("scan", "spectrum_file"), by: list[str] | None = None, slices: int = 256) -> DataFrame:
    """FDR as running decoys * scale / targets by falling score (1 at most, and while there is no target), and q as its least value from here on.

    The running counts go over the whole table, but not in one task: rows are ordered within slices of score, counts of
    the slices before are added, and the same is done backwards for the minimum. ``by`` parts the table first.
    """
    by = by or []
    part = [F.col(c) for c in by]
    hits = cut_lineage(hits)  # read four times below
    bounds = hits.groupBy(*part).agg(F.percentile_approx("score", [i / slices for i in range(1, slices)], 10_000).alias("__bounds"))
    sliced = hits.join(F.broadcast(bounds), by) if by else hits.withColumn("__bounds", bounds.scalar())
    sliced = sliced.withColumn("__slice", -F.size(F.filter("__bounds", lambda b: b < F.col("score")))).drop("__bounds")  # rising with falling score; equal scores share a slice
    h = sliced
    order = [*_best_first(h), *[F.asc(k) for k in keys]]
    inside = Window.partitionBy(*part, "__slice").orderBy(*order)
    h = h.withColumn("__d", F.sum(F.col("is_decoy").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("__n", F.row_number().over(inside))
    totals = sliced.groupBy(*part, "__slice").agg(F.sum(F.col("is_decoy").cast("long")).alias("__td"), F.count("*").alias("__tn"))
    before = Window.partitionBy(*part).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, "__slice", F.coalesce(F.sum("__td").over(before), F.lit(0)).alias("__pd"), F.coalesce(F.sum("__tn").over(before), F.lit(0)).alias("__pn"))
    h = h.join(F.broadcast(totals), [*by, "__slice"])
    decoys, rows = F.col("__d") + F.col("__pd"), F.col("__n") + F.col("__pn")
    targets = rows - decoys
    h = h.withColumn("fdr", F.when(targets == 0, 1.0).otherwise(F.least(F.lit(1.0), decoys * scale / targets))).withColumn("__rank", rows)
    least = h.groupBy(*part, "__slice").agg(F.min("fdr").alias("__least"))
    after = Window.partitionBy(*part).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*part, "__slice", F.min("__least").over(after).alias("__after"))
    back = Window.partitionBy(*part, "__slice").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(F.broadcast(least), [*by, "__slice"]).withColumn("q", F.least(F.min("fdr").over(back), F.coalesce("__after", F.lit(1.0))))
    return h.select(*hits.columns, "fdr", "q", F.col("__rank").alias("rank"))


def concatenated_fdr(psms: DataFrame, scale: float = 1.0) -> DataFrame:
    """Targets and decoys compete for each spectrum, then the curve."""
    return q_values(top_hit(psms), scale)


def separate_fdr(psms: DataFrame, scale: float = 1.0) -> DataFrame:
    """The best target and the best decoy of each spectrum both stay, then the curve."""
    best = top_hit(psms, ("scan", "spectrum_file", "is_decoy"))
    return q_values(best.select(psms.columns), scale)


def fdr_cutoff(scored: DataFrame, most: float, keep_first: bool = False) -> DataFrame:
    kept = F.col("q") <= most
    return scored.where(kept | (F.col("rank") == 1) if keep_first else kept)


def best_per_peptide(psms: DataFrame, peptide: str = "annotation_id") -> DataFrame:
    return top_hit(psms, (peptide, "charge"))


def cluster_consensus(members: DataFrame) -> DataFrame:
    """The annotation that most members of a cluster carry, with its least p-value; ties go to the smaller p-value, then the smaller annotation."""
    per = members.groupBy("cluster_id", "annotation_id").agg(F.count("*").alias("votes"), F.min("p_value").alias("p_value"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), "p_value", "annotation_id")).alias("b")
    return per.groupBy("cluster_id").agg(best).select("cluster_id", F.col("b.annotation_id").alias("annotation_id"), (-F.col("b.v")).alias("votes"), F.col("b.p_value").alias("p_value"))


def modification_counts(annotations: DataFrame) -> DataFrame:
    """residue, mod, weight: each ``(RESIDUES,mass)`` of an annotation counts 1 / number of its residues for each of them; masses are rounded to integers."""
    mods = annotations.select(F.explode(F.regexp_extract_all("annotation", F.lit(r"\(([A-Z]+,-?[0-9.]+)\)"), 1)).alias("m"))
    m = mods.select(F.split("m", ",")[0].alias("residues"), F.round(F.split("m", ",")[1].cast("double")).cast("long").alias("mod"))
    each = m.select("mod", F.explode(F.split("residues", "")).alias("residue"), (1.0 / F.length("residues")).alias("w")).where("residue <> ''")
    return each.groupBy("residue", "mod").agg(F.sum("w").alias("weight"))


def modification_matrix(annotations: DataFrame, residues: list[str]) -> DataFrame:
    """A row for each modification, a column for each residue, and the row's total."""
    counts = modification_counts(annotations).where(F.col("residue").isin(residues))
    wide = counts.groupBy("mod").pivot("residue", residues).agg(F.sum("weight"))
    filled = [F.coalesce(F.col(r), F.lit(0.0)).alias(r) for r in residues]
    total = sum((F.coalesce(F.col(r), F.lit(0.0)) for r in residues), F.lit(0.0))
    return wide.select("mod", *filled, total.alias("total"))


def modification_frequency(pairs: DataFrame, resolution: float) -> DataFrame:
    """bin, frequency of both shifts in absolute units of resolution; bins met once or over a mass of 90 have 0, but count in the total."""
    shifts = pairs.select(F.explode(F.array("shift1", "shift2")).alias("s"))
    bins = shifts.select(F.abs((F.col("s") / resolution).cast("long")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = shifts.agg(F.count("*")).scalar()
    odd = (F.col("n") <= 1) | (F.col("bin") * resolution > 90)
    return bins.select("bin", F.when(odd, 0.0).otherwise(F.col("n") / total).alias("frequency"))


#: Matches of parsimony that one task finishes by itself, once the rounds have brought them down to so many.
LAST_TASK = 200_000


def _greedy_cover(rows: list[dict]):
    """The protein with most scans left, then the smallest index, again and again; counts in the heap are corrected when they come up."""
    scans, proteins = {}, {}
    for r in rows:
        scans.setdefault(r["db_index"], set()).add(r["scan"])
        proteins.setdefault(r["scan"], []).append(r["db_index"])
    heap = [(-len(s), p) for p, s in scans.items()]
    heapq.heapify(heap)
    while heap:
        n, p = heapq.heappop(heap)
        left = scans[p]
        if -n != len(left):
            if left:
                heapq.heappush(heap, (-len(left), p))
            continue
        for scan in sorted(left):
            yield {"scan": scan, "db_index": p}
            for other in proteins[scan]:
                if other != p:
                    scans[other].discard(scan)
        scans[p] = set()


def parsimony(matches: DataFrame, last_task: int = LAST_TASK) -> DataFrame:
    """Greedy set cover: scan, db_index assigned. Each round, every protein that no rival for any of its scans beats is taken at once.

    A protein beats another if it has more scans left, or as many and a smaller index. Taking all local winners of a round
    gives the same assignment as taking the best one by one, in far fewer rounds; what is left at ``last_task`` matches or
    fewer goes through the one-by-one form in a single task.
    """
    left = cut_lineage(matches.select("scan", "db_index").where("db_index is not null and scan is not null").distinct())
    taken = None
    while left.limit(last_task + 1).count() > last_task:
        size = left.groupBy("db_index").agg(F.count("*").alias("n"))
        ranked = left.join(size, "db_index").withColumn("strength", F.struct(F.col("n"), (-F.col("db_index")).alias("i")))
        best = ranked.groupBy("scan").agg(F.max("strength").alias("top"))
        winners = ranked.join(best, "scan").groupBy("db_index").agg(F.bool_and(F.col("strength") == F.col("top")).alias("wins")).where("wins")
        marked = left.join(winners, "db_index", "left").withColumn("wins", F.coalesce("wins", F.lit(False)))
        state = cut_lineage(marked.withColumn("done", F.max("wins").over(Window.partitionBy("scan"))).where("wins or not done").select("scan", "db_index", "wins"))
        now, left = state.where("wins").select("scan", "db_index"), state.where("not wins").select("scan", "db_index")
        taken = now if taken is None else taken.unionByName(now)
    rest = per_group(left.select(F.lit(0).alias("all"), F.col("scan").cast("long"), F.col("db_index").cast("long")), ["all"], ["db_index", "scan"], _greedy_cover, "scan long, db_index long")
    return rest if taken is None else taken.unionByName(rest)


def paired_scans(spectra: DataFrame, most: int, by: list[str]) -> DataFrame:
    """Runs of consecutive spectra of a file (``by``) with equal parent mass, in pieces of ``most``: the run's number, piece and place in the piece."""
    order = Window.partitionBy(*by).orderBy("spec_idx")
    fresh = F.coalesce((F.col("parent_mass") != F.lag("parent_mass").over(order)).cast("int"), F.lit(1))
    runs = spectra.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(*by, "run").orderBy("spec_idx")) - 1
    return runs.withColumn("piece", F.floor(nth / most)).withColumn("place", nth % most).drop("__new")


def filter_by_mods(annotations: DataFrame, masses: list[float], most: int, tol: float = 0.001) -> DataFrame:
    """Matches with at most ``most`` modifications, all of an allowed mass."""
    mods = F.transform(F.regexp_extract_all("annotation", F.lit(r"[,\[](-?[0-9.]+)[\])]"), 1), lambda m: m.cast("double"))
    allowed = F.forall(mods, lambda m: F.exists(F.array(*[F.lit(x) for x in masses]), lambda a: F.abs(a - m) <= tol))
    return annotations.where((F.size(mods) <= most) & allowed)


def explode_matches(spectra: DataFrame, column: str = "psms") -> DataFrame:
    """A row for each match in the spectra's lists; a spectrum without one has no row."""
    keys = [c for c in spectra.columns if c != column]
    return spectra.select(*keys, F.explode(column).alias("__m")).select(*keys, "__m.*")


def merge_results(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def keep_better(library: DataFrame, new: DataFrame, keys: list[str], ascending: bool = False) -> DataFrame:
    """Entries of both; for equal keys that with the better score, and of equal scores the library's."""
    both = library.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    lead = F.col("score") if ascending else -F.col("score")
    rest = [c for c in library.columns if c not in keys]
    best = F.min(F.struct(lead.alias("__l"), "__side", *[F.col(c).alias(c) for c in rest])).alias("b")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])
