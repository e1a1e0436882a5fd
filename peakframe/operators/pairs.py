"""Pairs of spectra: candidates, matched peaks, similarities, and the statistics by which pairs are kept.

A pair has spec1 < spec2, score1, score2, shift1, shift2.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pair_blocks as B
from .band_join import SLACK, band_join, range_self_join

#: Coefficients of the usual polynomial for the normal law's distribution function (error under 1e-7).
PHI = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
PHI_STEP, PHI_SCALE = 0.2316419, 0.39894228


def candidate_pairs(spectra: DataFrame, low: float, high: float, pm_tol: float = 0.0, keep: tuple[str, ...] = ("parent_charge",)) -> DataFrame:
    """spec1 < spec2 whose parent masses differ by at least low - 2 tol and at most high + 2 tol."""
    p = range_self_join(spectra, "parent_mass", max(0.0, low - 2 * pm_tol), high + 2 * pm_tol, "spec_idx", list(keep))
    return p.withColumnsRenamed({"spec_idx1": "spec1", "spec_idx2": "spec2"}).withColumn("delta", F.col("parent_mass2") - F.col("parent_mass1"))


def jump_pairs(spectra: DataFrame, jumps: list[float], pm_tol: float) -> DataFrame:
    """Pairs whose parent masses differ by one of the jumps, within twice the tolerance.

    A pair is met once for a jump, from its lighter spectrum, so that no pair is shuffled unless spectra's numbers repeat.
    """
    s, reach = spectra.select("spec_idx", "parent_mass"), 2 * pm_tol
    right = s.select(F.col("spec_idx").alias("other"), "parent_mass", F.explode(F.array(*[F.lit(j) for j in sorted({abs(float(j)) for j in jumps})])).alias("jump"))
    right = right.select("other", F.col("parent_mass").alias("mass"), (F.col("parent_mass") + F.col("jump")).alias("at"), "jump")
    hit = band_join(s, right, "parent_mass", "at", reach)
    back = F.abs(F.col("parent_mass") + F.col("jump") - F.col("mass")) <= reach + SLACK  # a jump within the tolerance leads either way
    hit = hit.where((F.col("spec_idx") < F.col("other")) | ((F.col("spec_idx") > F.col("other")) & ~back))
    found = hit.select(F.least("spec_idx", "other").alias("spec1"), F.greatest("spec_idx", "other").alias("spec2"), "jump")
    return found if numbered_once(spectra) else found.distinct()


def numbered_once(spectra: DataFrame) -> bool:
    """Whether no number comes twice."""
    return spectra.where("spec_idx is not null").groupBy("spec_idx").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def regular(spectra: DataFrame, peaks: DataFrame, numbers: tuple[str, ...]) -> bool:
    """Whether each row of spectra has a number of its own and peaks have finite ``numbers``: then pairs can be compared in blocks."""
    odd = F.lit(False)
    for c in numbers:
        odd = odd | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    if not peaks.where(odd).isEmpty():
        return False
    return numbered_once(spectra)


def _sides(peaks: DataFrame, pairs: DataFrame, shift: Column | None) -> tuple[DataFrame, DataFrame]:
    a = pairs.select("spec1", "spec2").join(peaks.select(F.col("spec_idx").alias("spec1"), F.col("peak_no").alias("i"), F.col("mz").alias("mz1"), F.col("intensity").alias("int1")), "spec1")
    cols = ["spec1", "spec2", *([shift.alias("shift")] if shift is not None else [F.lit(0.0).alias("shift")])]
    b = pairs.select(*cols).join(peaks.select(F.col("spec_idx").alias("spec2"), F.col("peak_no").alias("j"), F.col("mz").alias("mz2"), F.col("intensity").alias("int2")), "spec2")
    return a.select("spec1", "spec2", "i", "mz1", "int1"), b.select("spec1", "spec2", "j", "mz2", "int2", "shift")


def with_lists(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Spectra with their peaks as a list ``p``, for ``candidate_pairs(..., keep=("p",))``: pairs then carry both lists and are compared within the row."""
    lists = peaks.groupBy("spec_idx").agg(F.collect_list(F.struct("peak_no", "mz", "intensity")).alias("p"))
    return spectra.join(lists.hint("merge"), "spec_idx")


def matched_peaks(peaks: DataFrame, pairs: DataFrame, tol: float, shift: Column | None = None) -> DataFrame:
    """All (i, j) of each pair with ``|mz1 - (mz2 + shift)| <= tol``; shift is computed from the pair's columns.

    Pairs that carry both peak lists (p1, p2) need no join: nothing that grows with the number of pairs is shuffled.
    """
    if not {"p1", "p2"} <= set(pairs.columns):
        a, b = _sides(peaks, pairs, shift)
        return band_join(a, b, "mz1", "mz2", tol, ["spec1", "spec2"], shift=F.col("shift"))
    by = F.lit(0.0) if shift is None else shift
    one = pairs.select("spec1", "spec2", by.alias("shift"), "p2", F.explode("p1").alias("x"))
    two = one.select("spec1", "spec2", "shift", "x", F.explode("p2").alias("y")).where(F.abs(F.col("x.mz") - (F.col("y.mz") + F.col("shift"))) <= tol + SLACK)
    side = lambda s, k, no: [F.col(f"{s}.peak_no").alias(no), F.col(f"{s}.mz").alias(f"mz{k}"), F.col(f"{s}.intensity").alias(f"int{k}")]
    return two.select("spec1", "spec2", *side("x", 1, "i"), *side("y", 2, "j"), "shift")


def matched_within(peaks: DataFrame, spectra: DataFrame, high: float, tol: float, places: int) -> DataFrame:
    """``matched_peaks`` at the difference of the parent masses, of all pairs with these up to ``high`` apart: spec1, spec2, i, j, and mz1, mz2 to so many places."""
    if not regular(spectra, peaks, ("mz", "peak_no")):
        found = matched_peaks(peaks, candidate_pairs(with_lists(spectra, peaks), 0.0, high, keep=("p",)), tol, F.col("delta"))
        return found.select("spec1", "spec2", "i", "j", F.round("mz1", places).alias("mz1"), F.round("mz2", places).alias("mz2"))
    lists = peaks.groupBy(F.col("spec_idx").cast("long").alias("id")).agg(F.collect_list(F.struct("mz", "peak_no")).alias("p"))
    lists = lists.select("id", F.transform("p", lambda x: x.mz.cast("double")).alias("mz"), F.transform("p", lambda x: x.peak_no).alias("no"), F.transform("p", lambda x: F.round(x.mz, places).cast("double")).alias("shown"))
    number = peaks.schema["peak_no"].dataType.simpleString()
    rows = spectra.select(F.col("spec_idx").cast("long").alias("id"), F.col("parent_mass").cast("double").alias("at"))
    return B.matches(rows, lists, high, tol, f"spec1 long, spec2 long, i {number}, j {number}, mz1 double, mz2 double")


def peaks_with_partner(peaks: DataFrame, pairs: DataFrame, tol: float) -> DataFrame:
    """Peaks of either side that have at least one partner: spec1, spec2, side, peak, mz."""
    a, b = _sides(peaks, pairs, None)
    left = band_join(a, b, "mz1", "mz2", tol, ["spec1", "spec2"], how="left_semi")
    right = band_join(b, a, "mz2", "mz1", tol, ["spec1", "spec2"], how="left_semi")
    return left.select("spec1", "spec2", F.lit(1).alias("side"), F.col("i").alias("peak"), F.col("mz1").alias("mz")).unionByName(
        right.select("spec1", "spec2", F.lit(2).alias("side"), F.col("j").alias("peak"), F.col("mz2").alias("mz"))
    )


def greedy_matches(matches: DataFrame, value: Column) -> DataFrame:
    """One-to-one matches of each pair, taken greedily by falling value: spec1, spec2, score, matched, int1, int2.

    The fold runs within a row over one pair's sorted matches; both lists of used peaks are as short as a spectrum.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct((-value).alias("lead"), "i", "j", "int1", "int2")))
    per = matches.groupBy("spec1", "spec2").agg(sorted_.alias("m"))
    fold = """aggregate(m, named_struct('score', 0.0D, 'matched', 0, 'int1', 0.0D, 'int2', 0.0D, 'ui', cast(array() as array<int>), 'uj', cast(array() as array<int>)),
        (a, x) -> if(array_contains(a.ui, cast(x.i as int)) or array_contains(a.uj, cast(x.j as int)), a, named_struct('score', a.score - x.lead, 'matched', a.matched + 1,
            'int1', a.int1 + x.int1, 'int2', a.int2 + x.int2, 'ui', concat(a.ui, array(cast(x.i as int))), 'uj', concat(a.uj, array(cast(x.j as int))))))"""
    return per.select("spec1", "spec2", F.expr(fold).alias("f")).select("spec1", "spec2", "f.score", "f.matched", "f.int1", "f.int2")


def cosine_pairs(peaks: DataFrame, spectra: DataFrame, max_diff: float, pm_tol: float, tol: float, least_cosine: float, least_matched: int, least_ratio: float = 0.0, least_peaks: int = 5) -> DataFrame:
    """Pairs by greedy cosine at shift 0 and at the difference of the parent masses.

    peaks: intensities already of unit length per spectrum. Spectra with fewer than ``least_peaks`` peaks are left out,
    pairs with too few matches go before the greedy step.
    """
    n = peaks.groupBy("spec_idx").agg(F.count("*").alias("n"), F.sum("intensity").alias("total"))
    rich = spectra.join(n.where(F.col("n") >= least_peaks), "spec_idx")
    if regular(spectra, peaks, ("mz", "intensity", "peak_no")):
        return _cosine_in_blocks(peaks, spectra, max_diff + 2 * pm_tol, tol, least_cosine, least_matched, least_ratio, least_peaks)
    pairs = candidate_pairs(rich, 0.0, max_diff, pm_tol, ("total",))
    both = pairs.select("spec1", "spec2", F.explode(F.array_distinct(F.array(F.lit(0.0), -F.col("delta")))).alias("by"))
    hits = matched_peaks(peaks, both, tol, F.col("by")).select("spec1", "spec2", "i", "j", "int1", "int2").distinct()
    enough = hits.groupBy("spec1", "spec2").agg(F.count("*").alias("c")).where(F.col("c") >= least_matched).select("spec1", "spec2")
    scored = greedy_matches(hits.join(enough, ["spec1", "spec2"]), F.col("int1") * F.col("int2"))
    kept = scored.join(pairs, ["spec1", "spec2"]).where((F.col("score") >= least_cosine) & (F.col("matched") >= least_matched))
    return kept.where((F.col("int1") / F.col("total1") >= least_ratio) & (F.col("int2") / F.col("total2") >= least_ratio)).select("spec1", "spec2", F.nanvl("score", F.lit(0.0)).alias("cosine"), "matched", "delta")


def _cosine_in_blocks(peaks: DataFrame, spectra: DataFrame, high: float, tol: float, least_cosine: float, least_matched: int, least_ratio: float, least_peaks: int) -> DataFrame:
    """``cosine_pairs`` of regular peaks."""
    rows = B.with_arrays(spectra, peaks, numbered=True).where(F.size("mz") >= least_peaks)
    kernel = partial(B.greedy, tol=tol, least=max(1, least_matched), least_score=least_cosine, least_ratio=least_ratio)
    return B.compare(rows, spectra, ("mz", "value", "no"), 0.0, high, kernel, "spec1 long, spec2 long, cosine double, matched int, delta double")


def binned_pairs(binned: DataFrame, spectra: DataFrame, high: float) -> DataFrame | None:
    """spec1, spec2, dot, squares, shared over the bins of pairs with parent masses up to ``high`` apart; None if rows aren't regular. What pairs share is summed where they meet."""
    if not regular(spectra, binned, ("bin", "value")):
        return None
    per = binned.groupBy(F.col("spec_idx").cast("long").alias("id")).agg(F.collect_list(F.struct("bin", "value")).alias("p"))
    per = per.select("id", F.transform("p", lambda x: x.bin).alias("bin"), F.transform("p", lambda x: x.value).alias("value"))
    rows = spectra.select(F.col("spec_idx").cast("long").alias("id"), F.col("parent_mass").cast("double").alias("at")).join(per.hint("merge"), "id")
    return B.share_bins(rows, spectra, high, "spec1 long, spec2 long, dot double, squares double, shared long")


def full_cosine_within(binned: DataFrame, spectra: DataFrame, high: float) -> DataFrame:
    """``full_cosine`` of all pairs with parent masses up to ``high`` apart."""
    found = binned_pairs(binned, spectra, high)
    return full_cosine(binned, candidate_pairs(spectra, 0.0, high)) if found is None else found.select("spec1", "spec2", F.col("dot").alias("cosine"), "shared")


def dot_bias_within(binned: DataFrame, spectra: DataFrame, high: float) -> DataFrame:
    """``dot_bias`` of all pairs with parent masses up to ``high`` apart."""
    found = binned_pairs(binned, spectra, high)
    return dot_bias(binned, candidate_pairs(spectra, 0.0, high)) if found is None else _with_bias(found.select("spec1", "spec2", (F.sqrt("squares") / F.col("dot")).alias("share")))


def _with_bias(x: DataFrame) -> DataFrame:
    s = F.col("share")
    return x.withColumn("bias", F.when((s < 0.1) | ((s > 0.35) & (s <= 0.4)), 0.12).when((s > 0.4) & (s <= 0.45), 0.18).when(s > 0.45, 0.24).otherwise(0.0))


def shifts_within(peaks: DataFrame, spectra: DataFrame, high: float, resolution: float, least: int, best: bool = False) -> DataFrame:
    """``all_shifts`` of all pairs with parent masses up to ``high`` apart, or the ``best_shift`` of each."""
    if not regular(spectra, peaks, ("mz", "intensity")):
        found = all_shifts(peaks, candidate_pairs(spectra, 0.0, high), resolution, least)
        return best_shift(found) if best else found
    kernel = partial(B.best_shifts if best else B.shifts, resolution=resolution, least=least)
    return B.compare(B.with_arrays(spectra, peaks), spectra, ("mz", "value"), 0.0, high, kernel, "spec1 long, spec2 long, shift long, matches long, score double")


def full_cosine(binned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine over bins (spec_idx, bin, value), value of unit length per spectrum; shared counts bins where both are above 0."""
    a = pairs.select("spec1", "spec2").join(binned.select(F.col("spec_idx").alias("spec1"), "bin", F.col("value").alias("v1")), "spec1")
    hit = a.join(binned.select(F.col("spec_idx").alias("spec2"), "bin", F.col("value").alias("v2")), ["spec2", "bin"])
    return hit.groupBy("spec1", "spec2").agg(F.sum(F.col("v1") * F.col("v2")).alias("cosine"), F.count_if((F.col("v1") > 0) & (F.col("v2") > 0)).alias("shared"))


def dot_bias(binned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of the similarity that few peaks make, in steps: sqrt(sum of squared products) / similarity."""
    a = pairs.select("spec1", "spec2").join(binned.select(F.col("spec_idx").alias("spec1"), "bin", F.col("value").alias("v1")), "spec1")
    hit = a.join(binned.select(F.col("spec_idx").alias("spec2"), "bin", F.col("value").alias("v2")), ["spec2", "bin"])
    x = hit.groupBy("spec1", "spec2").agg((F.sqrt(F.sum(F.pow(F.col("v1") * F.col("v2"), 2))) / F.sum(F.col("v1") * F.col("v2"))).alias("share"))
    return _with_bias(x)


def all_shifts(peaks: DataFrame, pairs: DataFrame, resolution: float, least: int) -> DataFrame:
    """Shifts, in units of resolution, that bring at least ``least`` peaks of a pair together, with their count and product."""
    a, b = _sides(peaks, pairs, None)
    shift = F.floor((F.col("mz1") - F.col("mz2")) / resolution + 0.5)
    return a.join(b, ["spec1", "spec2"]).groupBy("spec1", "spec2", shift.alias("shift")).agg(F.count("*").alias("matches"), F.sum(F.col("int1") * F.col("int2")).alias("score")).where(F.col("matches") >= least)


def best_shift(shifts: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("score")).alias("s"), F.abs("shift").alias("a"), "shift", "matches")).alias("b")
    return shifts.groupBy("spec1", "spec2").agg(best).select("spec1", "spec2", "b.shift", "b.matches", (-F.col("b.s")).alias("score"))


def tag_pairs(tags: DataFrame, least: int) -> DataFrame:
    """Pairs of spectra with at least ``least`` equal (tag, tag) pairs; repeats count. Groups of spectra with a common tag are pre-counted, so a hot tag moves counts, not rows."""
    t = tags.groupBy("tag", "spec_idx").agg(F.count("*").alias("n"))
    a, b = t.select("tag", F.col("spec_idx").alias("spec1"), F.col("n").alias("n1")), t.select("tag", F.col("spec_idx").alias("spec2"), F.col("n").alias("n2"))
    return a.join(b, "tag").where("spec1 < spec2").groupBy("spec1", "spec2").agg(F.sum(F.col("n1") * F.col("n2")).alias("common")).where(F.col("common") >= least)


def score_means(pairs: DataFrame) -> DataFrame:
    """For each spectrum, over the pairs it is in: number, mean and standard deviation of its own side's score."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("spec1").alias("spec_idx"), F.col("score1").alias("score")), F.struct(F.col("spec2").alias("spec_idx"), F.col("score2").alias("score")))).alias("e")).select("e.*")
    return ends.groupBy("spec_idx").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("score") * F.col("score")) - F.pow(F.avg("score"), 2))).alias("sd"))


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + PHI_STEP * F.abs(z))
    poly = F.lit(PHI[-1])
    for b in reversed(PHI[:-1]):
        poly = poly * t + b
    tail = PHI_SCALE * F.exp(-z * z / 2) * t * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def p_values(pairs: DataFrame, stats: DataFrame, least_sd: float = 1e-6) -> DataFrame:
    """p1 and p2: upper tail of each side's score under its spectrum's mean and deviation; pairs with a side that doesn't vary go."""
    s1 = stats.select(F.col("spec_idx").alias("spec1"), F.col("mean").alias("m1"), F.col("sd").alias("d1"))
    s2 = stats.select(F.col("spec_idx").alias("spec2"), F.col("mean").alias("m2"), F.col("sd").alias("d2"))
    j = pairs.join(s1, "spec1").join(s2, "spec2").where((F.col("d1") >= least_sd) & (F.col("d2") >= least_sd))
    j = j.withColumn("p1", 1 - normal_cdf((F.col("score1") - F.col("m1")) / F.col("d1"))).withColumn("p2", 1 - normal_cdf((F.col("score2") - F.col("m2")) / F.col("d2")))
    return j.select(*pairs.columns, "p1", "p2")


def match_ratios(pairs: DataFrame, peaks: DataFrame, spectra: DataFrame, against_rest: bool = True, edge: float = 56.0) -> DataFrame:
    """Score of each side over the intensity that could match (or over what of it doesn't): peaks beyond ``edge`` from the ends of the overlap."""
    mass = spectra.select("spec_idx", "parent_mass")
    p = pairs.join(mass.withColumnsRenamed({"spec_idx": "spec1", "parent_mass": "pm1"}), "spec1").join(mass.withColumnsRenamed({"spec_idx": "spec2", "parent_mass": "pm2"}), "spec2")
    p = p.withColumn("overlap", F.least("pm1", "pm2"))
    for side in ("1", "2"):
        own = peaks.select(F.col("spec_idx").alias(f"spec{side}"), "mz", "intensity")
        inner = (F.col("mz") > edge) & (F.col("mz") <= F.col("overlap") - edge)
        outer = (F.col("mz") > F.greatest(F.col(f"pm{side}") - F.col("overlap") + edge, F.col("overlap") - edge)) & (F.col("mz") <= F.col(f"pm{side}") - edge)
        sums = p.select("spec1", "spec2", "overlap", f"pm{side}").join(own, f"spec{side}").groupBy("spec1", "spec2").agg(F.sum(F.when(inner | outer, F.col("intensity")).otherwise(0.0)).alias(f"total{side}"))
        p = p.join(sums, ["spec1", "spec2"], "left").withColumn(f"total{side}", F.coalesce(f"total{side}", F.lit(0.0)))
        score, rest = F.col(f"score{side}"), F.col(f"total{side}") - F.col(f"score{side}")
        ratio = F.when(rest > 1, score / rest).otherwise(1.0) if against_rest else F.try_divide(score, F.col(f"total{side}"))
        p = p.withColumn(f"ratio{side}", F.greatest(F.lit(0.0), ratio))
    return p.select(*pairs.columns, "ratio1", "ratio2")


def filter_aligns(pairs: DataFrame, stats: DataFrame, most_p: float, ratios: DataFrame | None = None, least_ratio: float = 0.0) -> DataFrame:
    """Pairs whose p-values are both small enough and, where given, whose ratios are both large enough."""
    kept = p_values(pairs, stats).where((F.col("p1") <= most_p) & (F.col("p2") <= most_p))
    if ratios is not None:
        good = ratios.where((F.col("ratio1") >= least_ratio) & (F.col("ratio2") >= least_ratio)).select("spec1", "spec2")
        kept = kept.join(good, ["spec1", "spec2"], "left_semi")
    return kept


def silac_pairs(spectra: DataFrame, deltas: list[float], tol: float) -> DataFrame:
    """Spectra of the same charge whose parent masses differ by a label's mass."""
    s = spectra.select("spec_idx", "parent_mass", "parent_charge")
    right = s.select(F.col("spec_idx").alias("heavy"), "parent_charge", F.col("parent_mass").alias("heavy_mass"), F.explode(F.array(*[F.lit(float(x)) for x in deltas])).alias("label"))
    right = right.withColumn("light_mass", F.col("heavy_mass") - F.col("label"))
    return band_join(s, right, "parent_mass", "light_mass", tol, ["parent_charge"]).select(F.col("spec_idx").alias("light"), "heavy", "label")


def quality_of_pairs(psms: DataFrame, detected: DataFrame, edges: list[int]) -> DataFrame:
    """Of all pairs of matches with one peptide group and equal charge: how many were detected, by class of overlap.

    psms: spec_idx, peptide, charge, first, last (residues); detected: spec1, spec2. The pairs of one peptide are joined on
    (peptide, charge) and summed in the same stage.
    """
    a = psms.select("peptide", "charge", F.col("spec_idx").alias("spec1"), F.col("first").alias("f1"), F.col("last").alias("l1"))
    b = psms.select("peptide", "charge", F.col("spec_idx").alias("spec2"), F.col("first").alias("f2"), F.col("last").alias("l2"))
    overlap = F.least("l1", "l2") - F.greatest("f1", "f2") + 1
    true = a.join(b, ["peptide", "charge"]).where("spec1 < spec2").withColumn("overlap", overlap).where("overlap > 0")
    klass = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("overlap")))
    seen = true.join(detected.select("spec1", "spec2", F.lit(True).alias("hit")), ["spec1", "spec2"], "left")
    return seen.groupBy(klass.alias("class")).agg(F.count("*").alias("pairs"), F.count("hit").alias("detected")).withColumn("sensitivity", F.col("detected") / F.col("pairs"))


def binned_match(left: DataFrame, right: DataFrame, width: float = 1e-5) -> DataFrame:
    """Equal masses (to ``width``) of two peak lists: bin, both intensities."""
    b = lambda df, name: df.groupBy(F.floor(F.col("mz") / width + 0.5).alias("bin")).agg(F.sum("intensity").alias(name))
    return b(left, "int1").join(b(right, "int2"), "bin")


