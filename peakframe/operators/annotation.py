"""Matching of theoretical ions to peaks, spectra to peptides, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from .band_join import SLACK, band_join


def theoretical(matches: DataFrame) -> DataFrame:
    """spec_idx, peptide, ion, position, ion_mz of matches (spec_idx, peptide)."""
    return matches.select("spec_idx", "peptide", F.explode(P.theoretical_ions("peptide")).alias("x")).select("spec_idx", "peptide", "x.ion", "x.position", F.col("x.mz").alias("ion_mz"))


def annotate(peaks: DataFrame, matches: DataFrame, tol: float) -> DataFrame:
    """Peaks within tolerance of an ion of their spectrum's peptide: spec_idx, peptide, ion, position, ion_mz, peak_no, mz, intensity.

    A spectrum's peaks meet its peptides as one list and are compared within the row: ions are neither shuffled nor, where
    the planner takes the exploded table for a small one, sent to all tasks.
    """
    lists = peaks.groupBy("spec_idx").agg(F.collect_list(F.struct("peak_no", "mz", "intensity")).alias("p"))
    both = matches.select("spec_idx", "peptide").join(lists.hint("merge"), "spec_idx")
    ions = both.select("spec_idx", "peptide", "p", F.explode(P.theoretical_ions("peptide")).alias("x"))
    near = F.filter("p", lambda k: F.abs(F.col("x.mz") - k.mz) <= tol + SLACK)
    hit = ions.select("spec_idx", "peptide", "x.ion", "x.position", F.col("x.mz").alias("ion_mz"), F.explode(near).alias("k"))
    return hit.select("spec_idx", "peptide", "ion", "position", "ion_mz", "k.peak_no", "k.mz", "k.intensity")


def extract_ions(annotated: DataFrame, ions: list[str], longest: int) -> DataFrame:
    """A fixed-length vector for each spectrum: the summed intensity of each ion type and position."""
    per = annotated.groupBy("spec_idx", "ion", "position").agg(F.sum("intensity").alias("i"))
    m = per.groupBy("spec_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "ion", "position"), "i"))).alias("m"))
    keys = F.array(*[F.lit(f"{ion}:{k}") for ion in ions for k in range(1, longest + 1)])
    return m.select("spec_idx", F.transform(keys, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("vector"))


def error_histogram(annotated: DataFrame, width: float, ppm: bool = False) -> DataFrame:
    """bin, ions: differences of peak and ion in daltons, or in parts per million, by bins of ``width``."""
    gap = F.col("mz") - F.col("ion_mz")
    return annotated.groupBy(F.floor((gap / F.col("ion_mz") * 1e6 if ppm else gap) / width).alias("bin")).agg(F.count("*").alias("ions"))


def best_peptide(peaks: DataFrame, candidates: DataFrame, tol: float) -> DataFrame:
    """For each spectrum the candidate peptide with the largest summed intensity of matched peaks (a peak counts once): spec_idx, peptide, score, matched."""
    hit = annotate(peaks, candidates, tol).select("spec_idx", "peptide", "peak_no", "mz", "intensity").distinct()
    scored = hit.groupBy("spec_idx", "peptide").agg(F.sum("intensity").alias("score"), F.count("*").alias("matched"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "peptide", "matched")).alias("b")
    return scored.groupBy("spec_idx").agg(best).select("spec_idx", "b.peptide", (-F.col("b.s")).alias("score"), "b.matched")


def penalties(frequencies: DataFrame, unknown: float, least: float = 1e-6) -> DataFrame:
    """bin, penalty: the logarithm of each modification's frequency against the highest, ``unknown`` for one never met."""
    top = frequencies.agg(F.max("frequency")).scalar()
    return frequencies.select("bin", F.when(F.col("frequency") > 0, F.greatest(F.ln(F.greatest(F.col("frequency"), F.lit(least)) / top), F.lit(unknown))).otherwise(unknown).alias("penalty"))


def substitution_penalties(matrix: DataFrame) -> DataFrame:
    """a, b, penalty: a substitution's score less that of keeping the residue."""
    own = matrix.where("a = b").select("a", F.col("score").alias("own"))
    return matrix.join(F.broadcast(own), "a").select("a", "b", (F.col("score") - F.col("own")).alias("penalty"))


def propagate(edges: DataFrame, known: DataFrame) -> DataFrame:
    """One step of propagation: spectra without a peptide take that of their best-scoring annotated neighbour: spec_idx, peptide, source, score."""
    both = edges.select(F.col("spec1").alias("spec_idx"), F.col("spec2").alias("source"), "score1").unionByName(edges.select(F.col("spec2").alias("spec_idx"), F.col("spec1").alias("source"), "score1"))
    near = both.join(known.select(F.col("spec_idx").alias("source"), "peptide"), "source").join(known.select("spec_idx"), "spec_idx", "left_anti")
    best = F.min(F.struct((-F.col("score1")).alias("s"), "source", "peptide")).alias("b")
    return near.groupBy("spec_idx").agg(best).select("spec_idx", "b.peptide", "b.source", (-F.col("b.s")).alias("score"))


def pair_modified(psms: DataFrame, peptide: str = "annotation") -> DataFrame:
    """Modified matches with the best unmodified match of the same bare peptide and charge."""
    bare = psms.withColumn("bare", P.unmodified(peptide)).withColumn("modified", F.col(peptide).rlike(r"[(\[]"))
    w = Window.partitionBy("bare", "charge").orderBy(F.desc("score"), "spec_idx")
    plain = bare.where("not modified").withColumn("r", F.row_number().over(w)).where("r = 1").select("bare", "charge", F.col("spec_idx").alias("plain_idx"), F.col("score").alias("plain_score"))
    return bare.where("modified").join(plain, ["bare", "charge"]).select("spec_idx", peptide, "bare", "charge", "plain_idx", "plain_score")


def guess_charge(spectra: DataFrame, survey: DataFrame, charges: list[int], tol: float, step: float = 1.007825035) -> DataFrame:
    """For each spectrum (spec_idx, survey_idx, parent_mz) the charge whose second isotope is strongest in its survey scan; the lower charge of equal ones."""
    at = spectra.select("spec_idx", F.col("survey_idx").alias("scan"), "parent_mz", F.explode(F.array(*[F.lit(z) for z in charges])).alias("charge")).withColumn("isotope", F.col("parent_mz") + step / F.col("charge"))
    hit = band_join(at, survey.select(F.col("spec_idx").alias("scan"), "mz", "intensity"), "isotope", "mz", tol, ["scan"])
    per = hit.groupBy("spec_idx", "charge").agg(F.sum("intensity").alias("i"))
    return per.groupBy("spec_idx").agg(F.min(F.struct((-F.col("i")).alias("s"), "charge")).alias("b")).select("spec_idx", "b.charge")
