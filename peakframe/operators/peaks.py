"""Operators on peak lists, on exploded rows (spec_idx, peak_no, mz, intensity).

Each takes and gives a DataFrame of peaks. Windows are partitioned by spectrum; where peaks tie, all columns
break the tie, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .band_join import band_join

#: Masses of a hydrogen with its electron, and of water.
HYDROGEN, WATER = 1.007825035, 18.010564686
KEY = "spec_idx"


def _per() -> Window:
    return Window.partitionBy(KEY)


def normalize_total(peaks: DataFrame, total: float = 100.0) -> DataFrame:
    """Intensities scaled so that they sum to ``total``; null where they sum to 0."""
    return peaks.withColumn("intensity", F.try_divide(F.col("intensity") * total, F.sum("intensity").over(_per())))


def normalize_l2(peaks: DataFrame, norm: float = 1.0) -> DataFrame:
    return peaks.withColumn("intensity", F.try_divide(F.col("intensity"), F.sqrt(F.sum(F.col("intensity") * F.col("intensity")).over(_per())) / norm))


def transform_l2(peaks: DataFrame, how: str = "sqrt") -> DataFrame:
    """Square root, or logarithm of one more than the intensities (so that 0 stays 0), then unit length."""
    f = {"sqrt": F.sqrt, "log": F.log1p, "none": lambda c: c}[how]
    return normalize_l2(peaks.withColumn("intensity", f(F.col("intensity"))))


def normalize_max(peaks: DataFrame, top: float = 1.0) -> DataFrame:
    return peaks.withColumn("intensity", F.try_divide(F.col("intensity") * top, F.max("intensity").over(_per())))


def total_ion_current(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy(KEY).agg(F.sum("intensity").alias("tic"))


def peak_density(peaks: DataFrame, spectra: DataFrame) -> DataFrame:
    """Peaks for each unit of parent mass."""
    n = peaks.groupBy(KEY).agg(F.count("*").alias("n"))
    return spectra.join(n, KEY, "left").select(KEY, F.try_divide(F.coalesce("n", F.lit(0)), F.col("parent_mass")).alias("density"))


def bin_peaks(peaks: DataFrame, resolution: float) -> DataFrame:
    """Masses in units of ``resolution``, rounded half up; intensities of a bin are added."""
    b = F.floor(F.col("mz") / resolution + 0.5)
    return peaks.groupBy(KEY, b.alias("bin")).agg(F.sum("intensity").alias("intensity"))


def round_peaks(peaks: DataFrame) -> DataFrame:
    return peaks.withColumn("mz", F.floor(F.col("mz") + 0.5).cast("double"))


def min_intensity(peaks: DataFrame, least: float) -> DataFrame:
    return peaks.where(F.col("intensity") >= least)


def mass_range(peaks: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Peaks within [low, high]; the lightest peak of a spectrum stays whatever ``high`` is."""
    if low is not None:
        peaks = peaks.where(F.col("mz") >= low)
    if high is not None:
        peaks = peaks.withColumn("__least", F.min("mz").over(_per())).where((F.col("mz") <= high) | (F.col("mz") == F.col("__least"))).drop("__least")
    return peaks


def min_peaks(peaks: DataFrame, least: int) -> DataFrame:
    """Empties spectra with fewer peaks."""
    return peaks.withColumn("__n", F.count("*").over(_per())).where(F.col("__n") >= least).drop("__n")


def top_k(peaks: DataFrame, k: int) -> DataFrame:
    w = _per().orderBy(F.desc("intensity"), "mz", "peak_no")
    return peaks.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def bucket_top_k(peaks: DataFrame, width: float, k: int) -> DataFrame:
    """The k strongest peaks of each bucket of mass."""
    w = Window.partitionBy(KEY, F.floor(F.col("mz") / width)).orderBy(F.desc("intensity"), "mz", "peak_no")
    return peaks.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def _neighbours(peaks: DataFrame, low: float, high: float) -> DataFrame:
    """Each peak with the array of (intensity, mz, peak_no) of the spectrum's peaks within [mz + low, mz + high]."""
    def bound(x: float) -> str:
        return f"{abs(x)!r}D {'preceding' if x < 0 else 'following'}"

    near = f"collect_list(struct(mz, intensity, peak_no)) over (partition by {KEY} order by mz range between {bound(low)} and {bound(high)})"
    return peaks.withColumn("__near", F.expr(near))


def window_top_k(peaks: DataFrame, low: float, high: float, k: int) -> DataFrame:
    """Peaks among the k strongest within [mz + low, mz + high); of equal ones the heavier is stronger."""
    ahead = F.size(F.filter("__near", lambda x: (x.mz < F.col("mz") + high) & ((x.intensity > F.col("intensity")) | ((x.intensity == F.col("intensity")) & (x.mz > F.col("mz"))))))
    return _neighbours(peaks, low, high).where(ahead < k).drop("__near")


def rank_filter(peaks: DataFrame, radius: float, max_rank: int) -> DataFrame:
    """Peaks whose dense rank by intensity among those strictly within ``radius`` is at most ``max_rank``."""
    stronger = F.filter("__near", lambda x: (F.abs(x.mz - F.col("mz")) < radius) & (x.intensity > F.col("intensity")))
    rank = F.size(F.array_distinct(F.transform(stronger, lambda x: x.intensity)))
    return _neighbours(peaks, -radius, radius).where(rank < max_rank).drop("__near")


def noise_filter(peaks: DataFrame, k: float, least: int = 10) -> DataFrame:
    """Drops peaks at or below mean + k standard deviations of the lowest quarter, in spectra of ``least`` or more peaks."""
    w = _per().orderBy("intensity", "mz", "peak_no")
    ranked = peaks.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(_per()))
    low = F.when(F.col("__r") <= F.floor(F.col("__n") / 4), F.col("intensity"))
    bar = F.avg(low).over(_per()) + k * F.stddev_pop(low).over(_per())
    return ranked.withColumn("__bar", F.when(F.col("__n") >= least, bar)).where("__bar is null or intensity > __bar").drop("__r", "__n", "__bar")


def precursor_filter(peaks: DataFrame, spectra: DataFrame, below: float = 17.0, above: float = 15.0) -> DataFrame:
    """Drops peaks strictly within (m/z - below, m/z + above) of the precursor."""
    mz = F.col("parent_mass") / F.col("parent_charge")
    p = spectra.select(KEY, mz.alias("__p"))
    return peaks.join(p, KEY).where((F.col("mz") <= F.col("__p") - below) | (F.col("mz") >= F.col("__p") + above)).drop("__p")


def charge_reduced_filter(peaks: DataFrame, spectra: DataFrame, tol: float, strength: float) -> DataFrame:
    """Drops peaks near the precursor at any charge up to its own, if at least ``strength`` times the median intensity."""
    w = _per().orderBy("intensity", "mz", "peak_no")
    ranked = peaks.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(_per()))
    ranked = ranked.withColumn("__median", F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2), F.col("intensity"))).over(_per()))
    p = spectra.select(KEY, F.col("parent_mass").alias("__mass"), F.col("parent_charge").alias("__z"))
    near = F.exists(F.sequence(F.lit(1), F.col("__z")), lambda z: F.abs(F.col("mz") - (F.col("__mass") + (z - 1) * HYDROGEN) / z) <= tol)
    kept = ranked.join(p, KEY).where(~(near & (F.col("intensity") >= strength * F.col("__median"))))
    return kept.drop("__r", "__n", "__median", "__mass", "__z")


def reverse_peaks(peaks: DataFrame, spectra: DataFrame, offset: float = 0.0) -> DataFrame:
    """Masses seen from the other end: parent mass - H + offset - mz."""
    p = spectra.select(KEY, F.col("parent_mass").alias("__mass"))
    return peaks.join(p, KEY).withColumn("mz", F.col("__mass") - HYDROGEN + offset - F.col("mz")).drop("__mass")


def rotate_peaks(peaks: DataFrame, spectra: DataFrame, by: float) -> DataFrame:
    """Masses shifted by ``by`` and wrapped at the parent mass."""
    p = spectra.select(KEY, F.col("parent_mass").alias("__mass"))
    return peaks.join(p, KEY).withColumn("mz", F.expr(f"pmod(mz + {by}D, __mass)")).drop("__mass")


def symmetric_pairs(peaks: DataFrame, spectra: DataFrame, tol: float, offset: float = HYDROGEN) -> DataFrame:
    """Pairs of peaks whose masses add to the parent mass less ``offset``, the lighter first."""
    right = peaks.join(spectra.select(KEY, "parent_mass"), KEY).select(KEY, (F.col("parent_mass") - offset - F.col("mz")).alias("complement"), F.col("mz").alias("mz2"), F.col("intensity").alias("intensity2"))
    return band_join(peaks.select(KEY, "mz", "intensity"), right, "mz", "complement", tol, [KEY]).where("mz <= mz2").drop("complement")


def make_symmetric(peaks: DataFrame, spectra: DataFrame, tol: float, offset: float = HYDROGEN) -> DataFrame:
    """Adds, with intensity 0, the complements that have no peak near."""
    need = peaks.join(spectra.select(KEY, "parent_mass"), KEY).select(KEY, (F.col("parent_mass") - offset - F.col("mz")).alias("complement")).where("complement >= 0").distinct()
    missing = band_join(need, peaks.select(KEY, F.col("mz").alias("have")), "complement", "have", tol, [KEY], how="left_anti")
    return peaks.select(KEY, "mz", "intensity").unionByName(missing.select(KEY, F.col("complement").alias("mz"), F.lit(0.0).alias("intensity")))


def add_endpoints(peaks: DataFrame, spectra: DataFrame, tol: float, ion_offset: float = 0.0, y_too: bool = False, intensity: float = 0.1) -> DataFrame:
    """Adds b0 and bk (and y0 and yk) with a small intensity where no peak lies within tolerance."""
    ends = [F.lit(ion_offset), F.col("parent_mass") - HYDROGEN - WATER + ion_offset]
    if y_too:
        ends += [F.lit(WATER + ion_offset), F.col("parent_mass") - HYDROGEN + ion_offset]
    e = spectra.select(KEY, F.explode(F.array(*ends)).alias("end"))
    missing = band_join(e, peaks.select(KEY, F.col("mz").alias("have")), "end", "have", tol, [KEY], how="left_anti")
    return peaks.select(KEY, "mz", "intensity").unionByName(missing.select(KEY, F.col("end").alias("mz"), F.lit(intensity).alias("intensity")))


def maximize_endpoints(peaks: DataFrame, spectra: DataFrame, tol: float) -> DataFrame:
    """Peaks near 0 or near the end get the spectrum's largest intensity."""
    p = spectra.select(KEY, F.col("parent_mass").alias("__mass"))
    at_end = (F.col("mz") <= tol) | (F.abs(F.col("mz") - (F.col("__mass") - HYDROGEN - WATER)) <= tol)
    top = F.max("intensity").over(_per())
    return peaks.join(p, KEY).withColumn("intensity", F.when(at_end, top).otherwise(F.col("intensity"))).drop("__mass")


def ppm_tolerance(peaks: DataFrame, ppm: float) -> DataFrame:
    return peaks.withColumn("tol", F.col("mz") * ppm * 1e-6)


def to_charge_one(peaks: DataFrame, charge: Column) -> DataFrame:
    return peaks.withColumn("mz", F.col("mz") * charge - (charge - 1) * HYDROGEN)


def closest_peak(peaks: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (spec_idx, target) the peak nearest in mass, the lighter of two equally near."""
    gap = F.abs(F.col("mz") - F.col("target"))
    return targets.join(peaks, KEY).groupBy(KEY, "target").agg(F.min(F.struct(gap.alias("gap"), "mz", "intensity")).alias("b")).select(KEY, "target", "b.mz", "b.gap")


def find_in_range(peaks: DataFrame, targets: DataFrame, tol: float) -> DataFrame:
    """All peaks within tolerance of each target."""
    return band_join(targets, peaks, "target", "mz", tol, [KEY])


def consolidate(peaks: DataFrame, tol: float) -> DataFrame:
    """Runs of peaks, each within ``tol`` of the one before, become their strongest member with the summed intensity."""
    order = _per().orderBy("mz", "peak_no")
    new = F.when(F.col("mz") - F.lag("mz").over(order) <= tol, 0).otherwise(1)
    runs = peaks.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    strongest = F.max(F.struct("intensity", (-F.col("mz")).alias("m"))).alias("b")
    return runs.groupBy(KEY, "__run").agg(strongest, F.sum("intensity").alias("total")).select(KEY, (-F.col("b.m")).alias("mz"), F.col("total").alias("intensity"))


def weighted_average(peaks: DataFrame, by: list[str]) -> DataFrame:
    """Mean mass weighted by intensity; plain where the weights sum to about 0. Negative intensities are lifted by the least first."""
    low = F.min("intensity").over(Window.partitionBy(*by))
    lifted = F.when(low < 0, F.col("intensity") - low).otherwise(F.col("intensity"))
    p = peaks.withColumn("__i", lifted)
    total = F.sum("__i")
    return p.groupBy(*by).agg(F.when(F.abs(total) < 1e-9, F.avg("mz")).otherwise(F.sum(F.col("mz") * F.col("__i")) / total).alias("mz"), F.when(F.abs(total) < 1e-9, 0.0).otherwise(F.sum("intensity")).alias("intensity"))


def merge_ranges(peaks: DataFrame, by: list[str], rule: str) -> DataFrame:
    """One mass for a group: that of the least tolerance, the weighted average, that of the most intense, or the first."""
    tie = [F.col("mz"), F.col("peak_no")]
    pick = {
        "tolerance": F.min(F.struct(F.col("tol"), *tie))["mz"] if "tol" in peaks.columns else None,
        "average": F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity"),
        "intense": -F.max(F.struct(F.col("intensity"), (-F.col("mz")).alias("m")))["m"],
        "first": F.min(F.struct(F.col("peak_no"), F.col("mz")))["mz"],
    }[rule]
    return peaks.groupBy(*by).agg(pick.alias("mz"), F.sum("intensity").alias("intensity"))


def isotope_combine(ions: DataFrame) -> DataFrame:
    """Intensities of ``name-iso`` ions added to those of ``name``."""
    return ions.groupBy(KEY, F.regexp_replace("ion", "-iso$", "").alias("ion")).agg(F.sum("intensity").alias("intensity"))


def envelope(peaks: DataFrame, precursors: DataFrame, isotopes: int, tol: float) -> DataFrame:
    """Summed intensity at each isotope's mass (precursors: spec_idx, mono, charge), a row for each precursor and isotope."""
    at = precursors.select(KEY, "mono", "charge", F.explode(F.sequence(F.lit(0), F.lit(isotopes - 1))).alias("isotope")).withColumn("target", F.col("mono") + F.col("isotope") * HYDROGEN / F.col("charge"))
    hit = band_join(at, peaks.select(KEY, "mz", "intensity"), "target", "mz", tol, [KEY], how="left")
    return hit.groupBy(KEY, "mono", "charge", "isotope").agg(F.coalesce(F.sum("intensity"), F.lit(0.0)).alias("intensity"))


#: Ion types that a scoring model may have.
MOST_IONS = 1_000


def peak_scores(peaks: DataFrame, candidates: DataFrame, ions: DataFrame, tol: float, noise: float) -> DataFrame:
    """For each (spec_idx, mass): sum over ion types of log(p / noise) where the ion is seen, else log((1 - p) / (1 - noise)). ions: name, mass_offset, prob - a model of at most ``MOST_IONS`` rows, read when the plan is built."""
    model = ions.select("name", "mass_offset", "prob").limit(MOST_IONS + 1).collect()
    if len(model) > MOST_IONS:
        raise ValueError(f"an ion model has at most {MOST_IONS} ions")
    each = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(float(r.mass_offset)).alias("mass_offset"), F.lit(float(r.prob)).alias("prob")) for r in model]) if model else F.array().cast("array<struct<name:string,mass_offset:double,prob:double>>")
    expected = candidates.withColumn("__ion", F.explode(each)).select(*candidates.columns, "__ion.*").withColumn("ion_mz", F.col("mass") + F.col("mass_offset"))
    p = peaks.select(KEY, F.col("mz").alias("seen"))
    seen = band_join(expected, p, "ion_mz", "seen", tol, [KEY], how="left").groupBy(KEY, "mass", "name", "prob").agg((F.count("seen") > 0).alias("seen"))
    term = F.when(F.col("seen"), F.ln(F.col("prob") / noise)).otherwise(F.ln((1 - F.col("prob")) / (1 - noise)))
    return seen.groupBy(KEY, "mass").agg(F.sum(term).alias("score"))
