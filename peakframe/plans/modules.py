"""Named modules: an operator with checked parameters, run over named inputs.

``run("filter_pairs", options, inputs)`` checks that the inputs and required options are there, converts the
options and returns the lazy result. ``execute`` takes KEY=VALUE text instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, library, pairs, peaks, proteins, psm_filters, psms, reports
from ..sources.tables import read_parameters


class ModuleError(ValueError):
    pass


@dataclass(frozen=True)
class Module:
    run: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    options: dict[str, type] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


def _merge_convert(
    spectra_peaks: DataFrame, spectra: DataFrame, min_charge: int, max_charge: int, activation: str, set_charge: int, mass_offset: float, absolute: bool, min_mass: float, max_mass: float, min_intensity: float,
    min_peaks: int, top_k: int, bucket: float, bucket_top_k: int, rank: int, radius: float, noise: float, precursor_filter: bool, endpoints: bool, normalize: str, rounded: bool, resolution: float,
) -> DataFrame:
    """The steps in a fixed order, each left out at its default: spectra by charge and activation, masses and intensities, choice of peaks, scale, bins."""
    s = spectra
    if min_charge or max_charge:
        s = s.where(F.col("parent_charge").between(min_charge, max_charge or 1_000_000))
    if activation:
        s = psm_filters.by_activation(s, activation)
    if set_charge:
        s = s.withColumn("parent_charge", F.lit(set_charge))
    p = spectra_peaks.join(s.select("spec_idx"), "spec_idx", "left_semi") if s is not spectra else spectra_peaks
    p = p.withColumn("mz", F.col("mz") + mass_offset) if mass_offset else p
    p = p.withColumn("intensity", F.abs("intensity")) if absolute else p
    p = peaks.min_intensity(peaks.mass_range(p, min_mass, max_mass), min_intensity)
    p = peaks.precursor_filter(p, s) if precursor_filter else p
    p = peaks.noise_filter(p, noise) if noise else p
    p = peaks.rank_filter(p, radius, rank) if rank else p
    p = peaks.bucket_top_k(p, bucket, bucket_top_k) if bucket_top_k else p
    p = peaks.top_k(p, top_k) if top_k else p
    p = peaks.min_peaks(p, min_peaks) if min_peaks else p
    p = peaks.add_endpoints(p, s, 1.0) if endpoints else p
    if normalize:
        p = {"total": peaks.normalize_total, "l2": peaks.normalize_l2, "max": peaks.normalize_max, "sqrt": peaks.transform_l2}[normalize](p)
    p = peaks.round_peaks(p) if rounded else p
    return peaks.bin_peaks(p, resolution) if resolution else p


def _filter_pairs(spectra_peaks: DataFrame, spectra: DataFrame, max_mod_mass: float, tolerance_pm: float, tolerance_peak: float, min_cosine: float, min_matched_peaks: int, min_ratio: float) -> DataFrame:
    return pairs.cosine_pairs(peaks.transform_l2(spectra_peaks, "sqrt"), spectra, max_mod_mass, tolerance_pm, tolerance_peak, min_cosine, min_matched_peaks, min_ratio)


def _filter_aligns(scored: DataFrame, max_pvalue: float, filter_trigs: bool, tolerance_pm: float) -> DataFrame:
    kept = pairs.filter_aligns(scored, pairs.score_means(scored), max_pvalue)
    return graph.filter_triangles(kept, tolerance_pm) if filter_trigs else kept


def _fdr(matches: DataFrame, tda_type: str, scale: float, cutoff: float) -> DataFrame:
    scored = {"concatenated": psms.concatenated_fdr, "separate": psms.separate_fdr}[tda_type](matches, scale)
    return psms.fdr_cutoff(scored, cutoff)


def _library_search(queries: DataFrame, entries: DataFrame, query_peaks: DataFrame, entry_peaks: DataFrame, tolerance: float, quality: int, resolution: float, top_hits: int, score_threshold: float) -> DataFrame:
    """queries: query, query_mz; entries: lib_idx, parent_mz, library_quality; peaks of both by spec_idx. Scored by the cosine of the roots of binned intensities."""
    found = library.candidates(queries, entries, tolerance, quality)
    binned = lambda p, name: peaks.transform_l2(peaks.bin_peaks(p, resolution), "sqrt").select(F.col("spec_idx").alias(name), "bin", F.col("intensity").alias("value"))
    return library.top_hits(library.similarity(found, binned(query_peaks, "query"), binned(entry_peaks, "lib_idx")), top_hits, score_threshold)


def _cluster_info(members: DataFrame, most_groups: int) -> DataFrame:
    groups = sorted(r[0] for r in members.select("file_group").distinct().limit(most_groups + 1).collect())
    if len(groups) > most_groups:
        raise ModuleError(f"over {most_groups} file groups: a column for each is too wide a table")
    return reports.cluster_summary(members, groups)


MODULES: dict[str, Module] = {
    "merge_convert": Module(_merge_convert, ("spectra_peaks", "spectra"),
        {"min_charge": int, "max_charge": int, "activation": str, "set_charge": int, "mass_offset": float, "absolute": bool, "min_mass": float, "max_mass": float, "min_intensity": float, "min_peaks": int, "top_k": int, "bucket": float, "bucket_top_k": int, "rank": int, "radius": float, "noise": float, "precursor_filter": bool, "endpoints": bool, "normalize": str, "rounded": bool, "resolution": float},
        {"min_charge": 0, "max_charge": 0, "activation": "", "set_charge": 0, "mass_offset": 0.0, "absolute": False, "min_mass": 0.0, "max_mass": 1e9, "min_intensity": 0.0, "min_peaks": 0, "top_k": 0, "bucket": 100.0, "bucket_top_k": 0, "rank": 0, "radius": 50.0, "noise": 0.0, "precursor_filter": False, "endpoints": False, "normalize": "", "rounded": False, "resolution": 0.0}),
    "filter_pairs": Module(_filter_pairs, ("spectra_peaks", "spectra"), {"max_mod_mass": float, "tolerance_pm": float, "tolerance_peak": float, "min_cosine": float, "min_matched_peaks": int, "min_ratio": float}, {"max_mod_mass": 100.0, "tolerance_pm": 1.5, "tolerance_peak": 0.4, "min_cosine": 0.6, "min_matched_peaks": 6, "min_ratio": 0.35}),
    "filter_aligns": Module(_filter_aligns, ("scored",), {"max_pvalue": float, "filter_trigs": bool, "tolerance_pm": float}, {"max_pvalue": 0.045, "filter_trigs": False, "tolerance_pm": 1.5}),
    "fdr_peptide": Module(_fdr, ("matches",), {"tda_type": str, "scale": float, "cutoff": float}, {"tda_type": "concatenated", "scale": 1.0}),
    "library_search": Module(_library_search, ("queries", "entries", "query_peaks", "entry_peaks"), {"tolerance": float, "quality": int, "resolution": float, "top_hits": int, "score_threshold": float}, {"quality": 3, "resolution": 1.0, "top_hits": 1, "score_threshold": 0.0}),
    "create_library": Module(lambda entries, new: library.upsert(entries, new, ["lib_idx"]), ("entries", "new")),
    "library_decoys": Module(library.with_decoys, ("entries",)),
    "parsimony": Module(lambda matches: psms.parsimony(matches), ("matches",)),
    "qc_spectral_pairs": Module(lambda matches, detected: pairs.quality_of_pairs(matches, detected, [4, 6, 8]), ("matches", "detected")),
    "statistics": Module(lambda annotated, spectra, ion_types: reports.annotation_stats(annotated, spectra, ion_types), ("annotated", "spectra"), {"ion_types": int}, {"ion_types": 2}),
    "report_project_stats": Module(reports.project_stats, ("contigs",)),
    "protein_coverage": Module(proteins.coverage, ("proteins", "hits")),
    "tag_search": Module(lambda proteins_, tags, tag_len, tolerance, min_flanks: proteins.find_tags(proteins_, tags, tag_len, tolerance, min_flanks), ("proteins_", "tags"), {"tag_len": int, "tolerance": float, "min_flanks": int}, {"tag_len": 6, "tolerance": 0.4, "min_flanks": 1}),
    "cluster_info": Module(_cluster_info, ("members",), {"most_groups": int}, {"most_groups": 1000}),
    "pairs_info": Module(lambda scored, top_k, component_size: graph.cap_component_size(graph.top_k_edges(scored, top_k), component_size) if component_size else graph.top_k_edges(scored, top_k), ("scored",), {"top_k": int, "component_size": int}, {"top_k": 10, "component_size": 0}),
    "spectra_extraction": Module(lambda spectra, wanted: spectra.join(wanted, [c for c in wanted.columns if c in spectra.columns], "left_semi"), ("spectra", "wanted")),
    "library_view": Module(lambda entries, sort, first, rows: reports.page(entries, sort, first, rows, ties=["lib_idx"]), ("entries",), {"sort": str, "first": int, "rows": int}, {"sort": "parent_mz", "first": 0, "rows": 50}),
    "spectra_update": Module(lambda spectra, spec_idx, column, value: reports.update(spectra, F.col("spec_idx") == spec_idx, column, value), ("spectra",), {"spec_idx": int, "column": str, "value": str}),
    "activation_filter": Module(lambda spectra, kind: psm_filters.by_activation(spectra, kind), ("spectra",), {"kind": str}),
}


def run(name: str, options: dict, inputs: dict[str, DataFrame]) -> DataFrame:
    if name not in MODULES:
        raise ModuleError(f"no module {name!r}; known: {', '.join(sorted(MODULES))}")
    m = MODULES[name]
    if missing := [i for i in m.inputs if i not in inputs]:
        raise ModuleError(f"{name} lacks input {', '.join(missing)}")
    if unknown := [o for o in options if o not in m.options]:
        raise ModuleError(f"{name} has no option {', '.join(unknown)}")
    values = m.defaults | options
    if missing := [o for o in m.options if o not in values]:
        raise ModuleError(f"{name} lacks option {', '.join(missing)}")
    convert = lambda t, v: str(v).lower() in ("1", "true", "yes") if t is bool else t(v)
    try:
        typed = {o: convert(t, values[o]) for o, t in m.options.items()}
    except ValueError as e:
        raise ModuleError(f"{name}: {e}") from e
    return m.run(*[inputs[i] for i in m.inputs], **typed)


def execute(name: str, text: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """Options from KEY=VALUE text; keys are case-insensitive, those of other modules are ignored."""
    known = MODULES[name].options if name in MODULES else {}
    return run(name, {k.lower(): v for k, v in read_parameters(text).items() if k.lower() in known}, inputs)
