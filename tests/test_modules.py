import pytest

from peakframe.operators import graph as G
from peakframe.operators import kernels as K
from peakframe.plans import modules as M
from peakframe.plans import views as V

from .conftest import SMALL


def test_conversion_runs_its_steps_in_order(spark):
    p, s = V.peaks(spark, SMALL), V.spectra(spark, SMALL)
    plain = M.run("merge_convert", {}, {"spectra_peaks": p, "spectra": s})
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, p.where("mz >= 0").collect()))
    options = {"min_charge": 2, "max_charge": 3, "mass_offset": 1.5, "absolute": True, "min_intensity": 5, "top_k": 3, "min_peaks": 2, "normalize": "max", "rounded": True}
    rows = M.run("merge_convert", options, {"spectra_peaks": p, "spectra": s}).collect()
    charge = {r.spec_idx: r.parent_charge for r in s.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.spec_idx, []).append(r)
    assert rows and all(charge[k] in (2, 3) and 2 <= len(v) <= 3 and max(x.intensity for x in v) == 1 for k, v in by.items()) and all(r.mz == int(r.mz) for r in rows)
    with pytest.raises(M.ModuleError):
        M.run("merge_convert", {"unknown": 1}, {"spectra_peaks": p, "spectra": s})


def test_library_search_looks_at_peaks(spark):
    q = spark.createDataFrame([(1, 500.0)], "query long, query_mz double")
    lib = spark.createDataFrame([(7, 500.1, 1), (8, 500.2, 1), (9, 600.0, 1)], "lib_idx long, parent_mz double, library_quality int")
    peaks = lambda rows: spark.createDataFrame(rows, "spec_idx long, peak_no int, mz double, intensity double")
    inputs = {"queries": q, "entries": lib, "query_peaks": peaks([(1, 1, 100.0, 4.0), (1, 2, 200.0, 9.0)]), "entry_peaks": peaks([(7, 1, 300.0, 1.0), (8, 1, 100.0, 4.0), (8, 2, 200.0, 9.0)])}
    (hit,) = M.run("library_search", {"tolerance": 0.5}, inputs).collect()
    assert hit.lib_idx == 8 and abs(hit.score - 1) < 1e-12


def test_limits_raise(spark):
    members = spark.createDataFrame([(1, 0, 1, "a", "g1", 1.0), (1, 0, 2, "a", "g2", 1.0)], "cluster_id long, file_idx int, spec_idx long, spectrum_file string, file_group string, precursor_intensity double")
    assert M.run("cluster_info", {}, {"members": members}).count() == 1
    with pytest.raises(M.ModuleError):
        M.run("cluster_info", {"most_groups": 1}, {"members": members})
    scores = {57: 1, 114: 1}
    found = K.dictionary(scores, 171, {"G": 57, "A": 71}, 1)
    assert found == [(2, "GGG")]
    with pytest.raises(ValueError):
        K.dictionary({}, 57 * 12, {"G": 57, "H": 57}, 0, most=10)
    edges = spark.createDataFrame([(i, i + 1, 0.5) for i in range(6)], "spec1 long, spec2 long, score1 double")
    assert G.cap_component_size(edges, 3).count() == 0
    with pytest.raises(RuntimeError):
        G.cap_component_size(edges, 3, rounds=0)


def test_reference_case_of_the_component_cap(spark):
    edges = spark.createDataFrame([(1, 2, 0.7), (2, 3, 0.7), (3, 4, 0.5)], "spec1 long, spec2 long, score1 double")
    assert sorted(map(tuple, G.cap_component_size(edges, 3).collect())) == [(1, 2, 0.7), (2, 3, 0.7)]
