"""Queries without oracle against brute force over the whole of the smallest tables."""

from collections import Counter, defaultdict

from peakframe.functions.peptides import RESIDUE_MASS
from peakframe.operators import kernels as K
from peakframe.plans import views as V
from peakframe.plans.catalog import QUERIES

from .conftest import SMALL


def _peak_lists(spark):
    out = defaultdict(list)
    for r in V.peaks(spark, SMALL).collect():
        out[r.spec_idx].append((r.mz, r.intensity))
    return {k: sorted(v) for k, v in out.items()}


def test_overlap_scores_of_all_spectra(spark):
    peaks = _peak_lists(spark)
    spectra = sorted((r.spec_idx, r.parent_mass) for r in V.spectra(spark, SMALL).collect() if r.spec_idx in peaks)
    want = []
    for k, (a, ma) in enumerate(spectra):
        for b, mb in spectra[k + 1 :]:
            if abs(mb - ma) <= 0.5 + 1e-9:
                s1, s2, n = K.overlap_score(peaks[a], peaks[b], -(mb - ma), 20.0)
                want.append((a, b, round(s1, 6), round(s2, 6), n))
    got = sorted(tuple(r) for r in QUERIES["kernel_overlap_scores"](spark, SMALL).collect())
    assert got == want
    mass = dict(spectra)
    assert any(mass[a] < 1000 for a, *_ in got) and any(mass[a] > 1500 for a, *_ in got)


def test_spectral_probability_of_all_peaks(spark):
    masses = sorted({round(m / 10) for m in RESIDUE_MASS.values()})
    want = {}
    for k, peaks in _peak_lists(spark).items():
        scores = Counter(int(m / 10) for m, _ in peaks)
        parent = max(scores) + 1
        ways = [Counter() for _ in range(parent + 1)]  # probability by score, forwards
        ways[0][0] = 1.0
        for m in range(parent):
            for step in masses:
                if m + step <= parent:
                    gain = scores[m + step] if m + step < parent else 0
                    for s, p in ways[m].items():
                        ways[m + step][s + gain] += p / len(masses)
        total = sum(ways[parent].values())
        want[k] = sum(p for s, p in ways[parent].items() if s >= max(1, len(peaks) // 2)) / total if total else 0.0
    got = {r.spec_idx: r.p for r in QUERIES["kernel_spectral_probability"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
