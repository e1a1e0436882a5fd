"""Findings of the third round that were settled in the fourth."""

import random

import pytest
from pyspark.sql import functions as F

from peakframe.operators import components as C
from peakframe.operators import graph as G
from peakframe.operators import pair_blocks as B
from peakframe.operators import pairs as P
from peakframe.operators.band_join import SLACK

from .test_graph import _brute
from .test_round_r03 import _spectra


def _cut(edges, most, step):
    """The cap as it is defined, on lists."""
    while True:
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v, _ in edges:
            if u is not None and v is not None and u != v:
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        sizes, least = {}, {}
        for x in parent:
            sizes[find(x)] = sizes.get(find(x), 0) + 1
        over = lambda u: u in parent and sizes[find(u)] > most  # noqa: B023, E731
        for u, _, s in edges:
            if over(u) and s is not None:
                least[find(u)] = min(s, least.get(find(u), 9.0))
        if not least:
            return edges
        edges = [e for e in edges if not over(e[0]) or e[2] is not None and e[2] >= least[find(e[0])] + step]


@pytest.mark.parametrize("alone,together", [(1_000_000, 10), (30, 10)])
def test_cap_settles_components_on_their_own(spark, monkeypatch, alone, together):
    """Within tasks or round by round, as defined; components are searched once where none is too large for a task."""
    monkeypatch.setattr(G, "ALONE", alone)
    monkeypatch.setattr(G, "TOGETHER", together)
    searched = []
    monkeypatch.setattr(G, "contracted_components", lambda *a, f=G.contracted_components: (searched.append(1), f(*a))[1])
    rng = random.Random(11)
    edges = [(rng.randrange(150), rng.randrange(150), rng.randrange(100) / 100) for _ in range(110)] + [(k, k + 1, rng.randrange(100) / 100) for k in range(200, 260)]
    edges += [(7000, 7000, 0.5), (None, 3, 0.1), (8000, None, 0.1), (201, 201, 0.99), (202, None, 0.98), (203, 204, None)]
    df = spark.createDataFrame(edges, "spec1 long, spec2 long, score1 double").withColumn("more", F.lit("x"))
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r)[:3] for r in G.cap_component_size(df, 5, 0.1).collect()), key=key)
    assert got == sorted(_cut(edges, 5, 0.1), key=key) and len(got) < len(edges)
    assert len(searched) == 1 if alone == 1_000_000 else len(searched) > 1


@pytest.mark.parametrize("together", [500_000, 7])
def test_contracted_components_are_the_components(spark, monkeypatch, together):
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(300, k) for k in range(301, 330)] + [(None, 4), (4, None), (9, 9), (999, 999)]
    want = _brute([(u, v) for u, v in edges if u is not None and v is not None and u != v])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in C.contracted_components(df, "a", "b").collect()} == want
    assert C.contracted_components(df.limit(0), "a", "b").count() == 0


def test_cap_without_progress_is_an_error(spark):
    path = spark.createDataFrame([(k, k + 1, 0.5) for k in range(9)], "spec1 long, spec2 long, score1 double")
    with pytest.raises(Exception, match="still over 3 nodes"):
        G.cap_component_size(path, 3, 0.0, 20).collect()


def test_jumps_shuffle_no_pairs(spark):
    """No aggregate above the join, unless numbers repeat; rows as by all comparisons."""
    rng = random.Random(3)
    rows = [(k, round(rng.uniform(100, 130), 2)) for k in range(300)] + [(900, None), (None, 110.0)]
    jumps, tol = [5.0, -5.0, 7.5, 0.01, 0.0], 0.02
    for more in ([], [(5, 111.11), (6, 111.12), (6, 116.11)]):
        df = spark.createDataFrame(rows + more, "spec_idx long, parent_mass double")
        found = P.jump_pairs(df, jumps, tol)
        full = [r for r in rows + more if None not in r]
        want = {(a, b, abs(j)) for a, x in full for b, y in full for j in jumps if a < b and min(abs(abs(y - x) - abs(j)), abs(abs(y - x) + abs(j))) <= 2 * tol + SLACK}
        got = sorted(map(tuple, found.collect()))
        assert got == sorted(want) and {j for *_, j in got} == {5.0, 7.5, 0.01, 0.0}
        assert ("Aggregate" in found._jdf.queryExecution().sparkPlan().toString()) == bool(more)


@pytest.mark.parametrize("part,elements", [(8192, 1 << 18), (7, 64)])
def test_matches_in_blocks_equal_joins(spark, monkeypatch, part, elements):
    """Lists go to blocks once and to the block before; rows are those of joins of pairs."""
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "ELEMENTS", elements)
    s, p = _spectra(spark, 150)
    p = p.unionByName(spark.createDataFrame([(3, 60, 1e300, 1.0), (5, 61, -250.0, 1.0), (12, 62, 1e300, 1.0)], p.schema))
    for tol in (20.0, 0.0):
        found = P.matched_within(p, s, 0.5, tol, 3)
        joined = P.matched_peaks(p, P.candidate_pairs(s, 0.0, 0.5), tol, F.col("delta")).select("spec1", "spec2", "i", "j", F.round("mz1", 3).alias("mz1"), F.round("mz2", 3).alias("mz2"))
        want = sorted(map(tuple, joined.collect()))
        assert want and sorted(map(tuple, found.collect())) == want
    assert "MapInArrow" in found._jdf.queryExecution().sparkPlan().toString()
    twice = s.unionByName(s.where("spec_idx < 9"))
    at, peaks = [(r.spec_idx, r.parent_mass) for r in twice.where("parent_mass is not null").collect()], {}
    for r in p.collect():
        peaks.setdefault(r.spec_idx, []).append(r.mz)
    hits = [1 for a, x in at for b, y in at if a < b and abs(y - x) <= 0.5 for m in peaks.get(a, []) for n in peaks.get(b, []) if abs(m - (n + y - x)) <= 20.0 + SLACK]
    assert P.matched_within(p, twice, 0.5, 20.0, 3).count() == len(hits)  # as often as the pair
