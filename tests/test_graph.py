import random

from pyspark.sql import functions as F

from peakframe.operators import graph as G
from peakframe.operators import pairs as Q
from peakframe.operators import psms as M
from peakframe.operators.band_join import band_join
from peakframe.operators.components import connected_components


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 360)]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame([*edges, (None, 4), (9, 9)], "u long, v long")
    assert {r.node: r.component for r in connected_components(df).collect()} == _brute(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_cap_drops_the_weakest_edge_first(spark):
    path = spark.createDataFrame([(1, 2, 0.7), (2, 3, 0.7), (3, 4, 0.5)], "spec1 long, spec2 long, score1 double")
    assert {(r.spec1, r.spec2) for r in G.cap_component_size(path, 3).collect()} == {(1, 2), (2, 3)}
    for most in (1, 2):
        assert max([0, *(r.nodes for r in G.component_sizes(G.cap_component_size(path, most)).collect())]) <= most


def test_parsimony_equals_one_by_one(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(60), rng.randrange(12)) for _ in range(150)}
    left, want = set(rows), {}
    while left:
        counts = {}
        for _, p in left:
            counts[p] = counts.get(p, 0) + 1
        best = min(counts, key=lambda p: (-counts[p], p))
        scans = {s for s, p in left if p == best}
        want.update(dict.fromkeys(scans, best))
        left = {(s, p) for s, p in left if s not in scans}
    df = spark.createDataFrame(sorted(rows), "scan long, db_index long")
    for last_task in (0, 60, 1000):
        got = M.parsimony(df, last_task)
        assert got.count() == len(want) and {r.scan: r.db_index for r in got.collect()} == want


def test_greedy_matching_is_one_to_one(spark):
    rng = random.Random(8)
    rows = [(1, 2, i, j, rng.random(), rng.random()) for i in range(6) for j in range(6) if rng.random() < 0.5]
    used_i, used_j, score = set(), set(), 0.0
    for _, _, i, j, a, b in sorted(rows, key=lambda r: (-r[4] * r[5], r[2], r[3])):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            score += a * b
    df = spark.createDataFrame(rows, "spec1 long, spec2 long, i int, j int, int1 double, int2 double")
    r = Q.greedy_matches(df, F.col("int1") * F.col("int2")).first()
    assert r.matched == len(used_i) and abs(r.score - score) < 1e-9


def test_band_join_equals_nested_loop(spark):
    rng = random.Random(2)
    a, b = [(i, i % 2, rng.uniform(-5, 5)) for i in range(80)], [(i, i % 2, rng.uniform(-5, 5)) for i in range(80)]
    l, r = spark.createDataFrame(a, "i int, k int, x double"), spark.createDataFrame(b, "j int, k int, y double")  # noqa: E741
    want = {(i, j) for i, k, x in a for j, q, y in b if k == q and abs(x - y) <= 0.25 + 1e-6}
    got = [(x.i, x.j) for x in band_join(l, r, "x", "y", 0.25, ["k"]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {x.i for x in band_join(l, r, "x", "y", 0.25, ["k"], how="left_anti").collect()} == {i for i, *_ in a} - {i for i, _ in want}


def test_q_values_rise_with_falling_score(spark):
    rng = random.Random(4)
    rows = [(i, "f", rng.random(), rng.random() < 0.4, i, i, 1, 0.1) for i in range(500)]
    df = spark.createDataFrame(rows, "scan long, spectrum_file string, score double, is_decoy boolean, db_index long, annotation_id long, psm_no int, p_value double")
    got = sorted(M.q_values(df, slices=7).collect(), key=lambda r: r["rank"])
    decoys, curve = 0, []
    for n, r in enumerate(got, 1):
        decoys += r.is_decoy
        curve.append(1.0 if n == decoys else min(1.0, decoys / (n - decoys)))
    least = 1.0
    for r, f in zip(reversed(got), reversed(curve), strict=True):
        least = min(least, f)
        assert abs(r.fdr - f) < 1e-12 and abs(r.q - least) < 1e-12
    assert [r["rank"] for r in got] == list(range(1, 501)) and all(x.score >= y.score for x, y in zip(got, got[1:], strict=False))
