"""Operators on pair graphs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import importable
from .components import connected_components, contracted_components, cut_lineage, let_go, roots_of

#: Edges of a component that one task settles; edges that it takes together, in whole components.
ALONE, TOGETHER = 1_000_000, 200_000
STILL = "components are still over {most} nodes after {rounds} rounds; a step above 0 ends sooner"


def strong_edges(edges: DataFrame, least: float) -> DataFrame:
    """The edges that make the graph: those with score1 above ``least``."""
    return edges.where(F.col("score1") > least)


def component_sizes(edges: DataFrame) -> DataFrame:
    """component, nodes."""
    return connected_components(edges, "spec1", "spec2").groupBy("component").agg(F.count("*").alias("nodes"))


def component_of(edges: DataFrame) -> DataFrame:
    """The edges with the component that they are in."""
    cc = connected_components(edges, "spec1", "spec2")
    return edges.join(cc, F.col("spec1") == F.col("node")).drop("node")


def merge_sets(edges: DataFrame, least: int) -> DataFrame:
    """node, set: components of at least ``least`` nodes, numbered densely from 0 by their smallest node; other nodes have -1."""
    cc = connected_components(edges, "spec1", "spec2")
    large = cc.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = renumber(large, "component").select(F.col("value").alias("component"), F.col("index").alias("set"))
    return cc.join(numbered, "component", "left").select("node", F.coalesce("set", F.lit(-1)).cast("long").alias("set"))


def split_by_set(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges within sets, with the set; edges of dropped nodes go."""
    return edges.join(sets.where("set >= 0"), F.col("spec1") == F.col("node")).drop("node")


def cap_component_size(edges: DataFrame, most: int, step: float = 0.1, rounds: int = 1000) -> DataFrame:
    """Drops the weakest edges (those under the least score + ``step``) of components over ``most`` nodes, again and again, until none is.

    What goes depends on the component alone, so that components are found once and each of up to ``ALONE`` edges is settled within a task; one with more
    loses edges round by round until its pieces are small enough. Joins are sorted, as tables of nodes and components grow with the graph and must not be
    sent through the driver.
    """
    settled, columns = [], edges.columns
    edges = cut_lineage(edges)
    for done in range(rounds):
        cc = contracted_components(edges, "spec1", "spec2")
        over = cc.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component", F.lit(True).alias("over"))
        inside = edges.join(cc.hint("merge"), F.col("spec1") == F.col("node"), "left").drop("node").join(over.hint("merge"), "component", "left")
        inside = cut_lineage(inside)
        capped = inside.where("over").drop("over")
        bars = capped.groupBy("component").agg(F.count("*").alias("n"), (F.min("score1") + step).alias("bar")).where(F.col("n") > ALONE).drop("n")
        bars = cut_lineage(bars)  # a row for each such component
        settled += [inside.where("over is null").select(columns), _capped(capped.join(F.broadcast(bars), "component", "left_anti"), columns, most, step, rounds - done)]
        if bars.isEmpty():
            break
        kept = capped.join(F.broadcast(bars), "component").where(F.col("bar").isNull() | (F.col("score1") >= F.col("bar")))
        edges = cut_lineage(kept.select(columns))
        let_go(edges.sparkSession)
    else:
        raise RuntimeError(STILL.format(most=most, rounds=rounds))
    return reduce(DataFrame.unionByName, settled)


def _capped(inside: DataFrame, columns: list[str], most: int, step: float, rounds: int) -> DataFrame:
    """``cap_component_size`` of whole components, some at a time."""
    importable(inside.sparkSession)

    def settle(table):
        ends = pa.chunked_array([*table.column("spec1").chunks, *table.column("spec2").chunks]).combine_chunks().dictionary_encode()
        codes = pc.fill_null(ends.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        score = table.column("score1")
        known = pc.is_valid(score).to_numpy()
        value = pc.fill_null(pc.cast(score, pa.float64()), 0.0).to_numpy()
        kept = surviving(codes[: len(table)], codes[len(table) :], value, known, most, step, rounds)
        return table.select(columns).filter(pa.array(kept)).combine_chunks().to_batches()

    def work(batches):
        held, n = [], 0
        for b in batches:
            key = b.column("component")
            if n >= TOGETHER and b.num_rows:
                last = held[-1].column("component")[-1]
                more = int(pc.sum(pc.equal(key, last)).as_py())  # sorted, so those in front
                if more < b.num_rows:
                    yield from settle(pa.Table.from_batches([*held, b.slice(0, more)]))
                    held, n, b = [], 0, b.slice(more)
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if held:
            yield from settle(pa.Table.from_batches(held))

    return inside.repartition("component").sortWithinPartitions("component").mapInArrow(work, inside.select(columns).schema)


def surviving(u: np.ndarray, v: np.ndarray, score: np.ndarray, known: np.ndarray, most: int, step: float, rounds: int) -> np.ndarray:
    """Which edges stay. Ends are numbered from 0, -1 is null; ``known``: the score isn't null."""
    stays, left, nodes = np.ones(len(u), bool), np.arange(len(u)), int(max(u.max(initial=0), v.max(initial=0))) + 1
    for _ in range(rounds + 1):
        a, b = u[left], v[left]
        link = (b >= 0) & (a != b)
        root = roots_of(a[link], b[link], nodes)
        ends = np.unique(np.r_[a[link], b[link]])
        over = (np.bincount(root[ends], minlength=nodes) > most)[root[a]]
        left = left[over]
        if not len(left):
            return stays
        of, s, has = root[u[left]], score[left], known[left]
        bar = np.full(nodes, np.nan)  # as Spark's least: NaN is above all
        np.fmin.at(bar, of[has], s[has])
        some = np.bincount(of[has], minlength=nodes) > 0
        good = np.where(has, np.isnan(s) | (s >= bar[of] + step), ~some[of])
        stays[left[~good]] = False
        left = left[good]
    raise RuntimeError(STILL.format(most=most, rounds=rounds))


def _long(shift1: Column, shift2: Column) -> Column:
    return F.when(F.abs(shift1) > F.abs(shift2), shift1).otherwise(shift2)


def valid_triangle(edges: list[tuple[Column, Column]], tol: float) -> Column:
    """Whether the longest of three edges' shifts is the sum of one shift of each of the others; edges are (shift1, shift2)."""
    longest = [_long(*e) for e in edges]
    size = [F.abs(x) for x in longest]

    def sums(k: int) -> Column:
        a, b = (e for i, e in enumerate(edges) if i != k)
        ok = F.lit(False)
        for x in a:
            for y in b:
                ok = ok | (F.abs(longest[k] - x - y) <= tol)
        return ok

    return F.when((size[0] >= size[1]) & (size[0] >= size[2]), sums(0)).when(size[1] >= size[2], sums(1)).otherwise(sums(2))


def filter_triangles(edges: DataFrame, tol: float) -> DataFrame:
    """Edges (spec1 < spec2, unique) that are part of a triangle whose shifts add up.

    Each triangle is met at its node of least degree: a hub's edges are held by their other ends, so it makes no square of its degree.
    """
    degree = edges.select(F.explode(F.array("spec1", "spec2")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    of = lambda k: degree.select(F.col("node").alias(f"spec{k}"), F.col("n").alias(f"n{k}"))
    e = edges.select("spec1", "spec2", F.struct("spec1", "spec2", "shift1", "shift2").alias("edge")).join(of(1), "spec1").join(of(2), "spec2")
    first = F.struct("n1", "spec1") < F.struct("n2", "spec2")
    held = e.select(F.when(first, F.col("spec1")).otherwise(F.col("spec2")).alias("node"), F.when(first, F.col("spec2")).otherwise(F.col("spec1")).alias("other"), "edge")
    wedge = held.select("node", F.col("other").alias("x"), F.col("edge").alias("e1")).join(held.select("node", F.col("other").alias("y"), F.col("edge").alias("e2")), "node").where("x < y")
    closed = wedge.join(edges.select(F.col("spec1").alias("x"), F.col("spec2").alias("y"), F.struct("spec1", "spec2", "shift1", "shift2").alias("e3")), ["x", "y"])
    three = closed.select(F.array_sort(F.array("e1", "e2", "e3")).alias("t"))  # ab, ac, bc of a < b < c
    side = lambda i: (F.col("t")[i].shift1, F.col("t")[i].shift2)
    tri = three.where(valid_triangle([side(0), side(2), side(1)], tol)).select(F.col("t")[0].spec1.alias("a"), F.col("t")[0].spec2.alias("b"), F.col("t")[2].spec2.alias("c"))
    used = tri.select(F.explode(F.array(F.struct(F.col("a").alias("spec1"), F.col("b").alias("spec2")), F.struct(F.col("b").alias("spec1"), F.col("c").alias("spec2")), F.struct(F.col("a").alias("spec1"), F.col("c").alias("spec2")))).alias("u")).select("u.*").distinct()
    return edges.join(used, ["spec1", "spec2"], "left_semi")


def top_k_edges(edges: DataFrame, k: int, both: bool = True, least1: float | None = None, least2: float | None = None, least_shift: float = 0.0) -> DataFrame:
    """Edges among the k best (by score1, ties kept) of both their nodes, or of one; k = 0 asks for a score of 1."""
    ends = edges.select(F.explode(F.array("spec1", "spec2")).alias("node"), "score1")
    if k > 0:
        w = Window.partitionBy("node").orderBy(F.desc("score1"))
        cut = ends.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("node").agg(F.min("score1").alias("cut"))
    else:
        cut = ends.select("node").distinct().withColumn("cut", F.lit(1.0))
    j = edges.join(cut.select(F.col("node").alias("spec1"), F.col("cut").alias("cut1")), "spec1").join(cut.select(F.col("node").alias("spec2"), F.col("cut").alias("cut2")), "spec2")
    first, second = F.col("score1") >= F.col("cut1"), F.col("score1") >= F.col("cut2")
    j = j.where((first & second) if both else (first | second))
    for c, least in (("score1", least1), ("score2", least2)):
        if least is not None:
            j = j.where(F.col(c) >= least)
    return j.where(F.abs("shift1") >= least_shift).select(edges.columns)


def intersect_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("spec1", "spec2").distinct(), ["spec1", "spec2"], "left_semi")


def renumber(nodes: DataFrame, column: str) -> DataFrame:
    """value, index: dense numbers from 0 by value, counted range by range so that no task sees all values."""
    ranged = cut_lineage(nodes.select(F.col(column).alias("value")).distinct().repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("value")
    return ranged.join(F.broadcast(offsets), "part").select("value", (F.col("offset") + F.row_number().over(inside) - 1).alias("index"))


def glue_vertices(matches: DataFrame) -> DataFrame:
    """spec_idx, peak_no, vertex: peaks that matches (spec1, i, spec2, j) identify, directly or in chains, are one vertex named by its smallest member."""
    node = lambda s, p: F.col(s) * 1_000_000 + F.col(p)
    cc = connected_components(matches.select(node("spec1", "i").alias("u"), node("spec2", "j").alias("v")))
    return cc.select(F.floor(F.col("node") / 1_000_000).alias("spec_idx"), (F.col("node") % 1_000_000).alias("peak_no"), F.col("component").alias("vertex"))


def dot_text(edges: DataFrame, name: str = "g") -> DataFrame:
    """Graphviz text: one row for each component, so that no row grows with the whole graph."""
    line = F.concat(F.lit('  "'), F.col("spec1").cast("string"), F.lit('" -- "'), F.col("spec2").cast("string"), F.lit('" [label="'), F.round("score1", 4).cast("string"), F.lit('"];'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spec1", "spec2", line.alias("l")))), lambda x: x.l), "\n")
    return component_of(edges).groupBy("component").agg(F.concat(F.lit(f"graph {name} {{\n"), body, F.lit("\n}")).alias("dot"))
