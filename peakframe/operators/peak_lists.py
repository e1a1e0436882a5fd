"""Operators that combine, reorder and index whole peak lists, pairs and entries.

Peaks have spec_idx, peak_no, mz, intensity; a list's tolerance is the caller's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pair_blocks as B
from .band_join import band_join
from .components import cut_lineage

#: Spectra of a mass bin that one task takes.
BIN_PART = 200_000


def sort_peaks(peaks: DataFrame) -> DataFrame:
    """The peaks with ``place``: their rank by mass, then intensity, from 0."""
    return peaks.withColumn("place", F.row_number().over(Window.partitionBy("spec_idx").orderBy("mz", "intensity", "peak_no")) - 1)


def insert_peaks(peaks: DataFrame, new: DataFrame) -> DataFrame:
    """The peaks and new ones (spec_idx, mz, intensity), numbered after the spectrum's last."""
    last = peaks.groupBy("spec_idx").agg(F.max("peak_no").alias("last"))
    nth = F.row_number().over(Window.partitionBy("spec_idx").orderBy("mz", "intensity"))
    added = new.join(last, "spec_idx", "left").select("spec_idx", (F.coalesce("last", F.lit(0)) + nth).cast("int").alias("peak_no"), "mz", "intensity")
    return peaks.select("spec_idx", "peak_no", "mz", "intensity").unionByName(added)


def remove_at(peaks: DataFrame, places: list[int]) -> DataFrame:
    """The peaks without those at the given places of the mass order, from 0."""
    return sort_peaks(peaks).where(~F.col("place").isin(places)).drop("place")


#: Intensity of a merged peak, from those of the two lists.
MERGES = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least, "first": lambda a, b: a, "second": lambda a, b: b}


def merge_common(a: DataFrame, b: DataFrame, shift: float, tol: float, how: str = "sum") -> DataFrame:
    """The peaks of both lists that match under a shift of the second, once for each match; masses are averaged by intensity."""
    left = a.select("spec_idx", F.col("mz").alias("mz1"), F.col("intensity").alias("int1"))
    right = b.select("spec_idx", F.col("mz").alias("mz2"), F.col("intensity").alias("int2"))
    m = band_join(left, right, "mz1", "mz2", tol, ["spec_idx"], shift=F.lit(float(shift)))
    mass = (F.col("mz1") * F.col("int1") + (F.col("mz2") + shift) * F.col("int2")) / (F.col("int1") + F.col("int2"))
    return m.select("spec_idx", mass.alias("mz"), MERGES[how](F.col("int1"), F.col("int2")).alias("intensity"))


def merge_closest(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """The first list's peaks, each with the peaks of the second that are closest to it and within ``tol``; the others of the second as they are.

    Merged intensities are summed, masses averaged by intensity. Of equally close peaks the lighter one takes it.
    """
    left = a.select("spec_idx", "peak_no", F.col("mz").alias("mz1"), F.col("intensity").alias("int1"))
    new = b.select("spec_idx", F.col("peak_no").alias("new_no"), F.col("mz").alias("mz2"), F.col("intensity").alias("int2"))
    near = band_join(left, new, "mz1", "mz2", tol, ["spec_idx"])
    best = F.min(F.struct(F.abs(F.col("mz1") - F.col("mz2")).alias("d"), "mz1", "peak_no")).alias("best")
    taken = near.groupBy("spec_idx", "new_no", "mz2", "int2").agg(best).select("spec_idx", "new_no", F.col("best.peak_no").alias("peak_no"), "mz2", "int2")
    more = taken.groupBy("spec_idx", "peak_no").agg(F.sum("int2").alias("i"), F.sum(F.col("mz2") * F.col("int2")).alias("mi"))
    total = F.col("int1") + F.coalesce("i", F.lit(0.0))
    merged = left.join(more, ["spec_idx", "peak_no"], "left").select("spec_idx", F.when(F.col("i").isNull(), F.col("mz1")).otherwise((F.col("mz1") * F.col("int1") + F.col("mi")) / total).alias("mz"), total.alias("intensity"))
    alone = new.join(taken.select("spec_idx", "new_no"), ["spec_idx", "new_no"], "left_anti").select("spec_idx", F.col("mz2").alias("mz"), F.col("int2").alias("intensity"))
    return merged.unionByName(alone)


def merge_runs(peaks: DataFrame, runs: DataFrame, resolution: float) -> DataFrame:
    """Runs of consecutive spectra (spec_idx, run) as one each: run, mz (mean by intensity of a bin's peaks), intensity, spectra that have it."""
    at = peaks.join(runs.select("spec_idx", "run"), "spec_idx").withColumn("bin", F.floor(F.col("mz") / resolution + 0.5))
    return at.groupBy("run", "bin").agg((F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")).alias("mz"), F.sum("intensity").alias("intensity"), F.count_distinct("spec_idx").alias("spectra"))


def average_intensity(peaks: DataFrame) -> DataFrame:
    return peaks.agg(F.avg("intensity").alias("intensity"))


def mass_histogram(spectra: DataFrame, width: float = 0.1) -> DataFrame:
    """bin, spectra, first: numbers of spectra by parent mass in units of ``width``, with the smallest index among them."""
    return spectra.groupBy(F.floor(F.col("parent_mass") / width + 0.5).alias("bin")).agg(F.count("*").alias("spectra"), F.min("spec_idx").alias("first"))


def unique_shifts(shifts: Column, resolution: float) -> Column:
    """Of an array of shifts, in rising order, those further than ``resolution`` from the last one kept."""
    return F.aggregate(F.array_sort(shifts), F.array().cast("array<double>"), lambda kept, x: F.when((F.size(kept) > 0) & (x - F.try_element_at(kept, F.lit(-1)) <= resolution), kept).otherwise(F.concat(kept, F.array(x))))


def quartiles(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The values at a quarter, a half and three quarters of the sorted places of each group, without interpolation."""
    order = Window.partitionBy(*by).orderBy(column)
    ranked = values.select(*by, column, (F.row_number().over(order) - 1).alias("at"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    at = lambda k: F.max(F.when(F.col("at") == F.floor(F.col("n") * k / 4), F.col(column))).alias(f"q{k}")
    return ranked.groupBy(*by).agg(at(1), at(2), at(3))


def sort_pairs(pairs: DataFrame, by: str = "score") -> DataFrame:
    """The pairs in falling order of the sum of their scores, or in that of their spectra; ties by spectra, then shifts."""
    lead = [F.desc(F.col("score1") + F.col("score2"))] if by == "score" else []
    return pairs.orderBy(*lead, "spec1", "spec2", "shift1", "shift2")


def members_of(clusters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members of the clusters asked for (cluster_id)."""
    return clusters.join(wanted.select("cluster_id").distinct(), "cluster_id", "left_semi")


def clusters_of(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id of each member asked for (spec_idx)."""
    return members.select("spec_idx").distinct().join(clusters.select("spec_idx", "cluster_id").distinct(), "spec_idx")


def bin_candidates(queries: DataFrame, spectra: DataFrame, width: float, least: int) -> DataFrame:
    """query, spec_idx, bins: spectra that share at least ``least`` mass bins with a query. Both are peaks; the index is the table of bins.

    From two bins on, a query and a spectrum meet where the smallest bin is that they share, through the next one that they share: a common bin brings nothing
    together by itself, and pairs are never rows until they are results.
    """
    if least < 2:
        of = lambda p, name: p.select(F.col("spec_idx").alias(name), F.floor(F.col("mz") / width).alias("bin")).distinct()
        met = of(queries, "query").join(of(spectra, "spec_idx"), "bin").where("query <> spec_idx")
        return met.groupBy("query", "spec_idx").agg(F.count("*").alias("bins")).where(F.col("bins") >= least)
    first = F.slice("bins", 1, F.size("bins") - (least - 1))  # the smallest bin shared has so many after it

    def sets(p):
        s = p.where("spec_idx is not null").groupBy(F.col("spec_idx").cast("long").alias("id")).agg(F.sort_array(F.collect_set(F.floor(F.col("mz") / width))).alias("bins"))
        return s.where(F.size("bins") >= least).select("id", "bins", F.explode(first).alias("block"))

    own = sets(spectra)
    parts = spectra.groupBy(F.floor(F.col("mz") / width).alias("block")).agg(F.ceil(F.count("*") / BIN_PART).alias("parts")).where("parts > 1")  # a row for each large bin
    own = own.join(F.broadcast(parts), "block", "left").select("id", "bins", "block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long")).alias("part"), F.lit(False).alias("from"))
    asked = sets(queries).join(F.broadcast(parts), "block", "left").select("id", "bins", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(True).alias("from"))

    def run(table):
        here = int(table.column("block")[0].as_py())
        ids, is_query = B.column(table, "id"), B.column(table, "from").astype(bool)
        offsets, values = B.lists(table, ("bins",))
        kinds, bins = np.unique(values["bins"], return_inverse=True)
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(ids)), n)
        later = bins > np.searchsorted(kinds, here)
        q, s = np.flatnonzero(later & is_query[owner]), np.flatnonzero(later & ~is_query[owner])
        s = s[np.argsort(bins[s], kind="stable")]
        start, stop = np.searchsorted(bins[s], bins[q], "left"), np.searchsorted(bins[s], bins[q], "right")
        total = np.r_[0, np.cumsum(stop - start)]
        known = np.flatnonzero(is_query[owner])
        known = np.sort(owner[known] * len(kinds) + bins[known])  # what bins each query has
        at = 0
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(total, total[at] + B.ELEMENTS // 4, "right")) - 1)
            c = (stop - start)[at:to]
            i = np.repeat(q[at:to], c)
            j = s[np.arange(len(i)) - np.repeat(total[at:to] - total[at] - start[at:to], c)]
            at = to
            x, y, by = owner[i], owner[j], bins[i]
            apart = ids[x] != ids[y]
            x, y, by = x[apart], y[apart], by[apart]
            pair = np.repeat(np.arange(len(y)), n[y])
            z = bins[np.arange(len(pair)) - np.repeat(np.cumsum(n[y]) - n[y] - offsets[y], n[y])]
            wanted = x[pair] * len(kinds) + z
            common = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted if len(known) else np.zeros(len(wanted), bool)
            shared = np.bincount(pair[common], minlength=len(y))
            before = np.bincount(pair[common & (z < by[pair])], minlength=len(y))
            good = (before == 1) & (shared >= least)  # this block's bin alone comes before
            yield ids[x[good]], ids[y[good]], shared[good]

    return B.by_block(own.unionByName(asked), run, "query long, spec_idx long, bins long")


def bin_product(a: DataFrame, b: DataFrame, width: float, by: list[str]) -> DataFrame:
    """The product of two peak lists over mass bins, for each key: product, bins."""
    binned = lambda p, name: p.groupBy(*by, F.floor(F.col("mz") / width).alias("bin")).agg(F.sum("intensity").alias(name))
    met = binned(a, "x").join(binned(b, "y"), [*by, "bin"])
    return met.groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("product"), F.count("*").alias("bins"))


def ion_cosine(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of two spectra's annotated-ion vectors (spec_idx, ion, position, value): spec1, spec2, cosine; 0 where they share no ion."""
    vectors = cut_lineage(vectors)  # read three times
    norm = vectors.groupBy("spec_idx").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    side = lambda k: vectors.select(F.col("spec_idx").alias(f"spec{k}"), "ion", "position", F.col("value").alias(f"v{k}"))
    dot = pairs.select("spec1", "spec2").hint("merge").join(side(1), "spec1").hint("merge").join(side(2), ["spec2", "ion", "position"]).groupBy("spec1", "spec2").agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))
    both = pairs.select("spec1", "spec2").hint("merge").join(norm.select(F.col("spec_idx").alias("spec1"), F.col("norm").alias("n1")), "spec1").hint("merge").join(norm.select(F.col("spec_idx").alias("spec2"), F.col("norm").alias("n2")), "spec2")
    return both.hint("merge").join(dot, ["spec1", "spec2"], "left").select("spec1", "spec2", F.coalesce(F.try_divide(F.col("dot"), F.col("n1") * F.col("n2")), F.lit(0.0)).alias("cosine"))


def compress_graph(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """u, v, score1: the edges left without the nodes that go (node), with nodes numbered densely from 0."""
    from .graph import renumber

    left = edges.join(gone.select(F.col("node").alias("spec1")).distinct(), "spec1", "left_anti").join(gone.select(F.col("node").alias("spec2")).distinct(), "spec2", "left_anti")
    numbers = renumber(left.select(F.explode(F.array("spec1", "spec2")).alias("node")), "node")
    at = lambda k, name: numbers.select(F.col("value").alias(f"spec{k}"), F.col("index").alias(name))
    return left.join(at(1, "u"), "spec1").join(at(2, "v"), "spec2").select("u", "v", "score1")


def compare_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, and the rows that only that side has, as often as it has more of them."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def peptide_hash(peptide: Column) -> Column:
    """A number for the peptide: 60 bits of its digest."""
    return F.conv(F.substring(F.md5(peptide.cast("binary")), 1, 15), 16, 10).cast("long")


def combinations(n: Column, k: Column) -> Column:
    """n over k, exact up to n = 60; 0 where k is outside 0 to n."""
    steps = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(k, n - k), F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda c, i: (c * (n - i + 1) / i).cast("decimal(38,0)"))
    return F.when((k < 0) | (k > n), F.lit(0)).when((k == 0) | (k == n), F.lit(1)).otherwise(steps).cast("long")


def text_parts(value: Column, sep: str) -> Column:
    """The trimmed parts of a delimited text, in lower case, without empty ones."""
    return F.filter(F.transform(F.split(value, sep), lambda x: F.lower(F.trim(x))), lambda x: x != "")
