"""Report tables: filter, sort, page, update, compare; summaries; statistics of annotated spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HYDROGEN, WATER = 1.007825035, 18.010564686


def page(table: DataFrame, sort: str, start: int, rows: int = -1, column: str | None = None, equals: str | None = None, as_int: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Sorted, filtered by equality with a string, from row ``start``, ``rows`` of them (-1: all)."""
    if column:
        table = table.where(F.col(column).cast("string") == F.lit(equals))
    t = table.orderBy(F.coalesce(F.col(sort).try_cast("int"), F.lit(0)) if as_int else F.col(sort), *(ties or []))
    t = t.offset(start) if start else t
    return t if rows < 0 else t.limit(rows)


def find(table: DataFrame, column: str, equals: str, order: str) -> DataFrame:
    """The first row, by order, whose column equals the string."""
    return table.where(F.col(column).cast("string") == F.lit(equals)).orderBy(order).limit(1)


def page_ranges(table: DataFrame, sort: str, size: int, tie: str | None = None) -> DataFrame:
    """page, first, last: the values of ``sort`` at the ends of each page; ``tie`` tells rows of one value apart, so that each counts. Numbered range by range."""
    from .graph import renumber

    numbered = renumber(table.select(F.struct(sort, *([tie] if tie else [])).alias("key")), "key").select(F.col(f"value.{sort}").alias("value"), "index")
    return numbered.groupBy(F.floor(F.col("index") / size).alias("page")).agg(F.min("value").alias("first"), F.max("value").alias("last"))


def update(table: DataFrame, where: Column, column: str, value) -> DataFrame:
    return table.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that differ: keys, column, left, right (as strings); rows that one side lacks differ in every column."""
    rest = [c for c in a.columns if c not in keys]
    cells = lambda t, name: t.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(name)) for c in rest])).alias("x")).select(*keys, f"x.column", f"x.{name}")  # noqa: E731, F541
    return cells(a, "left").join(cells(b, "right"), [*keys, "column"], "full").where(~F.col("left").eqNullSafe(F.col("right")))


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int, normalize: bool = False) -> DataFrame:
    """bucket (from 0), count or share of the values within [low, high); others go."""
    b = F.floor((F.col(value) - low) / ((high - low) / buckets))
    h = df.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(F.least(b, F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    return h.select("bucket", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share")) if normalize else h


def cluster_summary(members: DataFrame, groups: list[str]) -> DataFrame:
    """cluster_id, spectra, precursor intensity, and the number of spectra in each file group, in one pivot."""
    agg = [F.count("*").alias("spectra"), F.sum("precursor_intensity").alias("precursor_intensity"), *[F.count_if(F.col("file_group") == g).alias(f"group_{g}") for g in groups]]
    return members.groupBy("cluster_id").agg(*agg)


def protein_table(contigs: DataFrame, proteins: DataFrame, coverage: DataFrame) -> DataFrame:
    """A row for each protein with a contig: contigs, spectra, covered residues, percent to one decimal."""
    per = contigs.groupBy("prot_idx").agg(F.count_distinct("contig").alias("contigs"), F.sum("spectra").alias("spectra"))
    return proteins.select("prot_idx", "id").join(per, "prot_idx").join(coverage.select("prot_idx", "covered", F.round("percent", 1).alias("percent")), "prot_idx")


def project_stats(contigs: DataFrame) -> DataFrame:
    """prot_idx (null: all), contigs, spectra, spectra for each contig, longest contig: the total row comes from the rollup."""
    longest = F.max(F.struct(F.col("length"), (-F.col("contig")).alias("c")))
    return contigs.rollup("prot_idx").agg(F.count("*").alias("contigs"), F.sum("spectra").alias("spectra"), F.avg("spectra").alias("per_contig"), longest["length"].alias("longest"), (-longest["c"]).alias("longest_contig"), F.count_distinct("peptide").alias("peptides"))


def accuracy_by(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg((F.avg(F.col("correct").cast("double")) * 100).alias("accuracy"), F.count("*").alias("calls"))


def annotation_stats(peaks: DataFrame, spectra: DataFrame, ion_types: int) -> DataFrame:
    """Statistics of annotated peaks (spec_idx, mz, intensity, ion, position; ion null for none) of each spectrum (spec_idx, length, peptide_mass).

    Explained intensity and peaks are percentages of those within [57.0214637230, mass - 37]; observed ions of the possible ones; observed breaks of the
    length - 1 positions between residues.
    """
    p = peaks.join(spectra, "spec_idx")
    inside = (F.col("mz") >= 57.0214637230) & (F.col("mz") <= F.col("peptide_mass") - 37)
    hit = F.col("ion").isNotNull()
    return p.groupBy("spec_idx", "length").agg(
        (F.try_divide(F.sum(F.when(inside & hit, F.col("intensity")).otherwise(0.0)), F.sum(F.when(inside, F.col("intensity")))) * 100).alias("explained_intensity"),
        (F.try_divide(F.count_if(inside & hit), F.count_if(inside)) * 100).alias("explained_peaks"),
        (F.count_if(hit) * 100 / (ion_types * (F.first("length") - 1))).alias("observed_ions"),
        (F.count_distinct(F.when(hit, F.col("position"))) * 100 / (F.first("length") - 1)).alias("observed_breaks"),
        F.count("*").alias("total_peaks"),
    ).drop("length")


def by_intensity(peaks: DataFrame) -> DataFrame:
    """Percent of peaks and of intensity that b and y ions have, for each spectrum."""
    n, total = F.count("*"), F.sum("intensity")
    return peaks.groupBy("spec_idx").agg((F.count_if(F.col("ion") == "b") * 100 / n).alias("b_percent"), (F.count_if(F.col("ion") == "y") * 100 / n).alias("y_percent"), (F.sum(F.when(F.col("ion").isin("b", "y"), F.col("intensity")).otherwise(0.0)) * 100 / total).alias("by_intensity"))


def parent_mass_error_ppm(parent_mz: Column, peptide_mass: Column, charge: Column) -> Column:
    """Signed error, of the monoisotopic or the next isotope's m/z, whichever is nearer, in parts per million of the monoisotopic m/z."""
    mono = (peptide_mass + WATER + charge * HYDROGEN) / charge
    a, b = parent_mz - mono, parent_mz - (mono + HYDROGEN / charge)
    return F.when(F.abs(a) > F.abs(b), b).otherwise(a) / mono * 1e6


def _top(psms: DataFrame, by: str) -> DataFrame:
    """The best match of each ``by``: the highest score, then the smallest annotation."""
    return psms.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), "annotation")).alias("top")).select(by, F.col("top.annotation").alias("annotation"), (-F.col("top.s")).alias("score"))


def input_table(spectra: DataFrame, clusters: DataFrame, psms: DataFrame) -> DataFrame:
    """A row for each input spectrum: its cluster and its best match, null where it has none. psms: spec_idx, annotation, score."""
    placed = spectra.join(clusters.groupBy("spec_idx").agg(F.min("cluster_id").alias("cluster_id")), "spec_idx", "left")
    return placed.join(_top(psms, "spec_idx"), "spec_idx", "left")


def cluster_table(clusters: DataFrame, psms: DataFrame) -> DataFrame:
    """A row for each cluster: its spectra, those with a match, and the best match among them."""
    best = psms.groupBy("spec_idx").agg(F.min(F.struct((-F.col("score")).alias("s"), "annotation")).alias("top"))
    members = clusters.select("cluster_id", "spec_idx").distinct().join(best, "spec_idx", "left")
    return members.groupBy("cluster_id").agg(F.count("*").alias("spectra"), F.count("top").alias("matched"), F.min("top").alias("t")).select("cluster_id", "spectra", "matched", F.col("t.annotation").alias("annotation"), (-F.col("t.s")).alias("score"))


def contig_table(contigs: DataFrame, proteins: DataFrame) -> DataFrame:
    """A row for each contig of each protein: its spectra, peptides and longest stretch, and the protein's id. contigs: prot_idx, contig, spectra, length, peptide."""
    per = contigs.groupBy("prot_idx", "contig").agg(F.sum("spectra").alias("spectra"), F.count_distinct("peptide").alias("peptides"), F.max("length").alias("length"))
    return per.join(proteins.select("prot_idx", "id"), "prot_idx", "left")
