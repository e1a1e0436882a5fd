"""Row filters of matches and library entries; all reach the scan as pushed-down predicates where their columns do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def select_equal(df: DataFrame, **values) -> DataFrame:
    """Rows where every named column has the value."""
    for c, v in values.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def by_activation(spectra: DataFrame, kind: str) -> DataFrame:
    return spectra.where(F.col("frag_type") == kind)


def by_charge(entries: DataFrame, charges: list[int], spectrum_charge: str | None = None) -> DataFrame:
    """By the match's charge, or the spectrum's where the match has none (-1 or null)."""
    z = F.when(F.coalesce(F.col("charge"), F.lit(-1)) != -1, F.col("charge"))
    if spectrum_charge:
        z = F.coalesce(z, F.col(spectrum_charge))
    return entries.where(z.isin(charges))


def by_fdr(psms: DataFrame, most: float) -> DataFrame:
    return psms.where(F.col("fdr") <= most)


def by_p_value(psms: DataFrame, most: float) -> DataFrame:
    return psms.where(F.col("p_value") <= most)


def by_envelope(psms: DataFrame, most: float) -> DataFrame:
    return psms.where(F.col("envelope") <= most)


def without_residues(psms: DataFrame, letters: str, annotation: str = "annotation") -> DataFrame:
    return psms.where(~F.col(annotation).rlike(f"[{letters}]"))


def with_match(spectra: DataFrame, psms: DataFrame, key: str = "spec_idx") -> DataFrame:
    return spectra.join(psms.select(key).distinct(), key, "left_semi")


def single_interpretation(psms: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of spectra that have just one; where there are more, all go."""
    return psms.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")


def by_range_list(df: DataFrame, column: str, ranges: str) -> DataFrame:
    """Rows whose value is in a list such as ``1-3,5``."""
    keep = F.lit(False)
    for part in filter(None, (p.strip() for p in ranges.split(","))):
        low, _, high = part.partition("-")
        keep = keep | F.col(column).between(int(low), int(high or low))
    return df.where(keep)


def is_modified(annotation: str = "annotation"):
    return F.col(annotation).rlike(r"[(\[]")


def proteins_of(rows: DataFrame, targets: DataFrame, key: str = "db_index") -> DataFrame:
    return rows.join(targets.select(key).distinct(), key, "left_semi")
