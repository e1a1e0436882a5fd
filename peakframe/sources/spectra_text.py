"""Readers and writers of spectrum text formats.

Files are read record by record through Spark's text source with the format's own separator, so large files are
split among tasks and any store that Spark reads will do; fields are parsed by built-in functions.
Spectra have: file, scan, title, parent_mz, parent_mass, parent_charge, ms_level, activation, annotation,
peaks array<struct<mz, intensity>>; what a format lacks is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HYDROGEN = 1.007825035
SCHEMA = [("file", "string"), ("scan", "int"), ("title", "string"), ("parent_mz", "double"), ("parent_mass", "double"), ("parent_charge", "int"), ("ms_level", "int"), ("activation", "string"), ("annotation", "string"), ("peaks", "array<struct<mz:double,intensity:double>>")]


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    text = spark.read.option("lineSep", separator).text(path).select(F.regexp_replace("value", "\r", "").alias("r"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"))
    return text


def _field(name: str) -> Column:
    v = F.regexp_extract("r", rf"(?m)^{name}=(.*)$", 1)
    return F.when(v != "", v)


def _lines(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))


def _pairs(lines: Column) -> Column:
    def pair(x: Column) -> Column:
        parts = F.split(F.trim(x), r"[ \t]+")
        return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("double").alias("mz"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("intensity"))

    return F.transform(lines, pair)


def _shaped(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in SCHEMA])


NUMBER = r"^\s*-?[0-9]"


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Blocks from BEGIN IONS to END IONS; ``CHARGE`` may carry a sign, ``PEPMASS`` an intensity. Parent mass is m/z * z - (z - 1) * H."""
    r = _records(spark, path, "END IONS").where(F.col("r").contains("BEGIN IONS"))
    mz = F.regexp_extract(_field("PEPMASS"), r"^\s*([0-9.eE+-]+)", 1).try_cast("double")
    z = F.coalesce(F.regexp_extract(_field("CHARGE"), r"([0-9]+)", 1).try_cast("int"), F.lit(0))
    scan = F.coalesce(_field("SCANS").try_cast("double").cast("int"), F.regexp_extract(_field("TITLE"), r"Scan Number: *([0-9]+)", 1).try_cast("int"))
    return _shaped(
        r, file=F.coalesce(_field("FILENAME"), F.col("file")), scan=scan, title=_field("TITLE"), parent_mz=mz, parent_charge=z, parent_mass=F.when(z > 0, mz * z - (z - 1) * HYDROGEN).otherwise(mz),
        ms_level=F.coalesce(_field("MSLEVEL").try_cast("int"), F.lit(2)), activation=_field("ACTIVATION"), annotation=F.coalesce(_field("SEQ"), _field("PEPTIDE")), peaks=_pairs(_lines(F.col("r"), NUMBER)),
    )


def read_ms2(spark: SparkSession, path: str) -> DataFrame:
    """Blocks that a line with a colon opens; the next line has parent mass and charge, then come peaks."""
    r = _records(spark, path, "\n:").select(F.split("r", "\n").alias("l"), "file").withColumn("n", F.filter(F.slice(F.col("l"), F.lit(2), F.greatest(F.size("l") - 1, F.lit(1))), lambda x: x.rlike(NUMBER)))
    r = r.where(F.size("n") > 0)
    head = F.split(F.trim(F.col("n")[0]), r"[ \t]+")
    mass, z = head[0].try_cast("double"), F.try_element_at(head, F.lit(2)).try_cast("int")
    return _shaped(r, file=F.col("file"), title=F.regexp_replace(F.col("l")[0], "^:", ""), parent_mass=mass, parent_mz=mass, parent_charge=z, peaks=_pairs(F.slice("n", 2, 1_000_000_000)))


def read_pkl(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between blank lines: precursor m/z, intensity and charge, then peaks."""
    r = _records(spark, path, "\n\n").withColumn("n", _lines(F.col("r"), NUMBER)).where(F.size("n") > 0)
    head = F.split(F.trim(F.col("n")[0]), r"[ \t]+")
    mz, z = head[0].try_cast("double"), F.try_element_at(head, F.lit(3)).try_cast("int")
    return _shaped(r, file=F.col("file"), parent_mz=mz, parent_mass=F.when(z > 0, mz * z - z + HYDROGEN).otherwise(mz), parent_charge=z, peaks=_pairs(F.slice("n", 2, 1_000_000_000)))


def read_dta(spark: SparkSession, path: str) -> DataFrame:
    """A file for each spectrum: parent mass and charge, then peaks."""
    r = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("r"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"))
    r = r.withColumn("n", _lines(F.col("r"), NUMBER)).where(F.size("n") > 0)
    head = F.split(F.trim(F.col("n")[0]), r"[ \t]+")
    mass, z = head[0].try_cast("double"), F.try_element_at(head, F.lit(2)).try_cast("int")
    return _shaped(r, file=F.col("file"), parent_mass=mass, parent_charge=z, parent_mz=F.when(z > 0, (mass + (z - 1) * HYDROGEN) / z).otherwise(mass), peaks=_pairs(F.slice("n", 2, 1_000_000_000)))


def read_prms(spark: SparkSession, path: str) -> DataFrame:
    """Scored prefix-residue spectra: ``>>`` opens one, then mass and score; the last mass gives the parent mass."""
    r = _records(spark, path, "\n\n").where(F.col("r").contains(">>")).withColumn("n", _lines(F.regexp_extract("r", r"(?s)>>(.*)$", 1), NUMBER))
    r = r.withColumn("peaks", _pairs(F.col("n")))
    last = F.try_element_at(F.col("peaks"), F.lit(-1)).mz
    return _shaped(r, file=F.col("file"), title=F.regexp_extract("r", r">>(.*)", 1), parent_mass=last + 19.018389721, peaks=F.col("peaks"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"mgf": read_mgf, "ms2": read_ms2, "pkl": read_pkl, "dta": read_dta, "prms": read_prms}


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """By extension; ``parquet`` is the engine's own format."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; known: {', '.join(sorted([*READERS, 'parquet']))}")
    return READERS[kind](spark, path)


def _peak_lines(sep: str = " ") -> Column:
    return F.array_join(F.transform("peaks", lambda p: F.concat_ws(sep, p.mz.cast("string"), p.intensity.cast("string"))), "\n")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value.cast("string"), F.lit("\n"))).otherwise("")


def mgf_text(spectra: DataFrame) -> DataFrame:
    mz = F.coalesce(F.when(F.col("parent_mz") > 0, F.col("parent_mz")), F.when(F.col("parent_charge") > 0, (F.col("parent_mass") + (F.col("parent_charge") - 1) * HYDROGEN) / F.col("parent_charge")), F.col("parent_mass"))
    head = F.concat(F.lit("BEGIN IONS\n"), _line("PEPMASS", mz), F.when(F.col("parent_charge") > 0, F.concat(F.lit("CHARGE=+"), F.col("parent_charge").cast("string"), F.lit("\n"))).otherwise(""), _line("MSLEVEL", F.col("ms_level")), _line("FILENAME", F.col("file")), _line("ACTIVATION", F.col("activation")), _line("TITLE", F.col("title")), _line("SEQ", F.col("annotation")), _line("SCANS", F.col("scan")))
    return spectra.select(F.concat(head, _peak_lines(), F.lit("\nEND IONS\n")).alias("value"))


def pkl_text(spectra: DataFrame) -> DataFrame:
    total = F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p.intensity)
    return spectra.select(F.concat(F.concat_ws(" ", F.col("parent_mz").cast("string"), total.cast("string"), F.coalesce("parent_charge", F.lit(0)).cast("string")), F.lit("\n"), _peak_lines(), F.lit("\n")).alias("value"))


def ms2_text(spectra: DataFrame) -> DataFrame:
    return spectra.select(F.concat(F.lit(":"), F.coalesce("title", F.col("scan").cast("string"), F.lit("")), F.lit("\n"), F.concat_ws(" ", F.col("parent_mass").cast("string"), F.coalesce("parent_charge", F.lit(0)).cast("string")), F.lit("\n"), _peak_lines()).alias("value"))


def dta_text(spectra: DataFrame) -> DataFrame:
    """scan, value: the text of each spectrum's file."""
    return spectra.select("scan", F.concat(F.concat_ws(" ", F.col("parent_mass").cast("string"), F.coalesce("parent_charge", F.lit(0)).cast("string")), F.lit("\n"), _peak_lines()).alias("value"))


WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {"mgf": mgf_text, "pkl": pkl_text, "ms2": ms2_text}


def save(spectra: DataFrame, path: str, kind: str) -> None:
    """mgf, pkl and ms2: a folder of text files; dta: a file for each spectrum, in folders by scan; parquet."""
    if kind == "parquet":
        spectra.write.mode("overwrite").parquet(path)
    elif kind == "dta":
        dta_text(spectra).repartition("scan").write.mode("overwrite").partitionBy("scan").text(path)
    elif kind in WRITERS:
        WRITERS[kind](spectra).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no writer for {kind!r}; known: {', '.join(sorted([*WRITERS, 'dta', 'parquet']))}")
