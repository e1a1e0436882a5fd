"""Delimited files: matches of several search tools, FASTA, pair sets, masses, parameters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Columns of the supported result files, in our names; those under required must be present.
PSM_FORMATS: dict[str, dict] = {
    "native": {"required": ["#Scan#", "SpectrumFile", "Annotation", "Charge", "Protein"], "rename": {"#Scan#": "scan", "SpectrumFile": "spectrum_file", "Annotation": "annotation", "OrigAnnotation": "original_annotation", "Protein": "protein", "dbIndex": "db_index", "numMods": "mods", "startMass": "start_mass", "Charge": "charge", "MQScore": "score", "p-value": "p_value", "isDecoy": "is_decoy", "FDR": "fdr", "CompoundName": "compound_name", "StrictEnvelopeScore": "envelope"}},
    "results": {"required": ["Scan#", "Annotation", "Charge", "Protein"], "rename": {"Scan#": "scan", "SpectrumFile": "spectrum_file", "Annotation": "annotation", "Charge": "charge", "Protein": "protein", "MQScore": "score", "p-value": "p_value"}},
    "inspect": {"required": ["Scan#", "Annotation", "Charge", "Protein"], "rename": {"#SpectrumFile": "spectrum_file", "Scan#": "scan", "Annotation": "annotation", "Charge": "charge", "Protein": "protein", "MQScore": "score", "p-value": "p_value"}},
    "msgfplus": {"required": ["#SpecFile", "SpecID", "ScanNum", "Charge", "Protein", "Peptide", "QValue"], "rename": {"#SpecFile": "spectrum_file", "ScanNum": "scan", "Charge": "charge", "Protein": "protein", "Peptide": "annotation", "SpecEValue": "score", "QValue": "p_value", "SpecID": "spec_id"}},
    "msgfdb": {"required": ["Scan#", "Peptide", "Charge", "Protein", "P-value"], "rename": {"#SpecFile": "spectrum_file", "Scan#": "scan", "Peptide": "annotation", "Charge": "charge", "Protein": "protein", "P-value": "p_value", "MSGFScore": "score", "FDR": "fdr"}},
    "moda": {"required": ["ScanNo", "Peptide", "Charge", "Protein", "Probability"], "rename": {"Path": "spectrum_file", "ScanNo": "scan", "Peptide": "annotation", "Charge": "charge", "Protein": "protein", "Probability": "score"}},
}
PSM_TYPES = {"scan": "int", "charge": "int", "score": "double", "p_value": "double", "fdr": "double", "db_index": "long", "mods": "int", "start_mass": "double", "envelope": "double"}


class MissingHeader(ValueError):
    pass


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", required: list[str] | None = None, comment: str | None = None, schema: str | None = None) -> DataFrame:
    """With a header (checked for required names) or, given a schema, without one."""
    reader = spark.read.option("sep", sep).option("quote", "").option("escape", "")
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path, schema=schema) if schema else reader.option("header", True).csv(path)
    if missing := [c for c in required or [] if c not in df.columns]:
        raise MissingHeader(f"{path} lacks {', '.join(missing)}")
    return df


def read_psms(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Matches in our names and types; columns that a format doesn't name are left out, -1 in fdr and db_index is null."""
    spec = PSM_FORMATS[kind]
    df = read_delimited(spark, path, required=spec["required"])
    picked = [F.col(f"`{old}`").try_cast(PSM_TYPES.get(new, "string")).alias(new) for old, new in spec["rename"].items() if old in df.columns]
    out = df.select(*picked)
    for c in ("fdr", "db_index"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(c) != -1, F.col(c)))
    if kind == "msgfplus":  # the scan is in the id where the file has none
        out = out.withColumn("scan", F.when(F.col("scan") > 0, F.col("scan")).otherwise(F.regexp_extract("spec_id", r"=([0-9]+)\s*$", 1).try_cast("int"))).drop("spec_id")
    if "is_decoy" in out.columns:
        out = out.withColumn("is_decoy", F.col("is_decoy").isin("1", "true", "True"))
    return out


def read_psm_list(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    out = read_psms(spark, paths[0], kind)
    for p in paths[1:]:
        out = out.unionByName(read_psms(spark, p, kind), allowMissingColumns=True)
    return out


def write_psms(psms: DataFrame, path: str, header: bool = True) -> None:
    names = {new: old for old, new in PSM_FORMATS["native"]["rename"].items()}
    flat = psms.select(*[(F.col(c).cast("int").cast("string") if t == "boolean" else F.col(c)).alias(names.get(c, c)) for c, t in psms.dtypes])
    flat.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").csv(path)


def read_fasta(spark: SparkSession, path: str, letters: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """id, desc, seq: blocks that ``>`` at a line's start opens; ``;`` lines are skipped, letters without a mass are dropped."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("r")).where(F.length(F.trim("r")) > 0)
    head = F.split("r", "\n")[0]
    body = F.array_join(F.filter(F.slice(F.split("r", "\n"), 2, 1_000_000_000), lambda x: ~x.startswith(";")), "")
    return r.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("desc"), F.regexp_replace(F.upper(body), f"[^{letters}]", "").alias("seq"))


def write_fasta(proteins: DataFrame, path: str) -> None:
    desc = F.coalesce(F.col("desc"), F.lit("")) if "desc" in proteins.columns else F.lit("")
    proteins.select(F.concat(F.lit(">"), F.rtrim(F.concat_ws(" ", "id", desc)), F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def read_pairs_binary(spark: SparkSession, path: str) -> DataFrame:
    """Pair sets: number of entries, then six floats for each: spec1, spec2 (from 1), shift1, shift2, score1, score2. Read by range of entries would need a splittable format: convert to Parquet once."""
    fields = [("spec1", pa.int64()), ("spec2", pa.int64()), ("score1", pa.float64()), ("score2", pa.float64()), ("shift1", pa.float64()), ("shift2", pa.float64()), ("spec2rev", pa.bool_())]

    def parse(batches):
        import numpy as np

        for b in batches:
            for content in b.column(0).to_pylist():
                n = int(np.frombuffer(content, "<u4", 1)[0])
                if not n:
                    continue
                rows = np.frombuffer(content, "<f4", offset=4).astype(float).reshape(n, -1)
                cols = [rows[:, 0].astype(np.int64) - 1, rows[:, 1].astype(np.int64) - 1, *(rows[:, k] for k in (4, 5, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*cols, cols[5] > -0.01]], names=[f for f, _ in fields])

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "spec1 long, spec2 long, score1 double, score2 double, shift1 double, shift2 double, spec2rev boolean")


def read_masses(spark: SparkSession, path: str) -> DataFrame:
    """residue, mass from ``A=71.03`` lines; the line with the count is skipped."""
    t = spark.read.text(path)
    return t.select(F.regexp_extract("value", r"^\s*([A-Za-z]+)\s*=", 1).alias("residue"), F.regexp_extract("value", r"=\s*([0-9.]+)", 1).try_cast("double").alias("mass")).where("residue <> ''")


def read_ion_model(spark: SparkSession, path: str) -> DataFrame:
    """name, is_nterm, mass_offset, prob, charge from the ``IF;`` lines of a scoring model."""
    p = F.split("value", ";")
    return spark.read.text(path).where(F.col("value").startswith("IF;")).select(p[4].alias("name"), (p[1].try_cast("int") == 1).alias("is_nterm"), p[2].try_cast("double").alias("mass_offset"), p[3].try_cast("double").alias("prob"), F.try_element_at(p, F.lit(6)).try_cast("int").alias("charge"))


def read_substitution_matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of a square matrix of residues; lines that begin with # are skipped."""
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(F.split(F.trim("value"), r"\s+").alias("c"))
    head = t.where(F.forall("c", lambda x: x.rlike("^[A-Z*]$"))).select("c").scalar()
    rows = t.where(F.size("c") > 1).where(F.col("c")[1].rlike("^-?[0-9]+$")).select(F.col("c")[0].alias("a"), F.posexplode(F.slice("c", 2, 1000)).alias("i", "score"))
    return rows.select("a", F.get(head, F.col("i")).alias("b"), F.col("score").cast("int").alias("score"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, file_idx, spec_idx, scan, spectrum_file of a delimited cluster list."""
    return read_delimited(spark, path, schema="cluster_id long, file_idx int, spec_idx long, scan int, spectrum_file string")


def read_parameters(lines: str) -> dict[str, str]:
    """KEY=VALUE lines; a trailing carriage return goes, ``$NAME`` in a value is an earlier key's value. No comments."""
    out: dict[str, str] = {}
    for line in lines.split("\n"):
        key, found, value = line.rstrip("\r").partition("=")
        if found:
            out[key] = re.sub(r"\$([A-Za-z_][A-Za-z0-9_]*)", lambda m: out.get(m[1], m[0]), value)
    return out


def read_parameters_xml(text: str) -> dict[str, str]:
    """``<parameter name="KEY">VALUE</parameter>`` elements of a workflow file."""
    from xml.etree import ElementTree

    return {p.get("name"): (p.text or "").strip() for p in ElementTree.fromstring(text).iter("parameter") if p.get("name")}


def attach_spectra(psms: DataFrame, spectra: DataFrame, keys: tuple[str, ...] = ("scan",)) -> DataFrame:
    """Matches with their spectra's columns, by scan alone or by file and scan."""
    return spectra.join(psms, list(keys), "left")


def read_svm_model(text: str) -> dict:
    """gamma, rho, alphas and vectors of a libsvm model with a radial kernel (a parameter file, read on the driver)."""
    head, _, body = text.partition("\nSV\n")
    fields = dict(line.split(" ", 1) for line in head.splitlines() if " " in line)
    vectors, alphas, width = [], [], 0
    for line in filter(None, body.splitlines()):
        alpha, *entries = line.split()
        v = {int(k): float(x) for k, x in (e.split(":") for e in entries)}
        width = max(width, *v, 0)
        vectors.append(v)
        alphas.append(float(alpha))
    return {"gamma": float(fields.get("gamma", 1)), "rho": float(fields.get("rho", 0)), "alphas": alphas, "vectors": [[v.get(i, 0.0) for i in range(1, width + 1)] for v in vectors]}
