"""Domain relations derived from the supplied tables, as DataFrames and as the SQL that DuckDB runs.

Both forms use the same expressions, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey spec_idx", "o_totalprice / 100.0D parent_mass", "cast(1 + o_orderkey % 4 as int) parent_charge", "o_orderstatus frag_type")


def peaks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey spec_idx", "l_linenumber peak_no", "l_extendedprice / 100.0D mz", "l_quantity intensity")


def dense_peaks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).selectExpr("vec_id spec_idx", "pos + 1 peak_no", "cast(pos + 1 as double) mz", "abs(cast(v as double)) intensity")


def psms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey scan", "l_linestatus spectrum_file", "l_suppkey db_index", "l_partkey annotation_id", "l_extendedprice score", "l_discount p_value", "l_returnflag = 'R' is_decoy",
        "l_linenumber psm_no", "cast(1 + l_suppkey % 4 as int) charge", "l_tax envelope",
    )


def library(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey lib_idx", "p_retailprice parent_mz", "cast(1 + p_size % 3 as int) library_quality", "p_name compound_name", "cast(p_partkey % 4 as int) charge")


def proteins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id prot_idx", "source id", f"upper(regexp_replace(text, '[^{RESIDUES}{RESIDUES.lower()}]', '')) seq")


def rounded(x: str, places: int) -> str:
    """SQL for x to so many places as DuckDB rounds: the product with the power of ten goes to the nearest whole number, halves away from 0. Spark's own goes by decimal digits."""
    y, scale = f"(({x}) * {10**places}.0D)", f"{10**places}.0D"
    return f"(cast({y} as bigint) + if(abs({y} - cast({y} as bigint)) >= 0.5D, sign({y}), 0.0D)) / {scale}"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scored edges between spectra: orders of one customer placed next to each other, spec1 < spec2."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey spec1", "o_orderkey + 1 + o_custkey % 7 spec2", f"{rounded('o_totalprice / 500000.0D', 4)} score1", f"{rounded('(o_custkey % 100) / 100.0D', 4)} score2",
        f"{rounded('(o_totalprice - 250000.0D) / 2500.0D', 2)} shift1", f"{rounded('(o_custkey % 41) - 20.5D', 2)} shift2",
    )


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("n_chars % 97 cluster_id", "cast(doc_id % 5 as int) file_idx", "doc_id spec_idx", "source spectrum_file", "lang file_group", "cast(n_chars as double) precursor_intensity")


#: The same relations for DuckDB.
SQL = {
    "spectra": "SELECT o_orderkey AS spec_idx, o_totalprice / 100.0::DOUBLE AS parent_mass, CAST(1 + o_orderkey % 4 AS INTEGER) AS parent_charge, o_orderstatus AS frag_type FROM orders",
    "peaks": "SELECT l_orderkey AS spec_idx, l_linenumber AS peak_no, l_extendedprice / 100.0::DOUBLE AS mz, l_quantity AS intensity FROM lineitem",
    "dense_peaks": "SELECT vec_id AS spec_idx, CAST(i AS INTEGER) AS peak_no, CAST(i AS DOUBLE) AS mz, abs(CAST(embedding[i] AS DOUBLE)) AS intensity FROM embeddings, range(1, 65) t(i)",
    "psms": "SELECT l_orderkey AS scan, l_linestatus AS spectrum_file, l_suppkey AS db_index, l_partkey AS annotation_id, l_extendedprice AS score, l_discount AS p_value, (l_returnflag = 'R') AS is_decoy, l_linenumber AS psm_no, CAST(1 + l_suppkey % 4 AS INTEGER) AS charge, l_tax AS envelope FROM lineitem",
    "library": "SELECT p_partkey AS lib_idx, p_retailprice AS parent_mz, CAST(1 + p_size % 3 AS INTEGER) AS library_quality, p_name AS compound_name, CAST(p_partkey % 4 AS INTEGER) AS charge FROM part",
    "proteins": f"SELECT doc_id AS prot_idx, source AS id, upper(regexp_replace(text, '[^{RESIDUES}{RESIDUES.lower()}]', '', 'g')) AS seq FROM documents",
    "pairs": "SELECT o_orderkey AS spec1, o_orderkey + 1 + o_custkey % 7 AS spec2, round(o_totalprice / 500000.0::DOUBLE, 4) AS score1, round((o_custkey % 100) / 100.0::DOUBLE, 4) AS score2, round((o_totalprice - 250000.0::DOUBLE) / 2500.0::DOUBLE, 2) AS shift1, round((o_custkey % 41) - 20.5::DOUBLE, 2) AS shift2 FROM orders",
    "clusters": "SELECT n_chars % 97 AS cluster_id, CAST(doc_id % 5 AS INTEGER) AS file_idx, doc_id AS spec_idx, source AS spectrum_file, lang AS file_group, CAST(n_chars AS DOUBLE) AS precursor_intensity FROM documents",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


#: The pairs as a further view behind others.
SQL_PAIRS = f"pairs AS ({SQL['pairs']})"
