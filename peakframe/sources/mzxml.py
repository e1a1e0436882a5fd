"""mzXML: scans read by Spark's XML source, peaks from base64 pairs of network-order floats or doubles."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import importable

SCHEMA = "scan int, ms_level int, retention_time double, parent_mz double, parent_charge int, precursor_intensity double, peaks array<struct<mz:double,intensity:double>>"
_ROW = "_num int, _msLevel int, _retentionTime string, precursorMz struct<_VALUE:double,_precursorCharge:int,_precursorIntensity:double>, peaks struct<_VALUE:string,_precision:int,_compressionType:string>"


def decode_peaks(text: str | None, precision: int | None, compression: str | None) -> list[dict[str, float]]:
    if not text:
        return []
    raw = base64.b64decode("".join(text.split()))
    if compression == "zlib":
        raw = zlib.decompress(raw)
    values = np.frombuffer(raw, ">f8" if precision == 64 else ">f4").astype(float)
    return [{"mz": m, "intensity": i} for m, i in zip(values[::2].tolist(), values[1::2].tolist(), strict=True)]


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each scan element; the scans of a survey scan must not be nested in it."""
    importable(spark)
    rows = spark.read.format("xml").option("rowTag", "scan").schema(_ROW).load(path)
    flat = rows.selectExpr("_num", "_msLevel", "cast(regexp_extract(_retentionTime, '([0-9.]+)', 1) as double) rt", "precursorMz._VALUE mz", "precursorMz._precursorCharge z", "precursorMz._precursorIntensity pi", "peaks._VALUE text", "peaks._precision bits", "peaks._compressionType how")

    def decode(batches):
        kind = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))
        for b in batches:
            peaks = [decode_peaks(*x) for x in zip(b.column("text").to_pylist(), b.column("bits").to_pylist(), b.column("how").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(peaks, kind)], names=["scan", "ms_level", "retention_time", "parent_mz", "parent_charge", "precursor_intensity", "peaks"])

    return flat.mapInArrow(decode, SCHEMA)
