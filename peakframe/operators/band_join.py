"""Tolerance joins as equi-joins on buckets.

Spark would run ``abs(a - b) <= tol`` as a nested loop. Here each left row keeps the bucket that it is in and
each right row is put in the buckets that it can reach, so the join hashes on (keys, bucket) and the exact
predicate is checked on what meets. A right row appears once in a bucket, hence no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to every tolerance, so that equal differences don't depend on the last bit.
SLACK = 1e-6


def band_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, tol: float, keys: list[str] | None = None, shift: Column | float = 0.0, how: str = "inner", slack: float = SLACK, small: bool = False) -> DataFrame:
    """Rows with ``|left_col - (right_col + shift)| <= tol + slack`` and equal keys; ``how`` is inner, left, left_semi or left_anti.

    Apart from the keys the two sides' column names must differ. ``shift`` is computed from right columns.
    ``small``: the right side is a literal table, sent to all tasks. Otherwise both sides are sorted: to the planner, a side that
    is exploded looks as small as before, and it would send millions of rows through the driver.
    """
    keys, reach = keys or [], tol + slack
    width = max(reach, 1e-9)
    to = F.col(right_col) + shift
    l = left.withColumn("__bucket", F.floor(F.col(left_col) / width))  # noqa: E741
    r = right.withColumn("__at", to).withColumn("__bucket", F.explode(F.sequence(F.floor((F.col("__at") - reach) / width), F.floor((F.col("__at") + reach) / width))))
    close = F.abs(F.col(left_col) - F.col("__at")) <= reach
    on = [l[k] == r[k] for k in [*keys, "__bucket"]]
    for k in on[1:]:
        on[0] = on[0] & k
    joined = l.join(F.broadcast(r) if small else r.hint("merge"), on[0] & close, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__bucket")
    return joined.select(*[l[c] for c in left.columns], *[r[c] for c in right.columns if c not in keys])


def range_self_join(df: DataFrame, value: str, low: float, high: float, id_col: str, keep: list[str]) -> DataFrame:
    """Unordered pairs (id1 < id2) with ``low <= |value2 - value1| <= high``; the kept columns come as name1 and name2."""
    width = max(high, 1e-9)
    names = [id_col, value, *[c for c in keep if c not in (id_col, value)]]
    a = df.select(*[F.col(c).alias(f"{c}1") for c in names], F.floor(F.col(value) / width).alias("__bucket"))
    b = df.select(*[F.col(c).alias(f"{c}2") for c in names], F.explode(F.sequence(F.floor(F.col(value) / width) - 1, F.floor(F.col(value) / width) + 1)).alias("__bucket"))
    gap = F.abs(F.col(f"{value}2") - F.col(f"{value}1"))
    return a.join(b.hint("merge"), "__bucket").where((F.col(f"{id_col}1") < F.col(f"{id_col}2")) & (gap >= low) & (gap <= high)).drop("__bucket")
