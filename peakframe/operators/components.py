"""Connected components of an edge table, by alternating large and small stars.

Each round links every node's larger neighbours to its smallest one, then every node's smaller
neighbours; stars form in a few rounds whatever the shape. All steps are joins and partial aggregations on
the edge table; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import importable

#: Far above what any graph takes (the rounds grow with the logarithm of the longest path). Ways in which a node's edges are dealt.
MAX_ROUNDS, SALTS = 60, 4
#: Edges that a task contracts together.
TOGETHER = 500_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """A copy in the shared folder that the session names (under /tmp where it names none and all runs on one machine)."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or "/tmp/checkpoints")
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Free the disk of shuffles and copies that nothing refers to any more.

    Spark's cleaner learns of them from the driver's collector, which may not run for the whole of a job of many small steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the m of u; the centre of a large star is several tasks' rows."""
    salted = least.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(salted.hint("merge"), ["u", "salt"]).drop("salt")  # sorted: after some rounds the planner takes any table for a small one


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for every node of an edge that isn't a loop; the component is its smallest node. Null ends are ignored."""
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
        del both, least, large, small
        let_go(e.sparkSession)
    else:
        raise RuntimeError(f"components aren't settled after {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def contracted_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``connected_components``, after tasks have contracted the edges that they hold: what is left to the rounds are the roots of nodes that several tasks met."""
    importable(edges.sparkSession)
    e = edges.select(F.col(left).alias("node"), F.col(right).alias("root")).where("node is not null and root is not null and node <> root")

    def stars(table):
        both = pa.chunked_array([*table.column("node").chunks, *table.column("root").chunks]).to_numpy()
        nodes, code = np.unique(both, return_inverse=True)
        root = roots_of(code[: len(table)], code[len(table) :], len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((nodes, nodes[root]), table.schema, strict=True)], schema=table.schema)

    def work(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TOGETHER:
                yield stars(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield stars(pa.Table.from_batches(held))

    met = e.mapInArrow(work, StructType([StructField(f.name, f.dataType) for f in e.schema]))
    met = cut_lineage(met.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
    links = met.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("root").alias("v")).where("u <> v")
    met = met.select("node", "root")
    if links.isEmpty():
        return met.withColumnRenamed("root", "component")
    tops = connected_components(links).withColumnRenamed("node", "root")
    return met.join(tops.hint("merge"), "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def roots_of(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Each node's component, by its smallest node: roots are hung on smaller ones until edges lie within a component."""
    root = np.arange(nodes)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
