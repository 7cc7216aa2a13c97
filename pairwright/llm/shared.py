"""Staging in the shared folder and connected components, used by several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the cluster's shared folder and read it back.

    Cuts the lineage: several branches read the same rows, and a lost executor
    costs a re-read, not a recomputation.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`stage`, with the folder, to be deleted once nothing reads it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)``: rows ``(node, root)``, root = smallest node.

    Alternating large-star and small-star rounds: each round links a node's
    larger neighbours, then its smaller ones, to the smallest neighbour, which
    takes O(log^2 n) rounds also for long chains.  Minima are partial
    aggregates and the rewiring is an equi-join, so a hub with a huge degree is
    combined map-side and split by the skew join; no neighbour list is ever
    collected.  Every round is staged in the shared folder and the one before
    is deleted.  Nodes without an edge (or only a loop) do not appear.
    """
    spark = edges.sparkSession
    pair = F.xxhash64("a", "b").cast("decimal(38,0)")
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
             .filter("a <> b").distinct()
    e, path = stage_at(e, "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
                    .filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b") \
                     .union(low.select("a", F.col("m").alias("b"))).distinct()
        e, new = stage_at(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(pair)).first()
        delete(spark, path)
        path = new
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")) \
                    .union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
