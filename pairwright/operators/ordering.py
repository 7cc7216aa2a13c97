"""Exact ordinal numbering without a single-partition window.

``row_number() over (order by ...)`` with no partition moves every row into one
task.  Here the table is range-partitioned and sorted (a distributed sort),
each row gets its position inside its partition from
``monotonically_increasing_id`` (partition id in the high bits, row index in the
low 33 bits) and a tiny table of per-partition counts -- one row per
partition, so its size is bounded by the partition count, not by the data --
is turned into offsets and broadcast.  Hot groups spread over many range
partitions, so a group holding a third of the rows is still split.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def _held(df: DataFrame) -> bool:
    """Whether the caller holds the rows already (their cache is not ours to drop)."""
    level = df.storageLevel
    return level.useMemory or level.useDisk


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_row_number(df: DataFrame, order, name: str = "rn",
                      partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``name`` = 1..N following ``order`` (which must be a total order).

    The sorted, id-tagged rows are read twice (counts and numbering); rows
    arrive from a shuffle in no fixed order, so two evaluations could place
    them differently.  ``materialize`` (default) writes them once to the
    shared checkpoint folder so both reads see the same partitions, and a
    lost executor cannot change them either.
    """
    order = _cols(order)
    # The range partitioner samples its input in a job of its own, and an eager
    # checkpoint runs one job to count and one to write; persisting the input and
    # the sorted rows makes the (possibly expensive) upstream run only once.
    own = materialize and not _held(df)
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if own else df
    # without an explicit count AQE sizes the range partitions from the data
    # (adjacent ranges are merged, so the order across partitions holds)
    parted = src.repartitionByRange(partitions, *order) if partitions else src.repartitionByRange(*order)
    ranged = (parted
                 .sortWithinPartitions(*order)
                 .withColumn("_mid", F.monotonically_increasing_id()))
    if materialize:
        # Reliable checkpoint into the cluster's shared checkpoint folder: the
        # ids are then fixed even if an executor is lost and a stage reruns.
        cached = ranged.persist(StorageLevel.MEMORY_AND_DISK)
        ranged = cached.checkpoint(eager=True)
        cached.unpersist()
        if own:
            src.unpersist()
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)) \
                   .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_loc") + 1).cast("bigint")) \
              .drop("_mid", "_pid", "_loc", "_off")


def group_row_number(df: DataFrame, keys: list[str], order, name: str = "rn",
                     partitions: int | None = None, first: int | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, skew-safe.

    ``first`` asks for the numbers up to it alone: every task then drops the other rows
    before the shuffle (Spark's WindowGroupLimit, up to a threshold of its own).

    Otherwise, rows get a global number in (keys, order); the first number of each group
    comes from a partial-aggregated ``min`` and is joined back.  The join side
    has one row per group; AQE's skew-join splits a hot group on the big side.
    """
    if first is not None and first <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        w = Window.partitionBy(*keys).orderBy(*_cols(order))
        few = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= first)
        return few.withColumn(name, F.col(name).cast("bigint"))
    g = global_row_number(df, [*keys, *_cols(order)], "_g", partitions)
    starts = g.groupBy(*keys).agg(F.min("_g").alias("_g0"))
    out = g.join(starts, keys).withColumn(name, (F.col("_g") - F.col("_g0") + 1).cast("bigint")).drop("_g", "_g0")
    return out if first is None else out.filter(F.col(name) <= first)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    For tables that several branches of one job read (a fitted model, a ranked
    table): they are computed once, their lineage is cut, and a lost executor
    re-reads files instead of recomputing the whole upstream.  The input is
    persisted for the duration so the checkpoint's count and write jobs do not
    compute it twice.
    """
    if _held(df):
        return df.checkpoint(eager=True)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read from there:
    later steps read only the columns they use, with their filters pushed into the scan."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
