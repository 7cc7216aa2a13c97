"""Weighted rendezvous hashing of record keys over shards.

Every (key, shard) pair has a hash; a record goes to the shard with the highest
score.  With equal weights the score is the hash itself; with weights ``w`` it
is ``-w / ln(u)``, ``u`` being the hash scaled to (0, 1), so a shard gets a
share of the keys in proportion to its weight.  A further shard changes nothing
among the others: records either stay or move into it.

Slots number a shard's rows from 0 without gaps.  The placed narrow rows are
written once with the input partition they came from; rows are numbered within
(shard, input partition) and shifted by the counts of the partitions before.  So
no task holds a whole shard, and a key with a third of all rows is spread over
as many tasks as it has input partitions.

Null ids hash like the empty string.  Null texts have no bytes.  Equal ids go to
the same shard and get slots of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

OVERHEAD = 16      # bytes that a record takes beside its text


def _score(key: Column, shard: Column, weight: Column | None) -> Column:
    h = F.xxhash64(key, shard)
    if weight is None:
        return h
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -weight / F.log(u)


def place(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 .. ``len(weights) - 1``) of a string key; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    equal = len(set(weights)) == 1
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    scored = F.transform(shards, lambda s: F.struct(
        _score(key, s["shard"], None if equal else s["weight"]).alias("score"), (-s["shard"]).alias("shard")))
    return -F.array_max(scored)["shard"]


def shard_records(records: DataFrame, weights: Sequence[float], more: float = 1.0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: ``id_col, size, text_crc32, shard, slot, grown_shard``.

    ``grown_shard``: the shard if one with weight ``more`` were added.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = stage(records.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), place(key, weights).alias("shard"),
        place(key, [*weights, more]).alias("grown_shard"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "shards")
    inner = Window.partitionBy("shard", "part").orderBy("row")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")) \
                    .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.withColumn("at", F.row_number().over(inner) - 1).join(offsets, ["shard", "part"]) \
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                (F.col("offset") + F.col("at")).cast("bigint").alias("slot"), "grown_shard")
