"""Position bounds, hash choices, splits, ordering (L1-L5, L13, F4 of FIXTURES)."""

import math

import pytest
from pyspark.sql import functions as F

from pairwright.operators.ordering import global_row_number, group_row_number
from pairwright.functions.hashing import hash32
from pairwright.operators.sampling import (exact_split, first_n, hash_split, position_bounds,
                                           sample_position, take_samples)


def test_position_bounds_table(spark):
    cases = [(9, None, None), (10, 6, 9), (20, 6, 19), (21, 8, 17), (48, 8, 40),
             (239, 39, 40), (240, 80, 239), (241, 80, 240)]
    df = spark.createDataFrame([(n,) for n, _, _ in cases], "n_plies int")
    got = {r.n_plies: (r.lo, r.hi) for r in position_bounds(df).collect()}
    assert got == {n: (lo, hi) for n, lo, hi in cases}


def test_sampled_position_inside_bounds_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias("game_id"), (F.col("id") % 300).cast("int").alias("n_plies"))
    a = sample_position(df, "game_id").select("game_id", "move_index", "lo", "hi")
    assert a.filter((F.col("move_index") < F.col("lo")) | (F.col("move_index") > F.col("hi"))).count() == 0
    b = sample_position(df.repartition(7), "game_id").select("game_id", "move_index")
    assert a.select("game_id", "move_index").exceptAll(b).count() == 0


def test_hash_split_disjoint_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    s = hash_split(df, "k", 0.1)
    assert s.count() == 5000
    n_eval = s.filter(F.col("split") == "eval").count()
    assert 350 < n_eval < 650


def test_exact_split_count(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    s = exact_split(df, "k", 0.1)
    assert s.filter(F.col("split") == "eval").count() == math.ceil(1003 * 0.1)
    assert s.count() == 1003


def test_global_row_number_is_permutation(spark):
    df = spark.range(10000).select((F.col("id") * 7919 % 10007).alias("v"))
    g = global_row_number(df, ["v"], "rn", partitions=5)
    r = g.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(r) == (1, 10000, 10000)
    # order follows v
    assert g.filter(F.col("rn") == 1).first().v == df.agg(F.min("v")).first()[0]


def test_group_row_number_with_hot_group(spark):
    # one group holds a third of the rows
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 50).cast("string")).alias("g"), F.col("id").alias("v"))
    r = group_row_number(df, ["g"], ["v"], "rn")
    chk = r.groupBy("g").agg(F.max("rn").alias("mx"), F.count("*").alias("n"), F.countDistinct("rn").alias("d"))
    assert chk.filter((F.col("mx") != F.col("n")) | (F.col("d") != F.col("n"))).count() == 0


def test_first_n_small_and_large(spark):
    df = spark.range(30000).select((F.col("id") * 13 % 30011).alias("k"))
    small = sorted(r.k for r in first_n(df, 5, ["k"]).collect())
    assert small == sorted(r.k for r in df.orderBy("k").limit(5).collect())
    assert first_n(df, 0, ["k"]).count() == 0 and first_n(df, 40000, ["k"]).count() == 30000
    want = df.withColumn("h", hash32(42, "k")).orderBy("h", "k").limit(777).select("k")
    assert take_samples(df, 777, "k").exceptAll(want).count() == 0 and take_samples(df, 777, "k").count() == 777
    big = first_n(df, 20000, ["k"])
    assert big.count() == 20000
    assert big.agg(F.max("k")).first()[0] < df.orderBy("k").limit(20001).agg(F.max("k")).first()[0]


def test_numbering_leaves_the_callers_cache(spark):
    df = spark.range(100).cache()
    df.count()
    assert global_row_number(df, ["id"], "n").count() == 100
    assert df.storageLevel.useMemory
    df.unpersist()


def test_late_positions(spark):
    df = spark.createDataFrame([(i, 5 + i) for i in range(12)], "game_id long, n_plies int")
    got = {r.game_id: r.move_index for r in sample_position(df, "game_id", mode="late").collect()}
    assert set(got) == {i for i in range(12) if 5 + i >= 11}
    assert all(10 <= m <= 5 + i - 1 for i, m in got.items())


@pytest.mark.parametrize("threshold", [1000, 0])
def test_first_numbers_of_groups(spark, threshold):
    df = spark.createDataFrame([("a", v) for v in range(9)] + [("b", 5), (None, 1), (None, 0)], "g string, v long").repartition(3)
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(name, threshold)
    try:
        got = {(r.g, r.v, r.rn) for r in group_row_number(df, ["g"], ["v"], "rn", first=2).collect()}
    finally:
        spark.conf.unset(name)
    assert got - {(None, 0, 1), (None, 1, 2)} == {("a", 0, 1), ("a", 1, 2), ("b", 5, 1)}
