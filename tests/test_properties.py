"""Property checks: bounds for every game length, split stability,
ranks are permutations, parse errors are values."""

import os

from pyspark.sql import functions as F

from conftest import FIXTURES
from pairwright.operators import quality as Q
from pairwright.operators.rank import rank_moves
from pairwright.operators.sampling import hash_split, position_bounds
from pairwright.sources.games import read_games


def _rule(n):
    """The position rule written out directly, for comparison."""
    if n < 10:
        return None
    if n <= 20:
        lo, hi = 6, n - 1
    else:
        lo, hi = max(8, n // 6), min(40, 5 * n // 6)
    if lo >= hi:
        lo, hi = max(3, n // 3), n - 1
    return None if lo >= hi else (lo, hi)


def test_bounds_every_length(spark):
    df = spark.range(0, 601).select(F.col("id").cast("int").alias("n_plies"))
    got = {r.n_plies: (None if r.lo is None else (r.lo, r.hi)) for r in position_bounds(df).collect()}
    assert got == {n: _rule(n) for n in range(601)}
    assert all(0 <= lo <= hi <= n - 1 for n, b in got.items() if b for lo, hi in [b])


def test_split_same_rows_under_any_partitioning(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = hash_split(df, "k", 0.2).filter("split = 'eval'").select("k")
    b = hash_split(df.repartition(13), "k", 0.2).filter("split = 'eval'").select("k")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rank_is_permutation(spark):
    df = spark.range(500).select((F.col("id") % 37).alias("position_id"),
                                 F.col("id").cast("string").alias("move"),
                                 ((F.col("id") * 7919) % 13).cast("double").alias("reward_score"))
    r = rank_moves(df).groupBy("position_id").agg(F.count("*").alias("n"), F.max("rank").alias("mx"),
                                                  F.countDistinct("rank").alias("d"))
    assert r.filter((F.col("n") != F.col("mx")) | (F.col("n") != F.col("d"))).count() == 0


def test_parse_errors_are_values(spark):
    g = read_games(spark, os.path.join(FIXTURES, "games.pgn"))
    rep = {r.error: r.n for r in Q.error_report(g).collect()}
    assert rep == {"white_elo": 1, "date": 1}   # '?' rating, '????.??.??' date
