"""Ranking of scored moves against an expert.

Windows are partitioned by position; a position holds only its candidate
moves (a handful), so no window partition grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_moves(scored: DataFrame, key: str = "position_id", move: str = "move",
               score: str = "reward_score") -> DataFrame:
    """W1 / O1 (D15): rank 1.. by score desc, ties by move text."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(move))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))


def arg_best(scored: DataFrame, key: str = "position_id", move: str = "move",
             score: str = "reward_score", name: str = "best") -> DataFrame:
    """Best move per position (partial aggregate, same tie rule as W1)."""
    return scored.groupBy(key).agg(
        F.min_by(move, F.struct((-F.col(score)).alias("s"), F.col(move).alias("m"))).alias(name))


def expert_rank(ranked: DataFrame, expert: DataFrame, key: str = "position_id",
                move: str = "move") -> DataFrame:
    """W2 + W3: expert move, best move, rank of the expert (1-based), agreement."""
    best = ranked.filter(F.col("rank") == 1).select(key, F.col(move).alias("best"))
    e = expert.select(key, F.col(move).alias("expert"))
    er = ranked.select(key, F.col(move).alias("expert"), F.col("rank").alias("expert_rank"))
    return (e.join(er, [key, "expert"]).join(best, key)
            .withColumn("agrees", F.col("best") == F.col("expert")))


def distinct_suggestions(df: DataFrame, key: str = "position_id", move: str = "move",
                         order: str = "seq") -> DataFrame:
    """Distinct suggestions per position, in first-seen order.

    A position's suggestions are its own few rows (n samples), so the
    per-position list is bounded by the sampling width.
    """
    first = df.groupBy(key, move).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", move))), lambda s: s[move])
        .alias("suggestions"))


def analysis_record(ranked: DataFrame, ranks: DataFrame, key: str = "position_id",
                    move: str = "move", score: str = "reward_score", extra: tuple[str, ...] = ()) -> DataFrame:
    """P25: nested analysis per position: results sorted by rank + summary.

    ``extra``: more columns of ``ranked`` that each result carries."""
    res = ranked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", move, score, *extra))),
                    lambda s: F.struct(s[move].alias("move"), s[score].alias("reward_score"), *[s[c].alias(c) for c in extra]))
        .alias("results"))
    return ranks.join(res, key)
