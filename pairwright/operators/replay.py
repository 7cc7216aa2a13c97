"""Expert moves from the corpus itself (M6).

The reference asks an engine for the best move of a position.  The data-scale
counterpart: over all games, the continuation of a position that scored best
for the side to move, among continuations played at least ``min_n`` times.

A position is the sequence of moves before it, at any ply.  Its key is a
rolling hash (``key(i) = md5(key(i - 1) || ' ' || move)``, the start is the empty
string), so no prefix text is built and a game of n plies costs n short hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import computed_once

# Result points for the side to move.
WIN, DRAW, LOSS = 1.0, 0.5, 0.0


def prefix_keys(moves: Column | str) -> Column:
    """Key of the position before each move (one array element a move)."""
    m = F.col(moves) if isinstance(moves, str) else moves
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<string>").alias("keys"))
    return F.aggregate(m, start, lambda acc, x: F.struct(
        F.md5(F.concat(acc["h"], F.lit(" "), x)).alias("h"),
        F.array_append(acc["keys"], acc["h"]).alias("keys")), lambda acc: acc["keys"])


def book_rows(games: DataFrame, moves: str = "moves", result: str = "result") -> DataFrame:
    """One row per ply of every game: ply, prefix_key, move, points for the mover."""
    keyed = computed_once(games.select(moves, result), [moves, result], keys=prefix_keys(moves))

    def row(x, i):
        pts = (F.when(F.col(result) == "1/2-1/2", F.lit(DRAW))
               .when((F.col(result) == "1-0") == ((i % 2) == 0), F.lit(WIN))
               .otherwise(F.lit(LOSS)))
        return F.struct((i + 1).cast("bigint").alias("ply"), F.get("keys", i).alias("prefix_key"),
                        x.alias("move"), pts.alias("points"))

    return keyed.select(F.inline(F.transform(moves, row)))


def expert_from_corpus(games: DataFrame, moves: str = "moves", result: str = "result",
                       min_n: int = 2) -> DataFrame:
    """M6: ply, prefix_key, move, score, n -- best mean points, then most games, then move text.

    Both steps are partial aggregates, so the start position (a prefix every
    game shares) is combined map-side instead of landing in one task.
    """
    s = (book_rows(games, moves, result)
         .groupBy("ply", "prefix_key", "move")
         .agg(F.avg("points").alias("score"), F.count(F.lit(1)).alias("n"))
         .filter(F.col("n") >= min_n))
    best = s.groupBy("ply", "prefix_key").agg(F.min_by(
        F.struct("move", "score", "n"),
        F.struct((-F.col("score")).alias("a"), (-F.col("n")).alias("b"), F.col("move").alias("c"))).alias("b"))
    return best.select("ply", "prefix_key", "b.move", F.round("b.score", 6).alias("score"),
                       F.col("b.n").cast("bigint").alias("n"))
