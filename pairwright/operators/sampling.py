"""Position choice, splits, limits and samples.

Every random choice of the reference is replaced by a hash of (seed, key), so
the same rows come back under any partitioning and can be checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import TWO32, hash32, hash_pick
from .ordering import global_row_number, staged

# Fixed values of the reference's position rule (plies): games shorter than
# MIN_PLIES are skipped; up to SHORT_GAME plies the range is 6 .. L-1; longer
# games use max(8, L div 6) .. min(40, 5L div 6); an empty range falls back to
# max(3, L div 3) .. L-1.
MIN_PLIES = 10
SHORT_GAME = 20

SKETCH_SIZE = 3200   # of the quantile sketch: ranks are within 0.1 % (99 times in 100)
SLACK = 0.002        # of all rows, kept on either side of the sketched cut
HEAP = 50_000        # keys that one task may sort to find the last one


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def position_bounds(df: DataFrame, n_col: str = "n_plies") -> DataFrame:
    """L13 (D8): add ``lo``/``hi`` (null when the game yields no position)."""
    L = _c(n_col)
    short = L <= SHORT_GAME
    lo1 = F.when(short, F.lit(6)).otherwise(F.greatest(F.lit(8), F.expr(f"{n_col} div 6")))
    hi1 = F.when(short, L - 1).otherwise(F.least(F.lit(40), F.expr(f"(5 * {n_col}) div 6")))
    lo2 = F.when(lo1 >= hi1, F.greatest(F.lit(3), F.expr(f"{n_col} div 3"))).otherwise(lo1)
    hi2 = F.when(lo1 >= hi1, L - 1).otherwise(hi1)
    ok = (L >= MIN_PLIES) & (lo2 < hi2)
    return df.withColumn("lo", F.when(ok, lo2).cast("int")) \
             .withColumn("hi", F.when(ok, hi2).cast("int"))


def sample_position(df: DataFrame, key: str, seed: int = 42, mode: str = "bounds",
                    n_col: str = "n_plies") -> DataFrame:
    """One position (``move_index`` = plies already played) per game.

    ``bounds`` uses L13; ``late`` is the older rule 10 .. L-1 (empty below 11).
    Rows without a valid range are dropped.
    """
    if mode == "late":
        df = df.withColumn("lo", F.lit(10)).withColumn("hi", _c(n_col) - 1)
        df = df.filter(F.col("hi") >= F.col("lo"))
    else:
        df = position_bounds(df, n_col).filter(F.col("lo").isNotNull())
    return df.withColumn("move_index", hash_pick(seed, F.col("lo"), F.col("hi"), key).cast("int"))


def hash_split(df: DataFrame, key: str, frac: float, seed: int = 42,
               names: tuple[str, str] = ("train", "eval")) -> DataFrame:
    """L4: hash-bucket split, no shuffle; ``split`` = names[1] for ~frac of keys."""
    cut = int(frac * TWO32)
    return df.withColumn("split", F.when(hash32(seed, key) < F.lit(cut), F.lit(names[1]))
                         .otherwise(F.lit(names[0])))


def exact_split(df: DataFrame, key: str, frac: float, seed: int = 42,
                names: tuple[str, str] = ("train", "eval")) -> DataFrame:
    """L4 exact: the ceil(n*frac) rows of lowest hash (ties by key) are held out.

    The rank is computed with a distributed sort (no single-task window); the
    row count is one partial-aggregated ``count`` joined as a one-row table.
    """
    h = df.withColumn("_h", hash32(seed, key))
    ranked = global_row_number(h, ["_h", key], "_r")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))   # of the rows as they were written
    out = ranked.crossJoin(F.broadcast(n))  # one-row table, size bound = 1
    return out.withColumn("split", F.when(F.col("_r") <= F.ceil(F.col("_n") * F.lit(frac)),
                                          F.lit(names[1])).otherwise(F.lit(names[0]))) \
              .drop("_h", "_r", "_n")


def _leading(df: DataFrame, key: Column) -> Column | None:
    """A bigint that never falls as the key rises, to be sketched; None for other types."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, T.IntegralType):
        return key.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    return None


def first_n(df: DataFrame, n: int, order) -> DataFrame:
    """L1 / L3: the first ``n`` rows in the order given by ``order`` (a total order).

    A quantile sketch (KLL) of the first key, one partial aggregate, says between
    which two values the n-th row lies.  Rows up to the upper one -- about ``n`` -- are
    written once; on the way there the bound is a filter that Spark pushes below
    whatever makes the rows.  The n-th key itself is found among the few rows
    between the two values.  The result is exact whatever the sketch says: should
    it have cut too low, the cut is widened.  No row is shuffled, none is cached.
    """
    order = [_c(o) for o in order]
    if n <= 0:
        return df.limit(0)
    lead = _leading(df, order[0])
    low = high = None
    if lead is not None:
        sketch, total = df.agg(F.kll_sketch_agg_bigint(lead, F.lit(SKETCH_SIZE)), F.count(lead)).first()
        if total:
            at = [F.lit(min(1.0, max(0.0, n / total + d))) for d in (-SLACK, SLACK)]
            low, high = df.sparkSession.range(1).select(
                *[F.kll_sketch_get_quantile_bigint(F.lit(bytes(sketch)), r) for r in at]).first()
            high = None if n / total + SLACK >= 1 else high
    rows = staged(df if high is None else df.filter(lead.isNull() | (lead <= high)), "first")
    size = rows.count()
    if size < n and high is not None:              # the sketch was off
        rows, low = staged(df, "first"), None
        size = rows.count()
    if size <= n:
        return rows
    names = [f"_k{i}" for i in range(len(order))]
    own = F.struct(*[o.alias(k) for o, k in zip(order, names)])
    under = F.lit(False) if low is None else F.coalesce(lead < low, F.lit(True))
    below = rows.filter(under).count()
    if below >= n:
        under, below = F.lit(False), 0
    keys = rows.filter(~under).select(*[o.alias(k) for o, k in zip(order, names)])
    if n - below <= HEAP:
        last = keys.orderBy(*names).limit(n - below).agg(F.max(F.struct(*names)).alias("_last"))
    else:
        last = global_row_number(keys, names, "_r").filter(F.col("_r") == n - below).select(F.struct(*names).alias("_last"))
    return rows.join(F.broadcast(last), own <= F.col("_last")).drop("_last")       # one row


def take_samples(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """L2: stop at ``n`` samples -- the n rows of lowest hash, repeatable (see :func:`first_n`)."""
    return first_n(df.withColumn("_h", hash32(seed, key)), n, ["_h", key]).drop("_h")


def phase_positions(df: DataFrame, key: str = "game_id", moves: str = "moves",
                    n_col: str = "n_plies", seed: int = 42) -> DataFrame:
    """Up to two positions per game -- opening 8..min(15, L-5) if L > 15,
    middle 16..min(40, L-5) if L > 25, and the first ply i in 10..min(50, L-3)-1
    with a capture, check or mate among the next three moves; the list is cut
    to two, so the tactic counts only when an earlier phase is missing.
    Output: key, slot (1, 2), move_index."""
    from ..functions.pgn import has_motif
    L = F.col(n_col)
    op = F.when(L > 15, hash_pick(seed, F.lit(8), F.least(F.lit(15), L - 5), key, F.lit("opening")))
    mid = F.when(L > 25, hash_pick(seed, F.lit(16), F.least(F.lit(40), L - 5), key, F.lit("middle")))
    hi = F.least(F.lit(50), L - 3) - 1
    idx = F.when(hi >= 10, F.sequence(F.lit(10), hi)).otherwise(F.array().cast("array<int>"))
    tac = F.array_min(F.filter(idx, lambda i: has_motif(F.col(moves), i)))
    lst = F.slice(F.array_compact(F.array(op.cast("int"), mid.cast("int"), tac.cast("int"))), 1, 2)
    return df.select(key, F.posexplode(lst).alias("slot", "move_index")) \
             .select(key, (F.col("slot") + 1).cast("bigint").alias("slot"),
                     F.col("move_index").cast("bigint").alias("move_index"))
