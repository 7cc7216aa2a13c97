"""Quality rules with a reason for every rejection.

Rules are named ``Column`` predicates that are *true when the game fails*.
``quality`` labels each row with the first failing rule; nothing throws per
row (``try_*`` parsing), so bad values become rejections, not task failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pgn import header, parse_elo, parse_game_date, time_base
from ..functions.hashing import TWO32, hash32

# Fixed values of the reference's quality rules.
MIN_ELO = 2000
EXCLUDED_DATES = ["2021-03-12"]
DEFAULT_DATE = "1970.01.01"
DEFAULT_TERMINATION = "Normal"
BOT_TITLE = "BOT"
# Proposed filters of the improvement note.
PLY_RANGE = (20, 100)
MIN_BASE_SECONDS = 300
DRAW_KEEP_RATE = 0.3
OPENING_CAP = 1000
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
ELO_TIERS = [2400]


def not_bot(h: str = "headers") -> Column:
    """F1 (D4): neither title is exactly BOT (null-safe)."""
    return (F.coalesce(header(h, "WhiteTitle"), F.lit("")) != BOT_TITLE) & \
           (F.coalesce(header(h, "BlackTitle"), F.lit("")) != BOT_TITLE)


def min_elo(n: int = MIN_ELO, h: str = "headers") -> Column:
    """F2 (D1): both ratings >= n; missing = 0, unparsable = reject."""
    w = parse_elo(header(h, "WhiteElo", "0"))
    b = parse_elo(header(h, "BlackElo", "0"))
    return F.coalesce((w >= n) & (b >= n), F.lit(False))


def date_ok(excluded=tuple(EXCLUDED_DATES), h: str = "headers") -> Column:
    """F3 (D2): date parses (missing = 1970.01.01) and is not excluded."""
    d = parse_game_date(header(h, "UTCDate", DEFAULT_DATE))
    return d.isNotNull() & ~d.isin(*[F.to_date(F.lit(x)) for x in excluded])


def normal_end(h: str = "headers") -> Column:
    """F4 (D3): termination missing or Normal."""
    return header(h, "Termination", DEFAULT_TERMINATION) == DEFAULT_TERMINATION


def default_rules(min_elo_value: int = MIN_ELO, h: str = "headers") -> dict[str, Column]:
    """F1-F4 as failing predicates, in the reference's order."""
    return {
        "bot": ~not_bot(h),
        "elo": ~min_elo(min_elo_value, h),
        "date": ~date_ok(h=h),
        "termination": ~normal_end(h),
    }


def quality(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Add ``reason`` = name of the first failing rule (null = kept)."""
    rules = rules if rules is not None else default_rules()
    reason = F.lit(None).cast("string")
    for name, fails in reversed(list(rules.items())):
        reason = F.when(F.coalesce(fails, F.lit(True)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def keep_quality(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    return quality(df, rules).filter(F.col("reason").isNull()).drop("reason")


def quality_report(df: DataFrame) -> DataFrame:
    """A1: games kept and skipped, by reason (``kept`` for accepted games)."""
    return (df.withColumn("reason", F.coalesce("reason", F.lit("kept")))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def min_plies(n: int = 10, moves: str = "moves") -> Column:
    """F6."""
    return F.size(moves) >= n


def ply_range(lo: int = PLY_RANGE[0], hi: int = PLY_RANGE[1], moves: str = "moves") -> Column:
    """lo <= plies <= hi."""
    return F.size(moves).between(lo, hi)


def min_time(n: int = MIN_BASE_SECONDS, h: str = "headers") -> Column:
    """F8: not known to be faster than n seconds: only a ``base+inc`` control with a
    smaller base fails; absent, ``-`` and other controls pass."""
    return ~F.coalesce(time_base(header(h, "TimeControl")) < n, F.lit(False))


def draw_kept(key: str, rate: float = DRAW_KEEP_RATE, seed: int = 42,
              h: str = "headers") -> Column:
    """a draw survives with probability ``rate`` (by hash); others always."""
    is_draw = F.coalesce(header(h, "Result") == "1/2-1/2", F.lit(False))
    return ~is_draw | (hash32(seed, key) < F.lit(int(rate * TWO32)))


def cap_per_group(df: DataFrame, key: str, n: int = OPENING_CAP, order=("game_id",)) -> DataFrame:
    """at most ``n`` rows per group, first by ``order``; null/empty key uncapped.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so a hot group sends at most ``n`` rows per map task; Spark plans it
    up to a threshold, which is raised to ``n`` here.  Rows without a key get one
    of their own from ``order`` (a total order), so the input is read once.
    """
    from pyspark.sql import Window
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT_CONF, "1000")) < n:
        conf.set(GROUP_LIMIT_CONF, str(n))
    free = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    alone = F.when(free, F.concat_ws("\u0001", *[F.col(o).cast("string") if isinstance(o, str) else o.cast("string")
                                                for o in order]))
    w = Window.partitionBy(F.col(key), alone).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def elo_tier(bounds=tuple(ELO_TIERS), h: str = "headers") -> Column:
    """tier index of the lower rating (0 below the first bound)."""
    w, b = parse_elo(header(h, "WhiteElo", "0")), parse_elo(header(h, "BlackElo", "0"))
    # ``least`` skips nulls; an unparsable rating must give no tier at all
    lo = F.when(w.isNotNull() & b.isNotNull(), F.least(w, b))
    t = F.lit(0)
    for i, b in enumerate(sorted(bounds), start=1):
        t = F.when(lo >= b, F.lit(i)).otherwise(t)
    return F.when(lo.isNull(), F.lit(None)).otherwise(t)


def parse_errors(h: str = "headers") -> Column:
    """why a record's fields do not parse (null when they all do).

    Failures are values, not exceptions: a rating that is present but not an
    integer, a date that is present but not ``yyyy.M.d``, a time control
    without a base.  Codes are joined with ``,`` in a fixed order.
    """
    w, b = header(h, "WhiteElo"), header(h, "BlackElo")
    d, tc = header(h, "UTCDate"), header(h, "TimeControl")
    codes = F.array_compact(F.array(
        F.when(w.isNotNull() & parse_elo(w).isNull(), F.lit("white_elo")),
        F.when(b.isNotNull() & parse_elo(b).isNull(), F.lit("black_elo")),
        F.when(d.isNotNull() & parse_game_date(d).isNull(), F.lit("date")),
        F.when(tc.isNotNull() & (tc != "-") & time_base(tc).isNull(), F.lit("time_control")),
    ))
    return F.when(F.size(codes) > 0, F.array_join(codes, ","))


def error_report(df: DataFrame, h: str = "headers") -> DataFrame:
    """rows counted per parse-error code (rows without errors are not listed)."""
    e = df.select(F.explode(F.split(parse_errors(h), ",")).alias("error"))
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
