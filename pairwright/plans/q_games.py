"""Queries on the B1 binding (game records rendered from orders and parsed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pgn
from ..functions.text import to_sequence
from ..operators import quality as Q
from ..operators.encode import build_vocab
from ..operators.pairs import unprocessed
from ..operators.report import match_summary
from ..operators.sampling import first_n
from .bindings import table
from .games import SQL_GAMES, parse_games, render_games, synthetic_games
from .registry import H, register

W = f"WITH {SQL_GAMES.strip()}"
CAP = 30  # games per opening in the query: small enough to cut the test tables


def _b(c):
    return F.col(c).cast("bigint").alias(c)


@register("game_headers", f"""{W}
SELECT game_id, CAST(white_elo AS BIGINT) AS white_elo, CAST(black_elo AS BIGINT) AS black_elo,
       strftime(game_date, '%Y-%m-%d') AS game_date, termination, eco,
       CAST(time_base AS BIGINT) AS time_base, result, white, black, CAST(n_plies AS BIGINT) AS n_plies
FROM gq""")
def game_headers(spark, sf_dir):
    """S1-style parse (P1, P2, P16, P17, P18): typed columns from the header map."""
    g = synthetic_games(spark, sf_dir)
    h = "headers"
    return g.select(
        "game_id",
        pgn.parse_elo(pgn.header(h, "WhiteElo")).cast("bigint").alias("white_elo"),
        pgn.parse_elo(pgn.header(h, "BlackElo")).cast("bigint").alias("black_elo"),
        F.date_format(pgn.parse_game_date(pgn.header(h, "UTCDate", Q.DEFAULT_DATE)), "yyyy-MM-dd").alias("game_date"),
        pgn.header(h, "Termination").alias("termination"),
        pgn.header(h, "ECO").alias("eco"),
        pgn.time_base(pgn.header(h, "TimeControl")).cast("bigint").alias("time_base"),
        pgn.header(h, "Result").alias("result"),
        pgn.header(h, "White").alias("white"),
        pgn.header(h, "Black").alias("black"),
        _b("n_plies"))


@register("game_quality_report", f"""{W}
SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM gq GROUP BY 1""")
def game_quality_report(spark, sf_dir):
    """F1-F5 + A1: games kept and skipped by the first failing rule."""
    return Q.quality_report(Q.quality(synthetic_games(spark, sf_dir, with_moves=False))).select("reason", _b("n"))


def _kept(spark, sf_dir):
    return Q.keep_quality(synthetic_games(spark, sf_dir))


@register("sft_games", f"""{W}
SELECT game_id, array_to_string(moves, ' ') AS text, CAST(n_plies AS BIGINT) AS n_plies
FROM gq WHERE reason IS NULL""")
def sft_games(spark, sf_dir):
    """Entry point A (P3, P4, F5, D5): one space-joined move sequence per kept game."""
    return _kept(spark, sf_dir).select("game_id", to_sequence("moves").alias("text"), _b("n_plies"))


@register("game_plies", f"""{W}
SELECT game_id, CAST(ply AS BIGINT) AS ply, san FROM (
  SELECT game_id, generate_subscripts(moves, 1) AS ply, unnest(moves) AS san FROM gq)""")
def game_plies(spark, sf_dir):
    """P5: one row per ply of every game (1-based ply)."""
    g = synthetic_games(spark, sf_dir)
    return g.select("game_id", F.posexplode("moves").alias("ply", "san")) \
            .select("game_id", (F.col("ply") + 1).cast("bigint").alias("ply"), "san")


@register("first_games", f"""{W}
SELECT game_id, array_to_string(moves, ' ') AS text FROM gq WHERE reason IS NULL
ORDER BY game_id LIMIT 1000""")
def first_games(spark, sf_dir):
    """L1 (D6): the first 1000 accepted games in input order (the reference's default)."""
    return first_n(_kept(spark, sf_dir).select("game_id", to_sequence("moves").alias("text")),
                   1000, ["game_id"])


@register("game_filters", f"""{W}
SELECT game_id,
       n_plies >= 10 AS min_plies_ok,
       n_plies BETWEEN 20 AND 100 AS ply_range_ok,
       NOT coalesce(time_base < 300, false) AS time_ok,
       (result <> '1/2-1/2') OR {H(42, 'game_id')} < {int(0.3 * 4294967296)} AS draw_kept,
       CAST(CASE WHEN k % 43 <> 0 AND k % 41 = 0 THEN NULL
                 WHEN least(coalesce(white_elo, 0), black_elo) >= 2400 THEN 1 ELSE 0 END AS BIGINT) AS elo_tier
FROM gq""")
def game_filters(spark, sf_dir):
    """Proposed filters as flags on every game."""
    g = synthetic_games(spark, sf_dir)
    return g.select("game_id",
                    Q.min_plies(10).alias("min_plies_ok"),
                    Q.ply_range().alias("ply_range_ok"),
                    Q.min_time().alias("time_ok"),
                    Q.draw_kept("game_id").alias("draw_kept"),
                    Q.elo_tier().cast("bigint").alias("elo_tier"))


@register("opening_cap", f"""{W}
SELECT game_id, eco FROM (
  SELECT game_id, eco, row_number() OVER (PARTITION BY eco ORDER BY game_id) AS r FROM gq WHERE reason IS NULL)
WHERE r <= {CAP}""")
def opening_cap(spark, sf_dir, n: int = CAP):
    """at most ``n`` games per opening among those that pass the quality rules,
    first by game id (the proposal's own cap is ``quality.OPENING_CAP``)."""
    g = Q.keep_quality(synthetic_games(spark, sf_dir, with_moves=False))
    return Q.cap_per_group(g.select("game_id", pgn.header("headers", "ECO").alias("eco")), "eco", n, ["game_id"])


@register("opening_counts", f"""{W}
SELECT eco, count(*)::BIGINT AS n FROM gq WHERE reason IS NULL GROUP BY eco""")
def opening_counts(spark, sf_dir):
    """A10: kept games per opening."""
    g = Q.keep_quality(synthetic_games(spark, sf_dir, with_moves=False))
    return g.groupBy(pgn.header("headers", "ECO").alias("eco")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("move_features", f"""{W}
SELECT san, count(*)::BIGINT AS n,
       contains(san, 'x') AS capture, contains(san, '+') AS "check", contains(san, '#') AS mate,
       starts_with(san, 'O-O') AS castle, regexp_matches(san, '=[KQRBN]') AS promotion,
       CASE WHEN starts_with(san, 'O-O') THEN 'K'
            ELSE coalesce(nullif(regexp_extract(san, '^([KQRBN])', 1), ''), 'P') END AS piece,
       nullif(regexp_extract(san, '([a-h][1-8])(?:=[KQRBN])?[+#]?$', 1), '') AS target
FROM (SELECT unnest(moves) AS san FROM gq WHERE reason IS NULL) GROUP BY san""")
def move_features(spark, sf_dir):
    """Lexical features of every distinct move of kept games, with counts."""
    plies = _kept(spark, sf_dir).select(F.explode("moves").alias("san"))
    counts = plies.groupBy("san").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.select("san", "n", *pgn.move_features("san"))


@register("tactic_plies", f"""{W}
SELECT game_id, CAST(i AS BIGINT) AS ply,
       len(list_filter(list_slice(moves, i + 1, i + 3), lambda x: regexp_matches(x, '[x+#]'))) > 0 AS has_motif
FROM (SELECT game_id, moves, generate_subscripts(moves, 1) AS i FROM gq WHERE reason IS NULL)""")
def tactic_plies(spark, sf_dir):
    """P20: for every ply of kept games, is there a tactic in the next 3 moves."""
    g = _kept(spark, sf_dir).select("game_id", "moves")
    return g.select("game_id", F.inline(F.transform(
        "moves", lambda x, i: F.struct((i + 1).cast("bigint").alias("ply"),
                                       pgn.has_motif(F.col("moves"), i + 1).alias("has_motif")))))


@register("move_vocab", f"""{W}
SELECT san AS token, row_number() OVER (ORDER BY cnt DESC, san) AS id, cnt AS "count" FROM (
  SELECT san, count(*)::BIGINT AS cnt FROM (SELECT unnest(moves) AS san FROM gq) GROUP BY san)""")
def move_vocab(spark, sf_dir):
    """One id per move, by count desc then text (distributed numbering)."""
    return build_vocab(synthetic_games(spark, sf_dir), "moves")


@register("match_summary", f"""{W},
sides AS (
  SELECT white AS player, black AS opponent,
         CASE result WHEN '1-0' THEN 1.0 WHEN '0-1' THEN 0.0 ELSE 0.5 END AS pts FROM gq
  UNION ALL
  SELECT black, white, CASE result WHEN '0-1' THEN 1.0 WHEN '1-0' THEN 0.0 ELSE 0.5 END FROM gq
)
SELECT player, opponent, count(*)::BIGINT AS games,
       count_if(pts = 1.0)::BIGINT AS wins, count_if(pts = 0.5)::BIGINT AS draws,
       count_if(pts = 0.0)::BIGINT AS losses, round(avg(pts), 6) AS score
FROM sides GROUP BY player, opponent""")
def match_summary_q(spark, sf_dir):
    """Win / draw / loss of each player against each opponent, both colours."""
    g = synthetic_games(spark, sf_dir, with_moves=False).select(
        pgn.header("headers", "White").alias("white"), pgn.header("headers", "Black").alias("black"),
        pgn.header("headers", "Result").alias("result"))
    return match_summary(g)


@register("resume_unprocessed", f"""{W}
SELECT game_id, CAST(n_plies AS BIGINT) AS n_plies FROM gq WHERE k % 3 <> 0""")
def resume_unprocessed(spark, sf_dir):
    """J7 (D12): games of a run resumed after the k % 3 = 0 third was done."""
    orders = table(spark, sf_dir, "orders")
    # the processed-id list of the interrupted run: a separate table of keys
    done = orders.select("o_orderkey").filter(F.col("o_orderkey") % 3 == 0)
    todo = unprocessed(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), done, "o_orderkey")
    return parse_games(render_games(todo)).select("game_id", _b("n_plies"))     # finished games are not parsed again


@register("game_parse_errors", f"""{W}
SELECT error, count(*)::BIGINT AS n FROM (
  SELECT 'white_elo' AS error FROM gq WHERE k % 41 = 0 AND k % 43 <> 0
  UNION ALL
  SELECT 'date' FROM gq WHERE k % 89 = 0 AND k % 97 <> 0
  UNION ALL
  SELECT 'time_control' FROM gq WHERE k % 47 = 0 AND k % 37 <> 0 AND k % 31 <> 0)
GROUP BY error""")
def game_parse_errors(spark, sf_dir):
    """fields that do not parse, counted by code (values, never exceptions)."""
    return Q.error_report(synthetic_games(spark, sf_dir, with_moves=False)).select("error", _b("n"))
