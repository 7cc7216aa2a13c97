"""B1: synthetic game records rendered from ``orders``, then parsed back.

Each order becomes one game record in the text format (tag lines, blank line,
move text) built with Spark string functions; the same parser that reads real
archives turns it back into headers and moves.  With ``k = o_orderkey``:

* WhiteElo 1500 + (k*37) % 1300 ('?' if k % 41 = 0, tag missing if k % 43 = 0,
  an earlier duplicate tag if k % 17 = 0); BlackElo 1500 + (k*53) % 1300;
* WhiteTitle BOT if k % 29 = 0;
* UTCDate = o_orderdate as yyyy.MM.dd (2021.03.12 if k % 97 = 0,
  ????.??.?? if k % 89 = 0, unpadded yyyy.M.d if k % 83 = 0);
* Termination: status F Normal, O Time forfeit, P no tag;
* ECO: letter A-E from custkey % 5, then 0, then custkey % 2;
* TimeControl (k % 10) * 60 + '+' + k % 3 (tag missing if k % 31 = 0, '-' if
  k % 37 = 0, '600' if k % 47 = 0); Result from the order priority;
* White P<custkey % 7>, Black P<(custkey + 1 + k % 6) % 7>;
* moves: the first (k*7) % 61 plies of line k % 3; clock comments if
  k % 5 = 0, marks before NAGs and comments if k % 7 = 0, a variation nested
  four deep if k % 11 = 0, castling with zeros, a stray bracket and a line
  comment if k % 19 = 0, an escaped quote in Event if k % 13 = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.barrier import computed_once
from ..functions.pgn import mainline, parse_headers
from .bindings import table

# Fixed move lines (legal from the initial position).
LINES = [
    "e4 e5 Nf3 d6 d4 Bg4 dxe5 Bxf3 Qxf3 dxe5 Bc4 Nf6 Qb3 Qe7 Nc3 c6 Bg5 b5 Nxb5 cxb5 "
    "Bxb5+ Nbd7 O-O-O Rd8 Rxd7 Rxd7 Rd1 Qe6 Bxd7+ Nxd7 Qb8+ Nxb8 Rd8#",
    "e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7 Re1 b5 Bb3 d6 c3 O-O h3 Nb8 d4 Nbd7 Nbd2 Bb7 "
    "Bc2 Re8 Nf1 Bf8 Ng3 g6 a4 c5" + " Kh1 Kh8 Kg1 Kg8" * 8,
    " ".join(["Nf3 Nf6 Ng1 Ng8"] * 15),
]
LINES = [" ".join(x.split()[:60]) for x in LINES]
# Result by the first digit of the order priority.
RESULTS = {"1": "1-0", "2": "0-1", "3": "1/2-1/2", "4": "1-0", "5": "0-1"}
CLOCK = " {[%clk 0:03:00]}"
VARIATION = " ( 2. d4 ( 2. c3 ( 2. b3 ( 2. a3 a6 ) b6 ) ) exd4 )"


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'[{name} "'), value, F.lit('"]'))


def _movetext_variants() -> list[tuple[int, int, int, str]]:
    """(line, plies, decoration bits, move text) for every line prefix.

    Decoration bits: 1 = clock comments, 2 = marks and NAGs, 4 = variation,
    8 = zero castling, stray bracket and line comment.
    A fixed table of 3 x 61 x 16 rows, built from the rule above.
    """
    rows = []
    for li, line in enumerate(LINES):
        moves = line.split()
        for n in range(61):
            for bits in range(16):
                parts = []
                for i, x in enumerate(moves[:n]):
                    tok = (f"{i // 2 + 1}. " if i % 2 == 0 else "") + x
                    if bits & 8:
                        tok = tok.replace("O-O", "0-0").replace("-O", "-0")
                    if bits & 2 and i < 3:
                        tok += ("!$1", "!?{sharp}", "??;loses\n")[i]
                    if bits & 1:
                        tok += CLOCK
                    if bits & 4 and i == 1:
                        tok += VARIATION
                    if bits & 8 and i == 2:
                        tok += " ) ; stray\n"
                    parts.append(tok)
                rows.append((li, n, bits, " ".join(parts)))
    return rows


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly to a given number of tasks (merged by size they would be few).

    By all columns: one that repeats or is null does not gather its rows."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *df.columns)


def render_games(orders: DataFrame) -> DataFrame:
    """game_id, pgn (one game record per order).

    The move text comes from a broadcast lookup of the fixed variant table
    (2 928 rows, independent of the data size) instead of a per-ply lambda.
    The orders, some tens of bytes a row, are dealt out first: a file or a row
    group holds far more records than one task should render and parse.
    """
    orders = dealt(orders)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spark = orders.sparkSession
    variants = spark.createDataFrame(_movetext_variants(), "_line int, _n int, _bits int, _text string")
    bits = (F.when(k % 5 == 0, 1).otherwise(0) + F.when(k % 7 == 0, 2).otherwise(0)
            + F.when(k % 11 == 0, 4).otherwise(0) + F.when(k % 19 == 0, 8).otherwise(0))
    orders = orders.withColumn("_line", (k % 3).cast("int")).withColumn("_n", ((k * 7) % 61).cast("int")) \
                   .withColumn("_bits", bits.cast("int")) \
                   .join(F.broadcast(variants), ["_line", "_n", "_bits"])

    result = F.create_map(*[v for d, r in RESULTS.items() for v in (F.lit(d), F.lit(r))])[
        F.substring("o_orderpriority", 1, 1)]
    text = F.concat_ws(" ", F.nullif(F.col("_text"), F.lit("")), result)
    date = (F.when(k % 97 == 0, F.lit("2021.03.12"))
            .when(k % 89 == 0, F.lit("????.??.??"))
            .when(k % 83 == 0, F.date_format("o_orderdate", "yyyy.M.d"))
            .otherwise(F.date_format("o_orderdate", "yyyy.MM.dd")))
    welo = F.when(k % 41 == 0, F.lit("?")).otherwise((F.lit(1500) + (k * 37) % 1300).cast("string"))
    belo = (F.lit(1500) + (k * 53) % 1300).cast("string")
    term = F.when(F.col("o_orderstatus") == "F", F.lit("Normal")) \
            .when(F.col("o_orderstatus") == "O", F.lit("Time forfeit"))
    eco = F.concat(F.expr("chr(65 + cast(o_custkey % 5 as int))"), F.lit("0"), (c % 2).cast("string"))
    event = F.when(k % 13 == 0, F.lit('Rated \\"Blitz\\" game')).otherwise(F.lit("Rated game"))
    tags = F.concat_ws("\n", *(
        _tag("Event", event),
        _tag("White", F.concat(F.lit("P"), (c % 7).cast("string"))),
        _tag("Black", F.concat(F.lit("P"), ((c + 1 + k % 6) % 7).cast("string"))),
        _tag("Result", result),
        F.when(k % 17 == 0, _tag("WhiteElo", F.lit("1000"))),
        F.when(k % 43 != 0, _tag("WhiteElo", welo)),
        _tag("BlackElo", belo),
        F.when(k % 29 == 0, _tag("WhiteTitle", F.lit("BOT"))),
        _tag("UTCDate", date),
        F.when(term.isNotNull(), _tag("Termination", term)),
        _tag("ECO", eco),
        F.when(k % 31 != 0, _tag("TimeControl", F.when(k % 37 == 0, F.lit("-")).when(k % 47 == 0, F.lit("600"))
               .otherwise(F.concat(((k % 10) * 60).cast("string"), F.lit("+"), (k % 3).cast("string"))))),
    ))  # concat_ws skips the null (absent) tags
    pgn = F.concat(tags, F.lit("\n\n"), text, F.lit("\n"))
    return orders.select(k.alias("game_id"), pgn.alias("pgn"))


def parse_games(df: DataFrame, text: str = "pgn", with_moves: bool = True) -> DataFrame:
    """game records -> game_id, headers (map), moves (array), n_plies.

    Each parsed column is computed once per row; ``with_moves=False`` skips the
    main-line parse for jobs that only read the tags.
    """
    g = computed_once(df, ["game_id", text], headers=parse_headers(text))
    if not with_moves:
        return g.drop(text)
    g = computed_once(g, ["game_id", "headers"], moves=mainline(text))
    return g.withColumn("n_plies", F.size("moves"))


def synthetic_games(spark: SparkSession, sf_dir: str, with_moves: bool = True) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return parse_games(render_games(orders), with_moves=with_moves)


# ---- oracle side: the same values computed straight from orders ---------

SQL_GAMES = """
g0 AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderdate AS od,
         substr(o_orderpriority, 1, 1) AS pr
  FROM orders
),
lines AS (SELECT {lines} AS l),
g AS (
  SELECT k AS game_id, k, c, st,
         CASE WHEN k % 43 = 0 THEN (CASE WHEN k % 17 = 0 THEN 1000 END)
              WHEN k % 41 = 0 THEN NULL ELSE 1500 + (k * 37) % 1300 END AS white_elo,
         1500 + (k * 53) % 1300 AS black_elo,
         k % 29 = 0 AS white_bot,
         CASE WHEN k % 97 = 0 THEN DATE '2021-03-12' WHEN k % 89 = 0 THEN NULL ELSE CAST(od AS DATE) END AS game_date,
         CASE st WHEN 'F' THEN 'Normal' WHEN 'O' THEN 'Time forfeit' END AS termination,
         chr(CAST(65 + c % 5 AS INTEGER)) || '0' || CAST(c % 2 AS VARCHAR) AS eco,
         CASE WHEN k % 31 <> 0 AND k % 37 <> 0 AND k % 47 <> 0 THEN CAST((k % 10) * 60 AS INTEGER) END AS time_base,
         CASE pr WHEN '1' THEN '1-0' WHEN '2' THEN '0-1' WHEN '3' THEN '1/2-1/2' WHEN '4' THEN '1-0' ELSE '0-1' END AS result,
         'P' || CAST(c % 7 AS VARCHAR) AS white,
         'P' || CAST((c + 1 + k % 6) % 7 AS VARCHAR) AS black,
         list_slice(lines.l[CAST(k % 3 AS INTEGER) + 1], 1, CAST((k * 7) % 61 AS INTEGER)) AS moves
  FROM g0, lines
),
gq AS (
  SELECT *, len(moves) AS n_plies,
         CASE WHEN white_bot THEN 'bot'
              WHEN white_elo IS NULL OR white_elo < 2000 OR black_elo < 2000 THEN 'elo'
              WHEN game_date IS NULL OR game_date = DATE '2021-03-12' THEN 'date'
              WHEN coalesce(termination, 'Normal') <> 'Normal' THEN 'termination'
         END AS reason
  FROM g
)""".replace("{lines}", "[" + ", ".join(
    "[" + ", ".join(f"'{m}'" for m in line.split()) + "]" for line in LINES) + "]")
