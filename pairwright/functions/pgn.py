"""Game-record parsing as column expressions.

Everything here is a built-in Spark expression (regex, split, higher-order
functions), so it runs inside the JVM on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the game-record text format.
TAG_PATTERN = r'(?m)^\[(\w+) "([^"\\]*(?:\\.[^"\\]*)*)"\]'
DATE_FORMAT = "yyyy.M.d"
# Lexical move features.
CAPTURE, CHECK, MATE = "x", "+", "#"
PIECE_PATTERN = r"^([KQRBN])"
TARGET_PATTERN = r"([a-h][1-8])(?:=[KQRBN])?[+#]?$"
PROMOTION_PATTERN = r"=[KQRBN]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_headers(text) -> Column:
    """``[Tag "value"]`` lines -> map<string,string> (duplicate tag: last wins,
    with ``spark.sql.mapKeyDedupPolicy=LAST_WIN``); ``\\"`` and ``\\\\`` unescaped."""
    # the tag block ends at the first blank line: the move text is never searched
    t = F.substring_index(F.ltrim(F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))), "\n\n", 1)
    keys = F.regexp_extract_all(t, F.lit(TAG_PATTERN), 1)
    vals = F.regexp_extract_all(t, F.lit(TAG_PATTERN), 2)
    # unescaping is a per-element lambda: only records holding a backslash pay for it
    vals = F.when(t.contains("\\"), F.transform(vals, lambda v: F.regexp_replace(v, r'\\(["\\])', "$1"))) \
            .otherwise(vals)
    return F.map_from_arrays(keys, vals)


def header(headers, name: str, default: str | None = None) -> Column:
    """Header value with a default when the tag is absent."""
    v = F.try_element_at(_c(headers), F.lit(name))
    return F.coalesce(v, F.lit(default)) if default is not None else v


def movetext(text) -> Column:
    """The part of a record after its leading block of tag lines."""
    return F.trim(F.regexp_replace(_c(text), r"^(?:\s*\[[^\n]*\])+", ""))


INNER_VARIATION = r"\([^()]*\)"
REGEX_DEPTH = 3


def _fold_mainline(t: Column) -> Column:
    """Exact depth-0 filter for any nesting depth (per-token fold; slow path)."""
    t = F.regexp_replace(t, r"[()]", " $0 ")
    toks = F.split(F.trim(t), r"\s+")
    init = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("m"))

    def step(acc, x):
        d = acc["d"]
        nd = F.when(x == "(", d + 1).when(x == ")", F.greatest(d - 1, F.lit(0))).otherwise(d)
        keep = (d == 0) & (x != "(") & (x != ")")
        return F.struct(nd.alias("d"),
                        F.when(keep, F.concat(acc["m"], F.array(x))).otherwise(acc["m"]).alias("m"))

    return F.array_join(F.aggregate(toks, init, step, lambda acc: acc["m"]), " ")


def mainline(text) -> Column:
    """Main-line moves of a record (or bare move text).

    Drops comments, NAGs, ``!``/``?`` marks, move numbers, the result, nested
    variations of any depth and stray closing brackets; castling written with
    zeros becomes letters.  The common path is a handful of
    whole-string regex passes (no look-behind, a single-character split that
    drops empty tokens); innermost variations are removed ``REGEX_DEPTH``
    times and only records nested deeper take the exact per-token fold.
    """
    # one pass: comments, NAGs, !/? marks and line ends all become a space; the
    # look-ahead rules most places out by one character, runs of spaces stay
    t = F.regexp_replace(movetext(text), r"(?=[{;$!?\t\n\x0B\f\r])(?:\{[^}]*\}|;[^\n]*|\$\d+|[!?]+(?=[\s(){};$]|$)|[\t\n\x0B\f\r]+)", " ")
    v = t
    for _ in range(REGEX_DEPTH):
        v = F.regexp_replace(v, INNER_VARIATION, " ")
    v = F.when(v.contains("("), _fold_mainline(v)).otherwise(v)
    t = F.when(t.contains("("), F.translate(v, "()", "  ")).when(t.contains(")"), F.translate(t, "()", "  ")).otherwise(t)
    # every token now sits between spaces: " tok1 tok2 ... "
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r" (?=[\d*])(?:\d+\.+|(?:1-0|0-1|1/2-1/2|\*)(?= ))", " ")  # move numbers, result
    t = F.when(t.contains(" 0-0"), F.regexp_replace(F.regexp_replace(t, " 0-0-0(?=[+# ])", " O-O-O"),
                                                    " 0-0(?=[+# ])", " O-O")).otherwise(t)
    return F.array_remove(F.split(t, " "), "")


def parse_elo(c) -> Column:
    """Integer rating; failure -> null."""
    return _c(c).try_cast("int")


def parse_game_date(c) -> Column:
    """``yyyy.M.d`` date (accepts 2021.3.2 like strptime); failure -> null."""
    return F.to_date(F.try_to_timestamp(_c(c), F.lit(DATE_FORMAT)))


def time_base(c) -> Column:
    """Base seconds of ``base+inc``; null when there is no ``+``."""
    c = _c(c)
    return F.when(c.contains("+"), F.split_part(c, F.lit("+"), F.lit(1)).try_cast("int"))


def move_features(san) -> list[Column]:
    """Capture, check, mate, castle, promotion, piece, target square."""
    s = _c(san)
    return [
        s.contains(CAPTURE).alias("capture"),
        s.contains(CHECK).alias("check"),
        s.contains(MATE).alias("mate"),
        s.startswith("O-O").alias("castle"),
        s.rlike(PROMOTION_PATTERN).alias("promotion"),
        F.when(s.startswith("O-O"), F.lit("K"))
         .otherwise(F.coalesce(F.nullif(F.regexp_extract(s, PIECE_PATTERN, 1), F.lit("")), F.lit("P")))
         .alias("piece"),
        F.nullif(F.regexp_extract(s, TARGET_PATTERN, 1), F.lit("")).alias("target"),
    ]


def is_tactic(san) -> Column:
    """A capture, check or mate (tested on the SAN, D19)."""
    return _c(san).rlike(r"[x+#]")


def has_motif(moves, i, n: int = 3) -> Column:
    """P20: a tactic among the ``n`` moves after 1-based position ``i``."""
    return F.exists(F.slice(_c(moves), _c(i) + 1, F.lit(n)), lambda x: x.rlike(r"[x+#]"))
