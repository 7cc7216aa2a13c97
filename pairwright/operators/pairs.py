"""Candidates, legality, preference pairs and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_token, strip_prompt
from .bloom import anti_join

# Fixed value: the reference's SAN-like pattern for moves found in free text.
SAN_PATTERN = r"[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[KQRBN])?[+#]?|O-O-O|O-O"


def extract_moves(c) -> Column:
    """Every SAN-like string in the text, in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(SAN_PATTERN), 0)


def candidates(texts: DataFrame, key: str = "position_id", text: str = "text",
               prompt: str = "prompt", text_no: str = "text_no", mode: str = "prefix") -> DataFrame:
    """Ordered candidate list of each generated text.

    The prompt is removed (D9 ``mode``), then the first whitespace token comes
    first, followed by the pattern hits.  Output: key, text_no, cand_no, san.
    """
    rest = F.trim(strip_prompt(text, prompt, mode))
    lst = F.concat(F.array(F.coalesce(first_token(rest), F.lit(""))), extract_moves(rest))
    lst = F.filter(lst, lambda x: x != "")
    return texts.select(key, text_no, F.posexplode(lst).alias("cand_no", "san")) \
                .withColumn("cand_no", F.col("cand_no") + 1)


def legal_only(cands: DataFrame, legal: DataFrame, keys=("position_id", "san")) -> DataFrame:
    """Keep candidates present in the legal-move table (semi join)."""
    return cands.join(legal, list(keys), "left_semi")


def first_legal(cands: DataFrame, legal: DataFrame, key: str = "position_id",
                name: str = "move", keys=None) -> DataFrame:
    """J2 (+F13): first legal candidate per position in (text_no, cand_no) order.

    ``min_by`` is a partial aggregate; positions without a legal candidate
    disappear, as the reference's ``None`` results do.
    """
    ok = legal_only(cands, legal, keys or (key, "san"))
    return ok.groupBy(key).agg(F.min_by("san", F.struct("text_no", "cand_no")).alias(name))


def build_pairs(positions: DataFrame, student: DataFrame, expert: DataFrame,
                key: str = "position_id", prompt: str = "prompt") -> DataFrame:
    """J3 + J4 + F14 = J5: (prompt, chosen = expert, rejected = student).

    Moves are joined by position key, never by order; only disagreements stay.
    """
    s = student.select(key, F.col("move").alias("rejected"))
    e = expert.select(key, F.col("move").alias("chosen"))
    return (positions.join(s, key).join(e, key)
            .filter(F.col("chosen") != F.col("rejected")))


def disagreements(df: DataFrame) -> DataFrame:
    """F14."""
    return df.filter(F.col("chosen") != F.col("rejected"))


def format_pairs(df: DataFrame) -> DataFrame:
    """chosen/rejected become prompt + ' ' + move (null prompt stays null)."""
    return df.withColumn("chosen", F.concat(F.col("prompt"), F.lit(" "), F.col("chosen"))) \
             .withColumn("rejected", F.concat(F.col("prompt"), F.lit(" "), F.col("rejected")))


def dedup_pairs(df: DataFrame) -> DataFrame:
    """O4 (D12)."""
    return df.dropDuplicates(["prompt", "chosen", "rejected"])


def unprocessed(games: DataFrame, done: DataFrame, key: str = "game_id") -> DataFrame:
    """J7 (D12): games not yet processed.

    A Bloom filter over the finished keys keeps the games that are surely new where
    they are; the others meet the keys in an exact anti join."""
    return anti_join(games, done, [key])


def evaluation_moves(expert: DataFrame, student: DataFrame, key: str = "position_id") -> DataFrame:
    """O3: expert move and student suggestions, distinct."""
    return expert.select(key, "move").unionByName(student.select(key, "move")).distinct()


def canonical_move(c) -> Column:
    """A move's lexical canonical form, without check and mate signs at its end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"[+#]+$", "")


def attach_scores(moves: DataFrame, scores: DataFrame, key: str = "position_id", move: str = "move",
                  score: str = "reward_score") -> DataFrame:
    """Each candidate move with its score (an equi-join on position and move)."""
    return moves.join(scores.select(key, move, score), [key, move])


def annotate_moves(moves: DataFrame, expert: DataFrame, student: DataFrame,
                   key: str = "position_id") -> DataFrame:
    """Note whether a move is the expert's pick, a student suggestion, or both."""
    e = expert.select(key, "move").withColumn("_e", F.lit(True))
    s = student.select(key, "move").distinct().withColumn("_s", F.lit(True))
    out = moves.join(e, [key, "move"], "left").join(s, [key, "move"], "left")
    notes = F.array_compact(F.array(F.when(F.col("_e"), F.lit("expert")),
                                    F.when(F.col("_s"), F.lit("student"))))
    return out.withColumn("notes", F.array_join(notes, ", ")).drop("_e", "_s")
