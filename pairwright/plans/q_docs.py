"""Queries on the B2 binding (documents as move sequences)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ngram
from ..operators.ordering import materialize
from ..operators.pairs import build_pairs
from . import bindings as B
from .registry import BOUNDS, H, SEQS, register

_CUT = int(B.PROPOSAL_FRACTION * 4294967296)

# positions drawn from every document (oracle CTE ``pos``)
_POS_SQL = f"""
{SEQS},
b AS ({BOUNDS('seqs_n')}),
pos AS (
  SELECT doc_id, lang, source, n_plies, lo, hi,
         lo + ({H(B.SEED, 'doc_id')} % (hi - lo + 1)) AS move_index, moves
  FROM b WHERE lo IS NOT NULL
)"""


@register("doc_positions", f"""
WITH {_POS_SQL.strip()}
SELECT doc_id, CAST(n_plies AS BIGINT) AS n_plies, CAST(lo AS BIGINT) AS lo,
       CAST(hi AS BIGINT) AS hi, CAST(move_index AS BIGINT) AS move_index,
       array_to_string(list_slice(moves, 1, move_index), ' ') AS prompt,
       moves[move_index + 1] AS expert
FROM pos
""")
def doc_positions(spark, sf_dir):
    """P6 + L13 + L5 + F6: one sampled position per document, whole texts."""
    p = B.doc_positions(B.doc_sequences(spark, sf_dir))
    return p.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_plies", "lo", "hi", "move_index")],
                    "prompt", "expert")


def _doc_pairs_df(spark, sf_dir):
    seqs = B.split_docs(B.doc_sequences(spark, sf_dir))
    train = seqs.filter(F.col("split") == "train")
    bigram = ngram.ngram_counts(train, max_ctx=1, min_ctx=1)
    best = ngram.argmax_next(bigram, name="move").select(F.col("ctx").alias("last"), "move")
    pos = B.doc_positions(seqs.filter(F.col("split") == "eval")) \
           .withColumn("position_id", F.col("doc_id"))
    pos = materialize(pos.select("position_id", "doc_id", "source", "lang", "move_index", "prompt", "last", "expert"))
    legal = B.legal_tokens(seqs).withColumnRenamed("san", "move")
    student = (pos.select("position_id", "lang", "last").join(best, "last")
               .join(legal, ["lang", "move"], "left_semi").select("position_id", "move"))
    expert = pos.select("position_id", F.col("expert").alias("move"))
    pairs = build_pairs(pos.select("position_id", "doc_id", "source", "lang", "move_index", "prompt"),
                        student, expert)
    return pairs.select("doc_id", "source", "lang", F.col("move_index").cast("bigint").alias("move_index"),
                        "prompt", "chosen", "rejected")


_PAIRS_SQL = f"""
WITH {SEQS.strip()},
sp AS (SELECT *, CASE WHEN {H(B.SPLIT_SEED, 'doc_id')} < {_CUT} THEN 'eval' ELSE 'train' END AS split
       FROM seqs_n),
bg AS (
  SELECT ctx, nxt, count(*) AS cnt FROM (
    SELECT unnest(list_slice(moves, 1, len(moves) - 1)) AS ctx,
           unnest(list_slice(moves, 2, len(moves))) AS nxt
    FROM sp WHERE split = 'train' AND len(moves) >= 2)
  GROUP BY ctx, nxt
),
best AS (
  SELECT ctx AS last, nxt AS move FROM (
    SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY cnt DESC, nxt) AS r FROM bg) WHERE r = 1
),
legal AS (
  SELECT lang, tok AS move FROM (SELECT lang, unnest(moves) AS tok FROM seqs)
  GROUP BY lang, tok HAVING count(*) >= 2
),
b AS ({BOUNDS("(SELECT * FROM sp WHERE split = 'eval')")}),
pos AS (
  SELECT doc_id, lang, source, lo + ({H(B.SEED, 'doc_id')} % (hi - lo + 1)) AS move_index, moves
  FROM b WHERE lo IS NOT NULL
),
pos2 AS (
  SELECT doc_id, lang, source, move_index,
         array_to_string(list_slice(moves, 1, move_index), ' ') AS prompt,
         moves[move_index] AS last, moves[move_index + 1] AS expert
  FROM pos
)
SELECT p.doc_id, p.source, p.lang, CAST(p.move_index AS BIGINT) AS move_index, p.prompt,
       p.expert AS chosen, s.move AS rejected
FROM pos2 p JOIN best s ON s.last = p.last
WHERE EXISTS (SELECT 1 FROM legal l WHERE l.lang = p.lang AND l.move = s.move)
  AND p.expert <> s.move
"""


@register("doc_pairs", _PAIRS_SQL)
def doc_pairs(spark, sf_dir):
    """J3-J5 + F12-F14 + M1 (bigram) + L4: preference pairs from documents.

    The bigram student is fitted on the ``train`` half and asked about
    positions of the ``eval`` half; chosen = the real next token (expert),
    rejected = the student's legal, different prediction.
    """
    return _doc_pairs_df(spark, sf_dir)


@register("doc_pairs_per_source", f"""
WITH p AS ({_PAIRS_SQL.strip()})
SELECT source, count(*)::BIGINT AS n_pairs, count(DISTINCT rejected)::BIGINT AS n_rejected_moves
FROM p GROUP BY source
""")
def doc_pairs_per_source(spark, sf_dir):
    """Flagship summary: preference pairs per source."""
    return _doc_pairs_df(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("rejected").alias("n_rejected_moves"))
