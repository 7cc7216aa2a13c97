"""How the driver's tables stand in for games, positions and moves.

B2 (documents): a document is a game, a whitespace token is a move; header
fields are ``lang``, ``source`` and ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.barrier import computed_once
from ..functions.text import prefix, tokens
from ..operators.sampling import hash_split, sample_position

# Fixed seeds of the bindings: positions are drawn with SEED, the split that
# separates model-fitting documents from position documents uses SPLIT_SEED.
SEED = 42
SPLIT_SEED = 7
PROPOSAL_FRACTION = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, moves (array<string>), n_plies."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    seqs = computed_once(d, ["doc_id", "lang", "source"], moves=tokens("text"))
    return seqs.withColumn("n_plies", F.size("moves"))


def doc_positions(seqs: DataFrame, seed: int = SEED) -> DataFrame:
    """One sampled position per document: prompt, last move, expert = real next move.

    Only the prompt slice and two single tokens leave this step; the full
    sequence is not carried further.
    """
    p = sample_position(seqs, "doc_id", seed)
    k = F.col("move_index")
    return p.select("doc_id", "lang", "source", "n_plies", "lo", "hi", "move_index",
                    prefix("moves", k).alias("prompt"),
                    F.element_at("moves", k).alias("last"),
                    F.element_at("moves", k + 1).alias("expert"))


def split_docs(seqs: DataFrame) -> DataFrame:
    """Model documents (``train``) and position documents (``eval``)."""
    return hash_split(seqs, "doc_id", PROPOSAL_FRACTION, SPLIT_SEED)


def legal_tokens(seqs: DataFrame, min_count: int = 2) -> DataFrame:
    """``legal`` = tokens of the same language seen at least ``min_count`` times."""
    return (seqs.select("lang", F.explode("moves").alias("san"))
            .groupBy("lang", "san").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count).select("lang", "san"))
