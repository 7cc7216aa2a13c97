"""Move vocabulary, fixed-length encoding and declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import global_row_number

# RL prompt records are 512 ids long (reference feature schema).
MAX_LENGTH = 512
PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2
PIECE_PATTERN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"

RL_SCHEMA = T.StructType([T.StructField("input_ids", T.ArrayType(T.LongType(), False), False)])


def build_vocab(df: DataFrame, moves: str = "moves", min_count: int = 1) -> DataFrame:
    """Token, id, count -- ids 1.. by count desc then token.

    Counting is a partial aggregate; numbering uses a distributed sort (no
    single-task window), so the vocabulary may be as large as the data allows.
    """
    counts = (df.select(F.explode(moves).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    if min_count > 1:
        counts = counts.filter(F.col("count") >= min_count)
    return global_row_number(counts, [F.col("count").desc(), F.col("token")], "id") \
        .select("token", "id", "count")


def encode(df: DataFrame, vocab: DataFrame, key: str, moves: str = "moves",
           length: int = MAX_LENGTH, pad_id: int = PAD_ID, unk_id: int = UNK_ID) -> DataFrame:
    """Ids by vocabulary, truncated and right-padded to ``length``.

    Only the first ``length`` tokens of each row are exploded; the vocabulary
    is joined as a table (AQE broadcasts it only if its measured size is
    small); ids are put back in order with a per-row ``collect_list`` bounded
    by ``length``.  Output: key, input_ids, attention_mask, n_tokens.
    """
    toks = df.select(key, F.posexplode(F.filter(F.slice(moves, 1, length), lambda x: x != ""))
                     .alias("pos", "token"))
    v = vocab.select("token", (F.col("id") + (FIRST_ID - 1)).alias("tid"))
    ided = toks.join(v, "token", "left").withColumn("tid", F.coalesce("tid", F.lit(unk_id)))
    agg = ided.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("_p"))
    ids = F.transform("_p", lambda s: s["tid"].cast("bigint"))
    out = df.select(key).join(agg, key, "left") \
            .withColumn("_ids", F.coalesce(ids, F.array().cast("array<bigint>")))
    n = F.size("_ids")
    return out.select(
        key,
        # elements are never null: the declared schema says so (containsNull=False)
        F.transform(F.concat("_ids", F.array_repeat(F.lit(pad_id).cast("bigint"), F.lit(length) - n)),
                    lambda x: F.coalesce(x, F.lit(pad_id).cast("bigint"))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1).cast("bigint"), n),
                 F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - n)).alias("attention_mask"),
        n.cast("bigint").alias("n_tokens"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns and types, input columns removed."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def token_cost(df: DataFrame, text: str = "text", moves: str = "moves") -> DataFrame:
    """Pieces of a character-class split per move vs one id per move."""
    pieces = F.size(F.regexp_extract_all(F.col(text), F.lit(PIECE_PATTERN), 0))
    return df.agg(F.sum(F.size(moves)).cast("bigint").alias("n_moves"),
                  F.sum(pieces).cast("bigint").alias("n_pieces")) \
             .withColumn("pieces_per_move", F.round(F.col("n_pieces") / F.col("n_moves"), 6)) \
             .withColumn("saving_pct", F.round(F.lit(100.0) * (F.lit(1.0) - F.col("n_moves") / F.col("n_pieces")), 6))
