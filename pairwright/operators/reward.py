"""Reward side re-aimed as table jobs (M3 pairwise model, M4 scoring, M5 policy).

M3 is a Bradley-Terry model on hashed move counts: x = tf(chosen) - tf(rejected),
P(chosen preferred) = sigmoid(w . x).  It is fitted by full-batch gradient
descent written as DataFrame steps:

* a pair is one row that holds its sparse vector, staged once; a text is counted
  inside its row, so memory follows the longest text and not the tokens of a task;
* the weights (at most ``2^bits`` numbers, a size fixed by a parameter that is
  limited to 18 bits) travel to the rows as one broadcast array;
* a step is one pass without a join on pairs: margin and gradient factor come
  from the row itself, and the gradient is one partial aggregate of at most
  ``2^bits`` rows, which returns to the driver as the next weights;
* steps end when the weights no longer move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.barrier import computed_once
from ..functions.hashing import hash32
from ..functions.text import tokens
from .ordering import materialize

HASH_BITS = 12
MAX_BITS = 18
STEPS = 40           # at most; see TOLERANCE
LEARNING_RATE = 0.5
L2 = 1e-4
TOLERANCE = 2e-3     # largest change of a weight in the last step
HASH_SEED = 5


def token_buckets(text, bits: int = HASH_BITS) -> Column:
    """Sorted buckets (of 2^bits) of a text's tokens, repeats included."""
    return F.sort_array(F.transform(tokens(text), lambda t: F.pmod(hash32(HASH_SEED, t), F.lit(1 << bits)).cast("int")))


def pair_features(pairs: DataFrame, key: str = "pair_id", bits: int = HASH_BITS) -> DataFrame:
    """``key, x``: the sparse vector tf(chosen) - tf(rejected) of each pair, zeros dropped.

    A token is a code: twice its bucket, one more if rejected.  Rows of one key are one
    pair; only their codes are shuffled.  Equal codes are neighbours once sorted, so
    counts are distances between the ends of runs.
    """
    codes = F.concat(F.coalesce(F.transform(token_buckets("chosen", bits), lambda b: b * 2), F.array().cast("array<int>")),
                     F.coalesce(F.transform(token_buckets("rejected", bits), lambda b: b * 2 + 1), F.array().cast("array<int>")))
    z = pairs.select(key, codes.alias("z")).groupBy(key).agg(F.collect_list("z").alias("z")) \
        .select(key, F.sort_array(F.flatten("z")).alias("z")).filter(F.size("z") > 0)
    at = F.sequence(F.lit(0), F.size("z") - 1)
    ends = computed_once(z, [key, "z"], ends=F.filter(at, lambda i: ~F.get("z", i).eqNullSafe(F.get("z", i + 1))))
    runs = computed_once(ends, [key], runs=F.transform("ends", lambda e, j: F.struct(
        F.get("z", e).alias("code"), (e - F.coalesce(F.get("ends", j - 1), F.lit(-1))).alias("n"))))
    bucket = lambda r: F.floor(r["code"] / 2).cast("int")
    # a run of rejected tokens right behind one of the same bucket is taken off there
    value = lambda r, j: F.when(r["code"] % 2 == 1, -r["n"]).when(
        F.get("runs", j + 1)["code"] == r["code"] + 1, r["n"] - F.get("runs", j + 1)["n"]).otherwise(r["n"])
    x = F.transform("runs", lambda r, j: F.struct(
        bucket(r).alias("bucket"),
        F.when((r["code"] % 2 == 1) & (j > 0) & (F.get("runs", j - 1)["code"] == r["code"] - 1), 0)
         .otherwise(value(r, j)).cast("double").alias("value")))
    return computed_once(runs, [key], x=F.filter(x, lambda e: e["value"] != 0)).filter(F.size("x") > 0)


def fit_reward(pairs: DataFrame, key: str = "pair_id", bits: int = HASH_BITS, steps: int = STEPS,
               lr: float = LEARNING_RATE, l2: float = L2, tolerance: float = TOLERANCE) -> DataFrame:
    """M3: weights (bucket, w) of the pairwise model, those not zero."""
    if bits > MAX_BITS:
        raise ValueError(f"{bits} hash bits: the weights are broadcast, so at most {MAX_BITS}")
    spark = pairs.sparkSession
    feats = materialize(pair_features(pairs, key, bits))
    n = feats.count()
    w = [0.0] * (1 << bits)
    for _ in range(steps if n else 0):
        held = F.broadcast(spark.createDataFrame([(w,)], "w array<double>"))
        margin = F.aggregate("x", F.lit(0.0), lambda a, e: a + e["value"] * F.get("w", e["bucket"]))
        rows = feats.crossJoin(held).select("x", (F.lit(-1.0) / (F.lit(1.0) + F.exp(margin))).alias("g"))
        grad = rows.select("g", F.inline("x")).groupBy("bucket").agg(F.sum(F.col("value") * F.col("g")).alias("d"))
        change = 0.0
        step = {r["bucket"]: r["d"] / n for r in grad.collect()}      # at most 2^bits rows
        for b, d in step.items():
            move = lr * (d + l2 * w[b])
            w[b] -= move
            change = max(change, abs(move))
        if change < tolerance:
            break
    return spark.createDataFrame([(i, x) for i, x in enumerate(w) if x], "bucket int, w double")


def score_texts(df: DataFrame, weights: DataFrame, key: list[str] | str, text: str, bits: int = HASH_BITS,
                name: str = "reward_score") -> DataFrame:
    """M4: linear score w . tf(text) per row (rows without known tokens score 0).

    ``key`` identifies a row; ``weights`` has at most 2^bits rows."""
    if bits > MAX_BITS:
        raise ValueError(f"{bits} hash bits: the weights are broadcast, so at most {MAX_BITS}")
    key = [key] if isinstance(key, str) else list(key)
    known = weights.groupBy("bucket").agg(F.sum("w").alias("w"))
    dense = df.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("bucket")).join(known, "bucket", "left") \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda e: e["w"]).alias("_w"))
    score = F.aggregate(token_buckets(text, bits), F.lit(0.0), lambda a, b: a + F.get("_w", b))
    # rows of one key share the sum of their scores; a number a row is shuffled, no tokens
    s = df.select(*key, text).crossJoin(F.broadcast(dense)).select(*key, score.alias(name)).groupBy(*key).agg(F.sum(name).alias(name))
    return df.join(s, key, "left").fillna(0.0, [name])


def kl_policy(df: DataFrame, beta: float, key: str = "position_id", move: str = "move",
              reward: str = "reward_score", p_ref: str = "p_ref") -> DataFrame:
    """M5: pi proportional to p_ref * exp(r / beta) within each position.

    Output per position: KL(pi || p_ref), expected reward under pi and under
    p_ref, and the policy's most likely move.  Windows are per position, whose
    rows are its few candidate moves.
    """
    w = Window.partitionBy(key)
    x = df.withColumn("_w", F.col(p_ref) * F.exp((F.col(reward) - F.max(reward).over(w)) / F.lit(beta)))
    x = x.withColumn("_pi", F.col("_w") / F.sum("_w").over(w))
    return x.groupBy(key).agg(
        F.round(F.sum(F.col("_pi") * F.ln(F.col("_pi") / F.col(p_ref))), 6).alias("kl"),
        F.round(F.sum(F.col("_pi") * F.col(reward)), 6).alias("mean_reward"),
        F.round(F.sum(F.col(p_ref) * F.col(reward)), 6).alias("ref_reward"),
        F.min_by(move, F.struct((-F.col("_pi")).alias("p"), F.col(move).alias("m"))).alias("policy_best"))
