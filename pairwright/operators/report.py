"""Reports: agreement, ranks, progress, splits, training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_row_number

# Fixed values of the reference's run: 750 000 samples wanted, a snapshot
# every 10 000 samples, the last 3 snapshots kept, 4 workers.
TARGET_SAMPLES = 750_000
SNAPSHOT_INTERVAL = 10_000
KEEP_SNAPSHOTS = 3
WORKERS = 4


def r6(c):
    return F.round(c, 6)


def evaluation_summary(ranks: DataFrame) -> DataFrame:
    """A2 + A3 + A5: positions, agreements, agreement %, mean expert rank."""
    return ranks.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_positions"),
        F.count_if("agrees").cast("bigint").alias("agreements"),
        r6(F.avg(F.col("agrees").cast("int")) * 100).alias("agreement_pct"),
        r6(F.avg("expert_rank")).alias("mean_rank"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """A4 + W5 + O2: positions per expert rank with share of total, ordered."""
    counts = ranks.groupBy("expert_rank").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    # one row per distinct rank: the global window runs over a handful of rows
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(F.col("expert_rank").alias("rank"), "n", r6(F.col("n") * 100.0 / total).alias("pct")) \
                 .orderBy("rank")


def match_summary(games: DataFrame, white: str = "white", black: str = "black",
                  result: str = "result") -> DataFrame:
    """Per (player, opponent): games, wins, draws, losses, score."""
    pts_w = F.when(F.col(result) == "1-0", 1.0).when(F.col(result) == "0-1", 0.0).otherwise(0.5)
    pts_b = F.when(F.col(result) == "0-1", 1.0).when(F.col(result) == "1-0", 0.0).otherwise(0.5)
    sides = games.select(F.col(white).alias("player"), F.col(black).alias("opponent"), pts_w.alias("pts")) \
        .unionByName(games.select(F.col(black).alias("player"), F.col(white).alias("opponent"),
                                  pts_b.alias("pts")))
    return sides.groupBy("player", "opponent").agg(
        F.count(F.lit(1)).cast("bigint").alias("games"),
        F.count_if(F.col("pts") == 1.0).cast("bigint").alias("wins"),
        F.count_if(F.col("pts") == 0.5).cast("bigint").alias("draws"),
        F.count_if(F.col("pts") == 0.0).cast("bigint").alias("losses"),
        r6(F.avg("pts")).alias("score"))


def progress(df: DataFrame, ts: str = "ts", target: int = TARGET_SAMPLES) -> DataFrame:
    """A7 (D23): samples of this run, elapsed seconds, rate, remaining hours."""
    t = F.col(ts).cast("timestamp")
    secs = F.unix_micros(F.max(t)) / 1e6 - F.unix_micros(F.min(t)) / 1e6
    out = df.agg(F.count(F.lit(1)).cast("bigint").alias("samples"), secs.alias("seconds"))
    rate = F.try_divide(F.col("samples"), F.col("seconds"))
    remaining = F.greatest(F.lit(0), F.lit(target) - F.col("samples"))
    return out.select("samples", r6(F.col("seconds")).alias("seconds"), r6(rate).alias("samples_per_sec"),
                      r6(F.try_divide(remaining, rate) / 3600).alias("remaining_hours"))


def worker_progress(df: DataFrame, worker: str = "worker_id", sample_pred=None) -> DataFrame:
    """Per worker: games processed, samples found."""
    pred = sample_pred if sample_pred is not None else F.lit(True)
    return df.groupBy(worker).agg(F.count(F.lit(1)).cast("bigint").alias("games"),
                                  F.count_if(pred).cast("bigint").alias("samples"))


def snapshot_no(df: DataFrame, order, interval: int = SNAPSHOT_INTERVAL) -> DataFrame:
    """Running sample number ``n`` and snapshot number ceil(n / interval)."""
    out = global_row_number(df, order, "n")
    return out.withColumn("snapshot", F.ceil(F.col("n") / F.lit(interval)).cast("bigint"))


def keep_last_n(manifest: DataFrame, group: str, version: str = "version",
                n: int = KEEP_SNAPSHOTS) -> DataFrame:
    """S9 (D13): newest ``n`` versions per group by *numeric* version."""
    w = Window.partitionBy(group).orderBy(F.col(version).desc())
    return manifest.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def split_sizes(df: DataFrame, batch: int = 24, epochs: int = 1) -> DataFrame:
    """Rows per split and optimizer steps (ceil(n / batch) * epochs)."""
    return df.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n")) \
             .withColumn("steps", (F.ceil(F.col("n") / F.lit(batch)) * epochs).cast("bigint"))


def learning_curve(log: DataFrame, step: str = "step", loss: str = "loss", span: int = 5) -> DataFrame:
    """W4 + A12: change since the previous evaluation, moving mean, best so far.

    The log has one row per evaluation (thousands at most), so the ordered
    window over the whole log is small by construction.
    """
    w = Window.orderBy(step)
    return log.select(
        step, r6(F.col(loss)).alias(loss),
        r6(F.col(loss) - F.lag(loss).over(w)).alias("delta"),
        r6(F.avg(loss).over(w.rowsBetween(-(span - 1), 0))).alias("moving_mean"),
        r6(F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("best_so_far"))


def best_checkpoint(log: DataFrame, step: str = "step", loss: str = "loss") -> DataFrame:
    """The step of lowest loss (ties: earliest step)."""
    return log.filter(F.col(loss).isNotNull()).agg(
        F.min_by(step, F.struct(loss, step)).alias("best_step"), r6(F.min(loss)).alias("best_loss"))


def ensemble_move(votes: DataFrame, key: str = "position_id", move: str = "move") -> DataFrame:
    """Majority move per position; ties -> smallest move text."""
    c = votes.groupBy(key, move).agg(F.count(F.lit(1)).alias("votes"))
    return c.groupBy(key).agg(
        F.min_by(move, F.struct((-F.col("votes")).alias("v"), F.col(move).alias("m"))).alias("move"),
        F.max("votes").cast("bigint").alias("votes"))


def category_summary(ranks: DataFrame, category: str = "category") -> DataFrame:
    """A5 per category plus a total line (rollup; total has category 'ALL')."""
    out = ranks.rollup(category).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_positions"),
        F.count_if("agrees").cast("bigint").alias("agreements"),
        r6(F.avg(F.col("agrees").cast("int")) * 100).alias("agreement_pct"),
        r6(F.avg("expert_rank")).alias("mean_rank"))
    return out.withColumn(category, F.coalesce(F.col(category), F.lit("ALL")))


def pair_metrics(pairs: DataFrame, chosen: str = "s_chosen", rejected: str = "s_rejected") -> DataFrame:
    """Pairwise accuracy and logistic loss of scores on held-out pairs."""
    m = F.col(chosen) - F.col(rejected)
    return pairs.agg(F.count(F.lit(1)).cast("bigint").alias("n_pairs"),
                     r6(F.avg((m > 0).cast("double"))).alias("accuracy"),
                     r6(F.avg(F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))))).alias("loss"))
