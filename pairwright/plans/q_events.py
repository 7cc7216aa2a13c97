"""Queries on the events binding: scoring, ranks, agreement, progress, logs.

position = ``user_id``; move = ``event_type``; a move's score =
``round(avg(value), 6)``; the expert's move = type of the user's last event
by ``event_id``; the student's suggestions = the user's event types in
first-seen order.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import report as A
from ..operators.reward import kl_policy
from .bindings import table
from .registry import register

BETA = 10.0
CATEGORIES = ["tactical", "positional", "endgame"]

_SQL = """
WITH sc AS (
  SELECT user_id, event_type AS move, round(avg(value), 6) AS reward_score,
         min(event_id) AS first_seen, count(*) AS n
  FROM events GROUP BY user_id, event_type
),
ex AS (SELECT user_id, arg_max(event_type, event_id) AS expert FROM events GROUP BY user_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reward_score DESC, move) AS rank FROM sc),
er AS (
  SELECT ex.user_id, ex.expert, b.move AS best, r.rank AS expert_rank, b.move = ex.expert AS agrees
  FROM ex JOIN rk r ON r.user_id = ex.user_id AND r.move = ex.expert
          JOIN rk b ON b.user_id = ex.user_id AND b.rank = 1
)"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def scored(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(F.col("user_id").alias("position_id"), F.col("event_type").alias("move")).agg(
        F.round(F.avg("value"), 6).alias("reward_score"), F.min("event_id").alias("seq"),
        F.count(F.lit(1)).alias("n"))


def expert(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(F.col("user_id").alias("position_id")).agg(F.max_by("event_type", "event_id").alias("move"))


def _ranks(spark, sf_dir):
    ranked = R.rank_moves(scored(spark, sf_dir))
    return ranked, R.expert_rank(ranked, expert(spark, sf_dir))


@register("move_ranks", f"""{_SQL}
SELECT user_id, move, reward_score, CAST(rank AS BIGINT) AS rank FROM rk""")
def move_ranks(spark, sf_dir):
    """W1 + O1: every move of every position ranked by score."""
    ranked, _ = _ranks(spark, sf_dir)
    return ranked.select(F.col("position_id").alias("user_id"), "move", "reward_score", "rank")


@register("expert_ranks", f"""{_SQL}
SELECT user_id, expert, best, CAST(expert_rank AS BIGINT) AS expert_rank, agrees FROM er""")
def expert_ranks(spark, sf_dir):
    """W2 + W3 + L12: rank of the expert's move, best move, agreement."""
    _, er = _ranks(spark, sf_dir)
    return er.select(F.col("position_id").alias("user_id"), "expert", "best", "expert_rank", "agrees")


@register("eval_summary", f"""{_SQL}
SELECT count(*)::BIGINT AS total_positions, count_if(agrees)::BIGINT AS agreements,
       round(avg(CAST(agrees AS INTEGER)) * 100, 6) AS agreement_pct, round(avg(expert_rank), 6) AS mean_rank
FROM er""")
def eval_summary(spark, sf_dir):
    """A2 + A3 + A5: agreement count and rate, mean expert rank."""
    _, er = _ranks(spark, sf_dir)
    return A.evaluation_summary(er)


@register("rank_histogram", f"""{_SQL}
SELECT CAST(expert_rank AS BIGINT) AS rank, count(*)::BIGINT AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM er GROUP BY expert_rank""")
def rank_histogram(spark, sf_dir):
    """A4 + W5 + O2: positions per expert rank with percentage."""
    _, er = _ranks(spark, sf_dir)
    return A.rank_histogram(er)


@register("position_report", f"""{_SQL},
sug AS (
  SELECT user_id, string_agg(move, ',' ORDER BY first_seen) AS suggestions,
         string_agg(move || ':' || CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranking,
         count(*)::BIGINT AS n_moves
  FROM rk GROUP BY user_id
)
SELECT er.user_id, expert, best, CAST(expert_rank AS BIGINT) AS expert_rank, agrees,
       suggestions, ranking, n_moves
FROM er JOIN sug USING (user_id)""")
def position_report(spark, sf_dir):
    """A6 + A16: per-position report with suggestions and ranking (the full record is
    query ``evaluation_records``)."""
    ranked, er = _ranks(spark, sf_dir)
    sug = R.distinct_suggestions(scored(spark, sf_dir), order="seq") \
        .select("position_id", F.array_join("suggestions", ",").alias("suggestions"))
    ranking = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "move"))),
                                       lambda s: F.concat(s["move"], F.lit(":"), s["rank"].cast("string"))), ",")
    rk = ranked.groupBy("position_id").agg(ranking.alias("ranking"),
                                           F.count(F.lit(1)).cast("bigint").alias("n_moves"))
    out = er.join(sug, "position_id").join(rk, "position_id")
    return out.select(F.col("position_id").alias("user_id"), "expert", "best", "expert_rank", "agrees",
                      "suggestions", "ranking", "n_moves")


@register("category_summary", f"""{_SQL},
c AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'tactical' WHEN 1 THEN 'positional' ELSE 'endgame' END AS category FROM er)
SELECT coalesce(category, 'ALL') AS category, count(*)::BIGINT AS total_positions,
       count_if(agrees)::BIGINT AS agreements, round(avg(CAST(agrees AS INTEGER)) * 100, 6) AS agreement_pct,
       round(avg(expert_rank), 6) AS mean_rank
FROM c GROUP BY ROLLUP (category)""")
def category_summary(spark, sf_dir):
    """Summary per position category with a total line (rollup)."""
    _, er = _ranks(spark, sf_dir)
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("position_id") % 3).cast("int") + 1)
    return A.category_summary(er.withColumn("category", cat))


@register("pair_metrics", f"""{_SQL}
SELECT count(*)::BIGINT AS n_pairs, round(avg(CAST(c.reward_score > r.reward_score AS DOUBLE)), 6) AS accuracy,
       round(avg(ln(1 + exp(-(c.reward_score - r.reward_score)))), 6) AS loss
FROM ex JOIN sc c ON c.user_id = ex.user_id AND c.move = ex.expert
        JOIN sc r ON r.user_id = ex.user_id AND r.move <> ex.expert""")
def pair_metrics(spark, sf_dir):
    """Pairwise accuracy and loss -- chosen = expert move, rejected = each other move."""
    s = scored(spark, sf_dir)
    e = expert(spark, sf_dir)
    c = s.join(e, ["position_id", "move"]).select("position_id", F.col("reward_score").alias("s_chosen"))
    r = s.join(e.withColumnRenamed("move", "expert"), "position_id") \
         .filter(F.col("move") != F.col("expert")).select("position_id", F.col("reward_score").alias("s_rejected"))
    return A.pair_metrics(c.join(r, "position_id"))


@register("kl_policy", f"""
WITH sc AS (
  SELECT user_id, event_type AS move, round(avg(value), 6) AS r, count(*) AS n
  FROM events GROUP BY user_id, event_type
),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p_ref,
             max(r) OVER (PARTITION BY user_id) AS rmax FROM sc),
w AS (SELECT *, p_ref * exp((r - rmax) / {BETA}) AS w FROM p),
pi AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS pi FROM w)
SELECT user_id, round(sum(pi * ln(pi / p_ref)), 6) AS kl, round(sum(pi * r), 6) AS mean_reward,
       arg_min(move, (-pi, move)) AS policy_best
FROM pi GROUP BY user_id""")
def kl_policy_q(spark, sf_dir):
    """M5: KL-regularised improvement pi ~ p_ref * exp(r / beta) per position."""
    s = scored(spark, sf_dir)
    tot = Window.partitionBy("position_id")
    s = s.withColumn("p_ref", F.col("n") / F.sum("n").over(tot))
    out = kl_policy(s, BETA, key="position_id", reward="reward_score")
    # ref_reward is left out of the check: sum(p_ref * r) often lies exactly on
    # a rounding half-way point, where float summation order decides the digit
    return out.select(F.col("position_id").alias("user_id"), "kl", "mean_reward", "policy_best")


@register("ensemble_move", """
SELECT user_id, arg_min(event_type, (-cnt, event_type)) AS move, max(cnt)::BIGINT AS votes FROM (
  SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY user_id, event_type)
GROUP BY user_id""")
def ensemble_move(spark, sf_dir):
    """Majority move per position among its votes (events)."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("position_id"), F.col("event_type").alias("move"))
    return A.ensemble_move(e).withColumnRenamed("position_id", "user_id")


@register("run_progress", """
SELECT count(*)::BIGINT AS samples, round(epoch(max(ts)) - epoch(min(ts)), 6) AS seconds,
       round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS samples_per_sec,
       round(greatest(0, 750000 - count(*)) / (count(*) / (epoch(max(ts)) - epoch(min(ts)))) / 3600, 6) AS remaining_hours
FROM events""")
def run_progress(spark, sf_dir):
    """A7 (D23): throughput and time left to the 750 000 target."""
    return A.progress(_events(spark, sf_dir))


@register("worker_progress", """
SELECT user_id % 4 AS worker_id, count(*)::BIGINT AS games, count_if(event_type = 'purchase')::BIGINT AS samples
FROM events GROUP BY 1""")
def worker_progress(spark, sf_dir):
    """Per-worker games and samples (worker = user_id % 4, sample = purchase)."""
    e = _events(spark, sf_dir).withColumn("worker_id", F.col("user_id") % A.WORKERS)
    return A.worker_progress(e, "worker_id", F.col("event_type") == "purchase")


@register("snapshot_numbers", f"""
SELECT event_id, row_number() OVER (ORDER BY event_id) AS n,
       CAST(ceil(row_number() OVER (ORDER BY event_id) / {A.SNAPSHOT_INTERVAL}) AS BIGINT) AS snapshot
FROM events""")
def snapshot_numbers(spark, sf_dir):
    """Running sample number and snapshot number every 10 000 samples."""
    return A.snapshot_no(_events(spark, sf_dir).select("event_id"), ["event_id"])


@register("snapshot_retention", f"""
SELECT worker_id, version, rows FROM (
  SELECT worker_id, version, rows, row_number() OVER (PARTITION BY worker_id ORDER BY version DESC) AS r FROM (
    SELECT user_id % 4 AS worker_id, CAST(dayofmonth(ts) AS BIGINT) AS version, count(*)::BIGINT AS rows
    FROM events GROUP BY 1, 2))
WHERE r <= {A.KEEP_SNAPSHOTS}""")
def snapshot_retention(spark, sf_dir):
    """S9 (D13): keep the newest 3 numeric versions of each worker's snapshots."""
    e = _events(spark, sf_dir)
    manifest = e.groupBy((F.col("user_id") % A.WORKERS).alias("worker_id"),
                         F.dayofmonth("ts").cast("bigint").alias("version")) \
                .agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
    return A.keep_last_n(manifest, "worker_id", "version")


def _hourly(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("step")).agg(F.avg("value").alias("loss"))


_HOURLY = "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, avg(value) AS loss FROM events GROUP BY 1"


@register("learning_curve", f"""
SELECT step, round(loss, 6) AS loss,
       round(loss - lag(loss) OVER (ORDER BY step), 6) AS delta,
       round(avg(loss) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_mean,
       round(min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far
FROM ({_HOURLY})""")
def learning_curve(spark, sf_dir):
    """Loss change since the previous evaluation, 5-step moving mean, best so far."""
    return A.learning_curve(_hourly(spark, sf_dir))


@register("best_checkpoint", f"""
SELECT arg_min(step, (loss, step)) AS best_step, round(min(loss), 6) AS best_loss FROM ({_HOURLY})""")
def best_checkpoint(spark, sf_dir):
    """Step of the lowest loss."""
    return A.best_checkpoint(_hourly(spark, sf_dir))


@register("window_progress", """
SELECT strftime(time_bucket(INTERVAL 30 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*)::BIGINT AS n
FROM events GROUP BY 1""")
def window_progress(spark, sf_dir):
    """T6 (table form): samples per 30-second window."""
    e = _events(spark, sf_dir)
    return e.groupBy(F.window("ts", "30 seconds").start.alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("n")) \
            .select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")
