"""Queries that write and read again: JSONL edges, staged tables, snapshots, archives and streams
(S1-S8, S10-S13, T1-T5, T7, T8), and operators that need rows of their own kind (L6, O4, P13, U4).

Everything written lies in the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_sequence
from ..operators import quality as Q
from ..operators.pairs import dedup_pairs, extract_moves
from ..operators.sampling import sample_position
from ..session import ensure_checkpoint_dir
from ..sources import tables as S
from ..sources.games import PROBE_POSITIONS, probe_positions, read_games, stream_game_records, write_archive
from ..streaming import streams as T
from . import bindings as B
from .games import SQL_GAMES, render_games, synthetic_games
from .q_prep import _CONV_SQL, _conversation_pairs
from .registry import SEQS, H, register

W = f"WITH {SQL_GAMES.strip()}"
STREAM_FILES = 4          # of an archive, at least
FILE_GAMES = 2_000_000    # of an archive's file, about: a task writes it
SNAPSHOT = 64             # rows of a streamed snapshot
LEAST, MOST = 20, 40       # plies of the user's own rules


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io/{name}-{uuid.uuid4().hex}"


def _records(spark, sf_dir) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return render_games(orders)


def _files(spark, sf_dir) -> int:
    """Files that all games fill."""
    return -(-B.table(spark, sf_dir, "orders").count() // FILE_GAMES)


def _archive(spark, sf_dir) -> str:
    """The rendered games as an archive of several files, plain ones and Zstandard ones of several
    frames; the records begin with one of three tags."""
    path = _folder(spark, "archive")
    k, line = F.col("game_id"), r"(\[[^\n]*)\n"
    swapped = F.when(k % 3 == 1, F.regexp_replace("pgn", f"^{line}{line}", "$2\n$1\n")) \
               .when(k % 3 == 2, F.regexp_replace("pgn", f"^{line}{line}{line}", "$3\n$1\n$2\n")).otherwise(F.col("pgn"))
    recs = _records(spark, sf_dir).select("game_id", swapped.alias("pgn"))
    half = -(-max(STREAM_FILES, _files(spark, sf_dir)) // 2)
    recs.filter(k % 2 == 0).repartition(half).select("pgn").write.text(path)
    write_archive(recs.filter(k % 2 == 1).repartition(half), path, frame_records=500)
    return path


_TEXTS = """SELECT array_to_string(moves, ' ') AS text, count(*)::BIGINT AS n FROM gq WHERE reason IS NULL GROUP BY 1"""


def _per_text(df: DataFrame) -> DataFrame:
    return df.groupBy("text").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("archive_games", f"{W}\n{_TEXTS}")
def archive_games(spark, sf_dir):
    """An archive written to files and scanned again; kept games by text."""
    kept = Q.keep_quality(read_games(spark, _archive(spark, sf_dir)))
    return _per_text(kept.select(to_sequence("moves").alias("text")))


@register("stream_games", f"{W}\n{_TEXTS}")
def stream_games(spark, sf_dir):
    """S2 + T1 + T2 + T3: the archive as a stream of files, kept games written as JSON lines."""
    out, ck = _folder(spark, "sft"), _folder(spark, "progress")
    T.stream_sft(spark, _archive(spark, sf_dir), out, ck, max_files=1).awaitTermination()
    return _per_text(S.read_sft(spark, out))


@register("stream_capped", f"""{W}
SELECT least(count(*), 50)::BIGINT AS first_run, count(*)::BIGINT AS second_run, count(DISTINCT k)::BIGINT AS games
FROM gq WHERE reason IS NULL""")
def stream_capped(spark, sf_dir):
    """T4: a run that stops at 50 games, then one on the same checkpoint with no bound in reach."""
    src, out, ck = _archive(spark, sf_dir), _folder(spark, "capped"), _folder(spark, "progress")
    games = T.sft_frame(stream_game_records(spark, src, max_files=1))
    T.wait_until(T.stream_until(games, 50, out, ck))
    first = T.committed_rows(spark, out)
    T.wait_until(T.stream_until(games, 1 << 40, out, ck))
    rows = spark.read.parquet(out)
    return rows.agg(F.lit(first).cast("bigint").alias("first_run"), F.count(F.lit(1)).cast("bigint").alias("second_run"),
                    F.countDistinct("game_id").cast("bigint").alias("games"))


@register("sft_round_trip", f"{W}\n{_TEXTS}")
def sft_round_trip(spark, sf_dir):
    """S3 + S5: kept games to JSON lines and back."""
    path = _folder(spark, "sft")
    S.write_sft(Q.keep_quality(synthetic_games(spark, sf_dir)).select(to_sequence("moves").alias("text")), path)
    return _per_text(S.read_sft(spark, path))


@register("pairs_round_trip", f"""{_CONV_SQL}
SELECT prompt, chosen, rejected FROM pairs""")
def pairs_round_trip(spark, sf_dir):
    """S4 + S6: preference pairs to JSON lines and back."""
    path = _folder(spark, "pairs")
    S.write_pairs(_conversation_pairs(spark, sf_dir), path)
    return S.read_pairs(spark, path)


@register("stream_distinct", f"""{W}
SELECT DISTINCT array_to_string(moves, ' ') AS text FROM gq WHERE reason IS NULL""")
def stream_distinct(spark, sf_dir):
    """Kept games by their moves, each line once, over batches that repeat them; two runs on one checkpoint."""
    src, out, ck = _archive(spark, sf_dir), _folder(spark, "distinct"), _folder(spark, "progress")
    games = T.sft_frame(stream_game_records(spark, src, max_files=1))
    T.stream_distinct(games, out, ck, key="text").awaitTermination()
    _records(spark, sf_dir).repartition(max(1, _files(spark, sf_dir))).select("pgn").write.mode("append").text(src)     # all games once more
    T.stream_distinct(games, out, ck, key="text").awaitTermination()
    return spark.read.parquet(out).select("text")


@register("stream_snapshots", f"""{W},
n AS (SELECT row_number() OVER (ORDER BY game_id) AS r FROM gq WHERE reason IS NULL)
SELECT CAST(ceil(r / {SNAPSHOT}) AS BIGINT) AS snapshot, count(*)::BIGINT AS rows, count(*) < {SNAPSHOT} AS partial FROM n GROUP BY ALL""")
def stream_snapshots(spark, sf_dir):
    """T5 + T8: rows of every numbered snapshot of a stream, the last one partial."""
    src, out, ck = _archive(spark, sf_dir), _folder(spark, "snapshots"), _folder(spark, "progress")
    games = T.sft_frame(stream_game_records(spark, src, max_files=2))
    T.stream_snapshots(games, out, ck, interval=SNAPSHOT).awaitTermination()
    return T.snapshot_sizes(spark, out, SNAPSHOT)


@register("stage_round_trip", """SELECT doc_id, lang, n_chars FROM documents""")
def stage_round_trip(spark, sf_dir):
    """A stage stored by language, every folder read again by its language."""
    path = _folder(spark, "stage")
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    S.write_stage(docs, path, by=["lang"])
    return spark.read.parquet(path).select("doc_id", "lang", "n_chars")


@register("snapshot_newest", f"""{_CONV_SQL}
SELECT prompt, chosen, rejected FROM pairs""")
def snapshot_newest(spark, sf_dir):
    """S8 + S10: a quarter of the pairs as snapshot 9, all as snapshot 10; the newest by number comes back."""
    path = _folder(spark, "snapshots")
    pairs = _conversation_pairs(spark, sf_dir)
    S.write_snapshot(pairs.filter("turn % 4 = 0").select("prompt", "chosen", "rejected"), path, 9)
    S.write_snapshot(pairs.select("prompt", "chosen", "rejected"), path, 10)
    return S.latest_snapshot(spark, path)


@register("training_log", """
SELECT event_type AS run, CAST(step AS BIGINT) AS step, round(loss, 6) AS loss, round(min(loss) OVER (PARTITION BY event_type), 6) AS best_metric FROM (
  SELECT event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS step, round(avg(value), 4) AS loss FROM events GROUP BY ALL)""")
def training_log(spark, sf_dir):
    """One nested log a run (event type; a step a day), written as JSON objects and read as one row an event."""
    path = _folder(spark, "log")
    steps = B.table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.to_date("ts")).cast("bigint").alias("step")) \
             .agg(F.round(F.avg("value"), 4).alias("loss"))
    # a run's log is one object, as the trainer writes it: days, not events
    logs = steps.groupBy("event_type").agg(F.min("loss").alias("best_metric"), F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("log_history"))
    logs.withColumn("best_model_checkpoint", F.col("event_type")).drop("event_type") \
        .write.option("maxRecordsPerFile", 1).json(path)
    log = S.read_training_log(spark, path)
    return log.select(F.col("best_model_checkpoint").alias("run"), "step", "loss", "best_metric")


@register("training_metrics", """
SELECT round(sum(value) / 1000, 6) AS train_runtime, round(avg(value), 6) AS train_loss, count(*)::DOUBLE AS total_flos FROM events""")
def training_metrics(spark, sf_dir):
    """Totals of the events as a metrics file, written and read again."""
    path = _folder(spark, "metrics")
    m = B.table(spark, sf_dir, "events").agg((F.sum("value") / 1000).alias("train_runtime"), F.avg("value").alias("train_loss"),
                                             F.count(F.lit(1)).cast("double").alias("total_flos")).first()
    S.write_metrics(spark, m.asDict(), path)
    out = S.read_metrics(spark, path)
    return out.select(F.round("train_runtime", 6).alias("train_runtime"), F.round("train_loss", 6).alias("train_loss"), "total_flos")


_PROBES = ", ".join("('{}', '{}')".format(name.replace("'", "''"), moves) for name, moves in PROBE_POSITIONS)


@register("probe_games", f"""{W},
probes AS (SELECT name, trim(regexp_replace(moves, '[0-9]+\\. ?', '', 'g')) AS line FROM (VALUES {_PROBES}) t(name, moves))
SELECT name, count(game_id)::BIGINT AS n, coalesce(sum((game_id IS NOT NULL AND reason IS NULL)::INT), 0)::BIGINT AS kept
FROM probes LEFT JOIN gq ON starts_with(array_to_string(moves, ' ') || ' ', line || ' ') GROUP BY name""")
def probe_games(spark, sf_dir):
    """For each probe position, the games that begin with it, and how many of them are kept."""
    probes = probe_positions(spark).select("name", F.trim(F.regexp_replace("moves", r"[0-9]+\. ?", "")).alias("line"))
    lengths = sorted({len(m.split()) - sum(t.endswith(".") for t in m.split()) for _, m in PROBE_POSITIONS})
    games = Q.quality(synthetic_games(spark, sf_dir), Q.default_rules()).select(
        F.col("reason").isNull().cast("int").alias("ok"), F.explode(F.array(*[
            F.when(F.size("moves") >= n, F.array_join(F.slice("moves", 1, n), " ")) for n in lengths])).alias("line"))
    met = games.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("kept"))
    return probes.join(met, "line", "left").select("name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                                                   F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))


@register("late_positions", f"""WITH {SEQS.strip()}
SELECT doc_id, CAST(10 + ({H(B.SEED, 'doc_id')} % (n_plies - 1 - 10 + 1)) AS BIGINT) AS move_index
FROM seqs_n WHERE n_plies >= 11""")
def late_positions(spark, sf_dir):
    """The older position rule, 10 to the last ply but one."""
    p = sample_position(B.doc_sequences(spark, sf_dir), "doc_id", B.SEED, mode="late")
    return p.select("doc_id", F.col("move_index").cast("bigint").alias("move_index"))


@register("extracted_moves", f"""{W}
SELECT game_id, array_to_string(moves, ' ') AS hits FROM gq""")
def extracted_moves(spark, sf_dir):
    """Every move found in a game's text by the pattern; rendered moves are all found."""
    g = synthetic_games(spark, sf_dir)
    return g.select("game_id", F.array_join(extract_moves(to_sequence("moves")), " ").alias("hits"))


@register("distinct_pairs", f"""{_CONV_SQL}
SELECT DISTINCT prompt, chosen, rejected FROM pairs""")
def distinct_pairs(spark, sf_dir):
    """Pairs of an interrupted run and of its repetition, each once."""
    p = _conversation_pairs(spark, sf_dir).select("prompt", "chosen", "rejected")
    return dedup_pairs(p.union(p))


@register("own_rules", f"""{W}
SELECT coalesce(CASE WHEN n_plies < {LEAST} THEN 'short' WHEN n_plies > {MOST} THEN 'long'
                     WHEN result = '1/2-1/2' THEN 'draw' END, 'kept') AS reason, count(*)::BIGINT AS n FROM gq GROUP BY 1""")
def own_rules(spark, sf_dir):
    """U4 + F7: a user's own rules, with a reason for each rejection."""
    g = synthetic_games(spark, sf_dir)
    rules = {"short": F.col("n_plies") < LEAST, "long": ~Q.ply_range(0, MOST),
             "draw": F.element_at("headers", F.lit("Result")) == "1/2-1/2"}
    return Q.quality_report(Q.quality(g, rules)).select("reason", F.col("n").cast("bigint").alias("n"))
