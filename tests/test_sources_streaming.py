"""JSONL edges, snapshots and retention, training log, metrics, stream = batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from pairwright.operators.report import best_checkpoint, learning_curve
from pairwright.sources import tables as S
from pairwright.sources.games import read_game_records
from pairwright.streaming import streams as T


def test_jsonl_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("e4", "e5", "c5")], "prompt string, chosen string, rejected string")
    S.write_pairs(pairs, str(tmp_path / "p"))
    assert S.read_pairs(spark, str(tmp_path / "p")).collect()[0].asDict() == {"prompt": "e4", "chosen": "e5", "rejected": "c5"}
    sft = spark.createDataFrame([("e4 e5",), ("",)], "text string")
    S.write_sft(sft, str(tmp_path / "s"))
    assert sorted(r.text for r in S.read_sft(spark, str(tmp_path / "s")).collect()) == ["", "e4 e5"]


def test_snapshots_numeric_latest_and_retention(spark, tmp_path):
    base = str(tmp_path / "snap")
    for v in (1, 2, 9, 10):
        S.write_snapshot(spark.createDataFrame([(f"p{v}", "a", "b")], S.PAIR_SCHEMA), base, v)
    assert S.snapshot_versions(spark, base) == [1, 2, 9, 10]
    assert S.latest_snapshot(spark, base).first().prompt == "p10"   # numeric, not lexical
    assert S.retain_snapshots(spark, base, 3) == [1]
    assert S.snapshot_versions(spark, base) == [2, 9, 10]
    assert S.latest_snapshot(spark, str(tmp_path / "none")).count() == 0
    # a torn snapshot is passed over; without a whole one the table is empty
    (tmp_path / "snap" / "version=11").mkdir()
    (tmp_path / "snap" / "version=11" / "part-0.parquet").write_bytes(b"torn")
    assert S.latest_snapshot(spark, base).first().prompt == "p10"
    (tmp_path / "torn" / "version=1").mkdir(parents=True)
    (tmp_path / "torn" / "version=1" / "part-0.parquet").write_bytes(b"torn")
    assert S.latest_snapshot(spark, str(tmp_path / "torn")).collect() == []


def test_training_log(spark, tmp_path):
    # a log shaped like the trainer's: a loss every 250 steps, an evaluation every 2500
    hist = [{"epoch": s / 18750, "grad_norm": 1.0, "learning_rate": 1e-5, "loss": 0.3, "step": s}
            for s in range(250, 37501, 250)]
    evals = {s: 0.30 - 0.003 * (s // 2500) for s in range(2500, 37501, 2500)}
    evals[37500] = evals[35000] + 0.0003
    hist += [{"epoch": s / 18750, "eval_loss": v, "eval_accuracy": 0.88, "step": s} for s, v in evals.items()]
    doc = {"best_global_step": 35000, "best_metric": evals[35000], "epoch": 2.0, "global_step": 37500,
           "max_steps": 37500, "log_history": hist}
    (tmp_path / "state.json").write_text(json.dumps(doc, indent=1))
    log = S.read_training_log(spark, str(tmp_path / "state.json"))
    assert log.count() == 165
    assert log.filter(F.col("loss").isNotNull()).count() == 150
    ev = log.filter(F.col("eval_loss").isNotNull()).select("step", F.col("eval_loss").alias("loss"))
    assert ev.count() == 15
    assert best_checkpoint(ev).first().best_step == 35000
    curve = learning_curve(ev).orderBy("step").collect()
    assert curve[0].delta is None and curve[-1].best_so_far == round(evals[35000], 6)


def test_metrics_round_trip(spark, tmp_path):
    m = {"train_runtime": 10.0, "train_samples_per_second": 85.5, "train_steps_per_second": 3.5,
         "total_flos": 1.0, "train_loss": 0.27, "epoch": 2.0}
    S.write_metrics(spark, m, str(tmp_path / "m"))
    assert S.read_metrics(spark, str(tmp_path / "m")).first().train_samples_per_second == 85.5


def test_stream_equals_batch_and_resume(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    text = open(os.path.join(FIXTURES, "games.pgn")).read()
    records = text.split("\n\n[Event ")
    # three files, every record of the fixture in exactly one of them
    parts = [records[0:4], records[4:8], records[8:]]
    for i, part in enumerate(parts):
        body = "\n\n[Event ".join(part) if i == 0 else "[Event " + "\n\n[Event ".join(part)
        (src / f"g{i}.pgn").write_text(body)
    batch = T.sft_frame(read_game_records(spark, str(src)))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = T.stream_sft(spark, str(src), out, ck, max_files=1)
    q.awaitTermination(120)
    got = spark.read.schema("game_id string, text string").json(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert len(q.recentProgress) >= 3  # one file per micro-batch
    assert T.stream_progress(spark, q).count() == len(q.recentProgress)
    # restart on the same checkpoint: nothing is written twice
    q2 = T.stream_sft(spark, str(src), out, ck, max_files=1)
    q2.awaitTermination(120)
    assert spark.read.schema("game_id string, text string").json(out).count() == batch.count()


def test_stream_until_and_snapshots(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    text = open(os.path.join(FIXTURES, "games.pgn")).read()
    (src / "a.pgn").write_text(text)
    (src / "b.pgn").write_text(text.replace('[Event "', '[Event "copy '))
    df = T.stream_dedup(T.sft_frame(T.stream_game_records(spark, str(src), 1)))
    out = str(tmp_path / "capped")
    for n, want in ((3, 3), (7, 7), (20, 10)):     # ten games in all: the target grows on one checkpoint
        reached = T.wait_until(T.stream_until(df, n, out, str(tmp_path / "ck1")))
        assert reached == (n < 10)
        assert T.committed_rows(spark, out) == want
        got = spark.read.parquet(out)
        assert got.count() == got.select("game_id").distinct().count() == want
    progress = T.batch_progress(spark, out).orderBy("batch_id").collect()
    assert [p.total for p in progress][-1] == 10 and sum(p.rows for p in progress) == 10
    with open(out + "_manifest/batch=0/part-bad.json", "w") as f:
        f.write("{torn")
    with pytest.raises(Exception):
        T.committed_rows(spark, out)                # never taken for an empty manifest
    snap = str(tmp_path / "snap")
    q = T.stream_snapshots(df, snap, str(tmp_path / "ck2"), interval=4)
    q.awaitTermination(120)
    s = spark.read.parquet(snap)
    assert sorted(r.n for r in s.collect()) == list(range(1, 11))
    assert s.agg(F.max("snapshot")).first()[0] == 3


def test_windowed_progress_stream_matches_batch(spark, tmp_path):
    from conftest import SF_SMALL
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts")
    src = str(tmp_path / "ev")
    events.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (T.windowed_progress(stream, "ts", "1 hour", "1000 days")
         .writeStream.outputMode("update").format("memory").queryName("winprog")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("winprog").groupBy("window").agg(F.max("n").alias("n"))
    batch = events.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted((r.window.start, r.n) for r in got.collect()) == sorted((r.window.start, r.n) for r in batch.collect())
