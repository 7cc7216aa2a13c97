"""Structured Streaming versions of the intake and collection loop.

The reference runs a producer thread, a bounded queue, a worker pool and a
collector that snapshots results.  Here the archive folder is a file source
(``maxFilesPerTrigger`` is the back-pressure), the work is the same DataFrame
plan as in batch, and the sinks are idempotent per micro-batch so a restart
from ``checkpointLocation`` neither loses nor repeats rows.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.barrier import computed_once
from ..functions.pgn import mainline, parse_headers
from ..functions.text import to_sequence
from ..operators.ordering import global_row_number
from ..operators.quality import default_rules, keep_quality
from ..operators.report import SNAPSHOT_INTERVAL
from ..operators.sampling import first_n
from ..sources.games import stream_game_records


def sft_frame(recs: DataFrame, min_elo: int = 2000) -> DataFrame:
    """T2 body (S2 -> P1..P4 -> F5): game_id, text -- identical in batch and stream."""
    games = computed_once(recs, ["game_id", "pgn"], headers=parse_headers("pgn"))
    games = computed_once(games, ["game_id", "headers"], moves=mainline("pgn"))
    kept = keep_quality(games, default_rules(min_elo))
    return kept.select("game_id", to_sequence("moves").alias("text"))


def stream_sft(spark: SparkSession, src: str, out: str, checkpoint: str, min_elo: int = 2000,
               max_files: int = 1, available_now: bool = True) -> StreamingQuery:
    """T1 + T2 + T3 + T8: archive folder -> SFT JSON lines, exactly once.

    The file sink commits each batch with the checkpoint, so a restarted run
    continues after the last committed batch.  ``availableNow`` processes what
    is there in bounded batches and stops after a final committed batch.
    """
    recs = stream_game_records(spark, src, max_files)
    w = (sft_frame(recs, min_elo).writeStream.format("json").outputMode("append")
         .option("path", out).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _manifest(spark: SparkSession, manifest: str) -> DataFrame | None:
    """The manifest's rows, or None before the first one; an unreadable one raises."""
    if not _exists(spark, manifest):
        return None
    return spark.read.schema("batch_id long, rows long, at timestamp").option("mode", "FAILFAST").json(f"{manifest}/batch=*")


def _manifest_total(spark: SparkSession, manifest: str, exclude_batch: int) -> int:
    m = _manifest(spark, manifest)
    return 0 if m is None else int(m.filter(F.col("batch_id") != exclude_batch).agg(F.sum("rows")).first()[0] or 0)


def _note(spark: SparkSession, manifest: str, batch_id: int, rows: int) -> None:
    spark.createDataFrame([(batch_id, rows)], "batch_id long, rows long").withColumn("at", F.current_timestamp()) \
         .write.mode("overwrite").json(f"{manifest}/batch={batch_id}")


class TargetReached(Exception):
    """Raised inside a micro-batch so that its offsets are not committed."""


def capped_writer(out: str, n: int, key: str):
    """T4: foreachBatch body that accepts ``n`` rows in total and then ends the query.

    Per batch it reads the committed counts from a one-row-per-batch manifest
    (never the output itself).  A batch that does not fit is accepted as far as
    it fits -- its first rows by ``key``, found by numbering keys alone -- and its
    offsets are *not* committed: a later run with a larger ``n`` gets the same
    batch again and overwrites its partition with more of it.  So no row is
    lost and none is written twice.
    """
    manifest = out.rstrip("/") + "_manifest"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        remaining = n - _manifest_total(spark, manifest, batch_id)
        if remaining <= 0:
            raise TargetReached(str(n))
        batch = batch.persist()
        try:
            size = batch.count()
            rows = batch if size <= remaining else first_n(batch, remaining, [key])
            rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)
        finally:
            batch.unpersist()
        _note(spark, manifest, batch_id, min(size, remaining))
        if size > remaining:
            raise TargetReached(str(n))

    return write


def stream_until(df: DataFrame, n: int, out: str, checkpoint: str, key: str = "game_id") -> StreamingQuery:
    """T4: run a stream into ``out`` until ``n`` rows are committed.

    End it with :func:`wait_until`, which takes reaching the target for success."""
    return (df.writeStream.foreachBatch(capped_writer(out, n, key))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def wait_until(query: StreamingQuery) -> bool:
    """Wait for a :func:`stream_until`; True when it stopped at its target."""
    try:
        query.awaitTermination()
        return False
    except StreamingQueryException as e:
        if TargetReached.__name__ not in str(e):
            raise
        return True


def committed_rows(spark: SparkSession, out: str) -> int:
    return _manifest_total(spark, out.rstrip("/") + "_manifest", -1)


def distinct_writer(out: str, key: str):
    """foreachBatch body that appends the rows whose key no earlier batch has.

    The keys seen are those of the committed table itself, so nothing is kept in
    operator state, however long the stream.  A batch asks for its own keys alone
    (a semi join of the key column with the batch's few keys) and drops those it
    finds.  A batch that is run again overwrites its own partition.
    """
    manifest = out.rstrip("/") + "_manifest"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key]).persist()
        try:
            new = batch
            if _exists(spark, out):
                schema = batch.withColumn("batch_id", F.lit(batch_id)).schema
                before = spark.read.schema(schema).parquet(out).filter(F.col("batch_id") != batch_id).select(F.col(key).alias("_seen"))
                own = batch.select(F.col(key).alias("_own"))
                seen = before.join(own, before["_seen"].eqNullSafe(own["_own"]), "left_semi").distinct()
                new = batch.join(seen, batch[key].eqNullSafe(seen["_seen"]), "left_anti")
            new.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
               .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)
        finally:
            batch.unpersist()
        own = f"{out}/batch_id={batch_id}"
        _note(spark, manifest, batch_id, spark.read.parquet(own).count() if _exists(spark, own) else 0)

    return write


def stream_distinct(df: DataFrame, out: str, checkpoint: str, key: str = "game_id") -> StreamingQuery:
    """T7 (D12): a stream's rows by key, each key once, into the table ``out``; no event time needed."""
    return (df.writeStream.foreachBatch(distinct_writer(out, key))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def snapshot_writer(out: str, key: str, interval: int = SNAPSHOT_INTERVAL):
    """T5: foreachBatch body numbering rows across batches, snapshot = ceil(n / interval).

    Rows of a batch are numbered with the distributed numbering after the
    committed count; the batch overwrites only its own partition.
    """
    manifest = out.rstrip("/") + "_manifest"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _manifest_total(spark, manifest, batch_id)
        numbered = global_row_number(batch, [key], "n").withColumn("n", F.col("n") + F.lit(done))
        numbered = numbered.withColumn("snapshot", F.ceil(F.col("n") / F.lit(interval)).cast("bigint")) \
                           .withColumn("batch_id", F.lit(batch_id))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy("batch_id").parquet(out)
        _note(spark, manifest, batch_id, spark.read.parquet(out).filter(F.col("batch_id") == batch_id).count())

    return write


def stream_snapshots(df: DataFrame, out: str, checkpoint: str, key: str = "game_id",
                     interval: int = SNAPSHOT_INTERVAL) -> StreamingQuery:
    """T5: stream with running sample numbers and snapshot numbers."""
    return (df.writeStream.foreachBatch(snapshot_writer(out, key, interval))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def snapshot_sizes(spark: SparkSession, out: str, interval: int = SNAPSHOT_INTERVAL) -> DataFrame:
    """Rows of every snapshot that a snapshot sink has committed, and whether it is partial
    (the last one of a run that ended or was interrupted between two)."""
    return spark.read.parquet(out).groupBy("snapshot").agg(F.count(F.lit(1)).alias("rows")) \
                .withColumn("partial", F.col("rows") < interval)


class ProgressSink(StreamingQueryListener):
    """A listener that appends every progress event of the session's queries to a JSON table.

    ``recentProgress`` forgets; this does not.  Events are written in groups of
    ``every`` or after ``seconds``, and when a query ends, so a crash loses at most one
    group.  Use ``spark.streams.addListener(sink)``; :meth:`progress` reads the table.
    """

    SCHEMA = ("query string, run string, name string, batch_id long, input_rows long, input_rows_per_sec double, "
              "processed_rows_per_sec double, timestamp string")

    def __init__(self, spark: SparkSession, path: str, every: int = 50, seconds: float = 30.0):
        self.spark, self.path, self.every, self.seconds = spark, path, every, seconds
        self.waiting: list[tuple] = []
        self.written = time.monotonic()
        self.ended: set[str] = set()
        self.lock = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self.waiting.append((str(p.id), str(p.runId), p.name, int(p.batchId), int(p.numInputRows),
                                 float(p.inputRowsPerSecond or 0.0), float(p.processedRowsPerSecond or 0.0), p.timestamp))
            if len(self.waiting) >= self.every or time.monotonic() - self.written >= self.seconds:
                self._write()

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self._write()
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def _write(self) -> None:
        if self.waiting:
            self.spark.createDataFrame(self.waiting, self.SCHEMA).coalesce(1).write.mode("append").json(self.path)
            self.waiting = []
        self.written = time.monotonic()

    def wait(self, query: StreamingQuery, timeout: float = 60.0) -> bool:
        """Wait until the events of a query that has ended are written."""
        with self.lock:
            return self.lock.wait_for(lambda: str(query.runId) in self.ended, timeout)

    def progress(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)


def batch_progress(spark: SparkSession, out: str) -> DataFrame:
    """Rows of every micro-batch that a capped or snapshot sink has written, from its
    manifest -- however long the run and however often it was restarted."""
    m = _manifest(spark, out.rstrip("/") + "_manifest")
    if m is None:
        return spark.createDataFrame([], "batch_id long, rows long, at timestamp, total long")
    upto = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)   # one row a batch
    return m.withColumn("total", F.sum("rows").over(upto))


def stream_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The query's recent progress as a table, as far back as Spark keeps it
    (``spark.sql.streaming.numRecentProgressUpdates``); :func:`batch_progress` has all."""
    rows = [(int(p["batchId"]), int(p["numInputRows"]), float(p.get("inputRowsPerSecond") or 0.0),
             float(p.get("processedRowsPerSecond") or 0.0), p["timestamp"]) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id long, input_rows long, input_rows_per_sec double, "
                                       "processed_rows_per_sec double, timestamp string")


def windowed_progress(df: DataFrame, ts: str = "ts", window: str = "30 seconds",
                      watermark: str = "1 minute") -> DataFrame:
    """T6 (table form): rows per event-time window, late rows bounded by a watermark.

    Watermarks need TIMESTAMP; zone-less timestamps are read in the session zone.
    """
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, watermark).groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"))


def stream_dedup(df: DataFrame, key: str = "game_id", event_time: str | None = None,
                 watermark: str = "1 hour") -> DataFrame:
    """T7 (D12): drop repeated keys.  With an event time the state is bounded
    by the watermark; without one Spark keeps every key seen in operator state --
    :func:`stream_distinct` keeps none."""
    if event_time:
        df = df.withColumn(event_time, F.col(event_time).cast("timestamp"))
        return df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])
