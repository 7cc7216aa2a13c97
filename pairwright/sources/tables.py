"""JSONL edges, staged Parquet, snapshots with retention, logs and metrics
(S3-S12).  Parquet inside, JSONL at the edges, always an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITTED = "_COMMITTED"
SFT_SCHEMA = T.StructType([T.StructField("text", T.StringType())])
PAIR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("prompt", "chosen", "rejected")])
LOG_EVENT = T.StructType([T.StructField(c, t) for c, t in [
    ("epoch", T.DoubleType()), ("eval_accuracy", T.DoubleType()), ("eval_loss", T.DoubleType()),
    ("eval_runtime", T.DoubleType()), ("eval_samples_per_second", T.DoubleType()),
    ("eval_steps_per_second", T.DoubleType()), ("grad_norm", T.DoubleType()),
    ("learning_rate", T.DoubleType()), ("loss", T.DoubleType()), ("step", T.LongType())]])
LOG_SCHEMA = T.StructType([
    T.StructField("best_global_step", T.LongType()), T.StructField("best_metric", T.DoubleType()),
    T.StructField("best_model_checkpoint", T.StringType()), T.StructField("epoch", T.DoubleType()),
    T.StructField("global_step", T.LongType()), T.StructField("max_steps", T.LongType()),
    T.StructField("log_history", T.ArrayType(LOG_EVENT))])
METRICS_SCHEMA = "train_runtime double, train_samples_per_second double, train_steps_per_second double, " \
                 "total_flos double, train_loss double, epoch double"


def read_sft(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``{"text": ...}`` lines (blank lines skipped)."""
    return spark.read.schema(SFT_SCHEMA).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``{"prompt", "chosen", "rejected"}`` lines."""
    return spark.read.schema(PAIR_SCHEMA).json(path)


def write_sft(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5."""
    df.select(F.col("text").cast("string")).write.mode(mode).json(path)


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S6."""
    df.select("prompt", "chosen", "rejected").write.mode(mode).json(path)


def write_stage(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Columnar storage of a stage, optionally partitioned (pruned on read)."""
    w = df.write.mode(mode)
    if by:
        w = w.partitionBy(*by)
    w.parquet(path)


def write_snapshot(df: DataFrame, base: str, version: int) -> None:
    """S8 (D13, D14): one numbered snapshot = one ``version=<n>`` partition.

    The version is an integer partition column, so "newest" is numeric, and
    each snapshot is written once (dynamic partition overwrite keeps others).
    A marker file, written last, says that the snapshot is whole.
    """
    (df.withColumn("version", F.lit(int(version)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("version").parquet(base))
    jvm = df.sparkSession._jvm
    mark = jvm.org.apache.hadoop.fs.Path(base, f"version={int(version)}/{COMMITTED}")
    mark.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(mark, True).close()


def snapshot_versions(spark: SparkSession, base: str, committed: bool = False) -> list[int]:
    """Version numbers present under ``base`` (listing of partition folders), or whole ones only."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("version="):
            if committed and not fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), COMMITTED)):
                continue
            try:
                out.append(int(name.split("=", 1)[1]))
            except ValueError:
                pass
    return sorted(out)


def retain_snapshots(spark: SparkSession, base: str, keep: int = 3) -> list[int]:
    """Delete all but the newest ``keep`` versions; returns the deleted ones."""
    versions = snapshot_versions(spark, base)
    drop = versions[:-keep] if keep > 0 else versions
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for v in drop:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"version={v}"), True)
    return drop


def latest_snapshot(spark: SparkSession, base: str, schema: T.StructType | str = PAIR_SCHEMA) -> DataFrame:
    """Rows of the newest whole version; empty (with the schema) when there is none.

    A version without its marker was torn while it was written and is passed over."""
    versions = snapshot_versions(spark, base, committed=True)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{base}/version={versions[-1]}")


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file -> one row per logged event."""
    raw = spark.read.schema(LOG_SCHEMA).option("multiLine", True).json(path)
    return raw.select("best_global_step", "best_metric", "best_model_checkpoint", F.explode("log_history").alias("e")) \
              .select("best_global_step", "best_metric", "best_model_checkpoint", "e.*")


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """One-row metrics file."""
    spark.createDataFrame([tuple(metrics.get(f.name) for f in T._parse_datatype_string(METRICS_SCHEMA).fields)],
                          METRICS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics row back, flat schema."""
    return spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(path)
