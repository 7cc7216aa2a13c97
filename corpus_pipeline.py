"""A training corpus in five stages; each is one operator of ``pairwright.llm``.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next one's ``docs``.  All but the last keep the columns of
``documents``.  Documents without a word (null, empty and blank texts) pass all
filters: there is nothing in them to reject, and they share no text.  Rows with a
null id are kept and dropped like others; of repeated rows one stays.  An empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontamination, packing, secret_scan, simhash, toxicity
from pairwright.llm.queries import outside_held_out
from pairwright.llm.shared import delete, stage_at


BATCH_ROWS = 2000     # texts that are in memory at once on their way to and from Python


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold of their language, and those without a word."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, allowed=outside_held_out())
    # texts are looked at again only where the score rejects them
    blank = ~F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return docs.filter((toxicity.score(docs["text"], model) < toxicity.threshold(docs["lang"], model)) | blank)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 3 bits), and those without a word."""
    _small_batches(spark)
    return simhash.one_of_each(docs, shingle=3, max_bits=3, keep_blank=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than one word in twenty inside benchmark windows."""
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by a mark."""
    _small_batches(spark)
    clean = docs.withColumn("text", secret_scan.redacted(docs["text"], secret_scan.train(docs)))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in windows of 1024 tokens."""
    _small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("secret_scan", redact_secrets), ("packing", pack)]

# Trained models and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES[:-1]:
        docs, path = stage_at(apply(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            delete(spark, before)      # the stage after it is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
