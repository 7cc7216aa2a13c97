"""Game archives (S1, S2) and the inline probe set.

An archive is text: records of ``[Tag "value"]`` lines, a blank line, move text,
in plain or compressed files.  Spark lists the files; :mod:`.archive` cuts them
into segments (bytes of plain files, frames of Zstandard files) and finds the
records by their structure, one task a segment.  Nothing is shuffled but the
segments' places -- and the records themselves where there are fewer segments
than cores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.barrier import computed_once
from ..functions.pgn import mainline, parse_headers
from ..operators.ordering import materialize
from .archive import SEGMENT_BYTES, index_task, read_task, write_task

INPUT_ORDER = ["file", "block_start", "seq"]
STREAM_SEGMENT_BYTES = 4 << 20     # of a file of a micro-batch, which has few
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _segments(files: DataFrame, segment_bytes: int) -> DataFrame:
    return files.select("path").mapInArrow(index_task(segment_bytes), "path string, begin long, end long")


def _records(segments: DataFrame, root: str) -> DataFrame:
    """file (name from the archive's folder on), block_start, seq, game_id and text of every record.

    ``seq`` is the record's place in the text: of a plain file as a whole, of a
    compressed one behind ``block_start``, the place of its frame.  Both stay when an
    archive moves or is cut otherwise, and no two records share them.
    """
    raw = segments.mapInArrow(read_task, "path string, begin long, end long, place long, record string")
    under = F.instr("path", root)
    name = F.when(under > 0, F.ltrim(F.substr("path", under + len(root)), F.lit("/"))).otherwise(F.lit(""))
    name = F.when(name != "", name).otherwise(F.substring_index("path", "/", -1))
    packed = F.substring_index("path", ".", -1).isin("zst", "gz", "bz2", "lz4")
    rec = F.col("record")
    # a lone carriage return as line end would hide every record but the first
    rec = F.when(rec.rlike(r'\r\[\w+[ \t]+"'), F.raise_error(F.lit("archive with unknown line endings"))).otherwise(rec)
    rec = F.trim(F.regexp_replace(rec, "\r\n", "\n"), F.lit(" \n\t\ufeff"))
    two = rec.rlike(r'(?m)^\[\w+[ \t]+"[^\n]*\n(?:[ \t]*\n)+\[\w+[ \t]+"')
    rec = F.when(two, F.raise_error(F.lit("record with two blocks of tags"))).otherwise(rec)
    out = raw.select(name.alias("file"), F.when(packed, F.col("begin")).otherwise(F.lit(0)).alias("block_start"),
                     F.when(packed, F.col("place")).otherwise(F.col("begin") + F.col("place")).alias("seq"), rec.alias("pgn"))
    out = computed_once(out, ["file", "block_start", "seq"], pgn=F.col("pgn")).filter(F.col("pgn") != "")
    key = F.concat_ws("\u0001", "file", F.col("block_start").cast("string"), F.col("seq").cast("string"), "pgn")
    return out.withColumn("game_id", F.sha2(key, 256).substr(1, 24))


def read_game_records(spark: SparkSession, path: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """S1 (raw): one row per game record -- file, block_start, seq, game_id, content_id, pgn.

    ``INPUT_ORDER`` is the order of the input (L1).  ``game_id`` depends on the
    record's file, place and text; ``content_id`` is the same for equal records
    anywhere.  A record with two blocks of tags raises, as does an archive whose
    lines end in carriage returns alone.
    """
    files = spark.read.format("binaryFile").load(path)
    segments = materialize(_segments(files, segment_bytes))      # narrow: the index is read once
    n = segments.count()
    recs = _records(segments.repartitionByRange(max(n, 1), "path", "begin"), path)
    cores = spark.sparkContext.defaultParallelism
    if n < cores:
        recs = recs.repartition(cores)
    return recs.select(*INPUT_ORDER, "game_id", F.sha2("pgn", 256).substr(1, 24).alias("content_id"), "pgn")


def write_archive(records: DataFrame, path: str, frame_records: int = 10_000) -> DataFrame:
    """Records (column ``pgn``) to Zstandard files under ``path``, one a task, with a frame every
    ``frame_records``, so that they can be read in parallel again.  Returns file, records, frames."""
    rows = records.select("pgn").mapInArrow(write_task(path, frame_records), "file string, records long, frames long")
    return materialize(rows)


def parse_records(recs: DataFrame) -> DataFrame:
    """Records -> the game schema (headers map, main-line moves)."""
    keep = ["game_id", "content_id", *INPUT_ORDER]
    g = computed_once(recs, [*keep, "pgn"], headers=parse_headers("pgn"))
    return computed_once(g, [*keep, "headers"], moves=mainline("pgn"))


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Game archive (plain or .zst) -> game_id, content_id, input order, headers, moves."""
    return parse_records(read_game_records(spark, path))


def stream_game_records(spark: SparkSession, path: str, max_files: int = 1, segment_bytes: int = STREAM_SEGMENT_BYTES) -> DataFrame:
    """The archive folder as an incremental feed, same records and ids as in batch.

    ``maxFilesPerTrigger`` bounds each micro-batch, the back-pressure the
    reference got from its bounded queue; a file's segments are dealt out, to a
    given number of tasks: the segments' places are a few bytes, so tasks merged by
    size would read and parse a whole file in one.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files).load(path)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _records(_segments(files, segment_bytes).repartition(tasks, "path", "begin"), path)


# The reference's ten named probe positions.
PROBE_POSITIONS = [
    ("Italian Game", "1. e4 e5 2. Nf3 Nc6"),
    ("Queen's Gambit", "1. d4 d5 2. c4"),
    ("Sicilian Defense", "1. e4 c5 2. Nf3 d6 3. d4 cxd4"),
    ("French Defense", "1. e4 e6 2. d4 d5"),
    ("King's Indian Setup", "1. d4 Nf6 2. c4 g6 3. Nc3 Bg7 4. e4 d6"),
    ("Ruy Lopez", "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6"),
    ("Pin Tactic", "1. e4 e5 2. Nf3 Nc6 3. Bc4 Be7 4. d3 d6 5. Bg5"),
    ("Fork Setup", "1. e4 e5 2. Nf3 Nc6 3. d4 exd4 4. Nxd4"),
    ("Pawn Endgame", "1. e4 e5 2. f4 exf4 3. Nf3 g5 4. h4 g4 5. Ne5"),
    ("Minor Piece Endgame", "1. e4 e5 2. Nf3 Nc6 3. Bb5 f5 4. exf5 e4"),
]
PROBE_SCHEMA = T.StructType([T.StructField("name", T.StringType(), False),
                             T.StructField("moves", T.StringType(), False)])


def probe_positions(spark: SparkSession) -> DataFrame:
    """The ten probe positions (name, moves with move numbers)."""
    return spark.createDataFrame(PROBE_POSITIONS, PROBE_SCHEMA)
