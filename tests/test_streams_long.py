"""Long streams: repeats over a hundred batches without state, and progress that is never forgotten."""

from pyspark.sql import functions as F

from pairwright.streaming import streams as T


def lines(folder, lo, hi):
    for i in range(lo, hi):
        (folder / f"f{i:04d}.txt").write_text("\n".join([f"k{i}", f"k{i // 2}", "always", f"k{max(i - 60, 0)}"]) + "\n")


def test_repeats_across_batches_and_restarts(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    lines(src, 0, 40)
    sink = T.ProgressSink(spark, str(tmp_path / "progress"), every=20)
    spark.streams.addListener(sink)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    want = set()
    try:
        for hi in (40, 102):
            lines(src, 0 if hi == 40 else 40, hi)
            want |= {"always"} | {f"k{i}" for i in range(hi)}
            q = T.stream_distinct(spark.readStream.option("maxFilesPerTrigger", 1).text(str(src)), out, ck, key="value")
            q.awaitTermination(600)
            assert q.exception() is None
            got = [r.value for r in spark.read.parquet(out).collect()]
            assert len(got) == len(set(got)) and set(got) == want
            assert all(not p.stateOperators for p in q.recentProgress)
            assert sink.wait(q)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.streams.removeListener(sink)
    # every batch of both runs is in the table, once; Spark itself keeps the last 100 of a run
    rows = sink.progress().filter("input_rows > 0")
    assert rows.count() == rows.select("batch_id").distinct().count() == 102
    assert rows.agg(F.sum("input_rows")).first()[0] == 4 * 102
    # a batch that is run again writes its own rows again, no others
    before = spark.read.parquet(out).count()
    T.distinct_writer(out, "value")(spark.createDataFrame([("k5",), ("always",), ("new",), ("new",)], "value string"), 100)
    again = spark.read.parquet(out)
    assert [r.value for r in again.filter("batch_id = 100").collect()] == ["new"] and again.count() == before
