"""Bloom anti join and the sketched cut against plain ones, with nulls, ties and plans."""

import pytest
from pyspark.sql import functions as F

from pairwright.operators import bloom, sampling
from pairwright.operators.pairs import unprocessed


def test_anti_join_is_exact(spark, monkeypatch):
    rows = spark.range(20000).select(F.when(F.col("id") % 97 > 0, F.col("id") % 5000).alias("k"), (F.col("id") % 3).cast("string").alias("t"), "id")
    gone = rows.filter("id % 7 = 0").select("k", "t")
    want = {r.id for r in rows.collect()} - {r.id for r in rows.join(
        gone.distinct().withColumnRenamed("k", "k2").withColumnRenamed("t", "t2"), F.expr("k <=> k2 and t <=> t2"), "left_semi").collect()}
    for most in (bloom.MAX_WORDS, 8):       # the second lets nearly every row through
        monkeypatch.setattr(bloom, "MAX_WORDS", most)
        out = bloom.anti_join(rows, gone, ["k", "t"])
        assert out.columns == rows.columns and sorted(r.id for r in out.collect()) == sorted(want)
    assert bloom.anti_join(rows, gone.limit(0), ["k", "t"]).count() == 20000
    keyed = rows.select(F.xxhash64("k").alias("k"), F.col("t").cast("int").alias("t"), "id")
    few = bloom.anti_join(keyed, keyed.filter("id % 7 = 0"), ["k", "t"], broadcast_keys=1 << 20)
    assert sorted(r.id for r in few.collect()) == sorted(want)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert bloom.anti_join(rows.limit(0), gone, ["k", "t"]).count() == 0


def test_sure_rows_are_not_shuffled(spark, tmp_path):
    spark.range(5000).selectExpr("id as game_id", "repeat('x', 100) as moves").write.parquet(str(tmp_path / "g"))
    games, done = spark.read.parquet(str(tmp_path / "g")), spark.range(0, 5000, 3).toDF("game_id")
    out = unprocessed(games, done)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    sure = plan.split("BroadcastNestedLoopJoin")[1]
    assert "LeftAnti" in sure and plan.count("Scan parquet") == 2
    assert out.count() == 5000 - 1667
    words = bloom.bloom_filter(done, ["game_id"], 1667)[1]
    bits = bloom.bloom_filter(done, ["game_id"], 1667)[0]
    passed = games.join(F.broadcast(bits), bloom.may_hold(F.col("_bits"), words, [games["game_id"]]), "left_semi").count()
    assert 1667 <= passed < 1667 + 60          # two in a thousand of the others


@pytest.mark.parametrize("kind", ["long", "date", "timestamp", "string", "double", "ties", "nulls"])
@pytest.mark.parametrize("n", [1, 40, 5000, 9990, 10000, 20000])
def test_first_n_of_every_kind(spark, kind, n):
    k = (F.col("id") * 7919 % 10007)
    key = {"long": k, "date": F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")),
           "timestamp": F.timestamp_seconds(k), "string": F.concat(F.lit("prefix-all-share-"), F.lpad(k.cast("string"), 6, "0")),
           "double": k / 7, "ties": k % 3, "nulls": F.when(k % 4 > 0, k)}[kind]
    df = spark.range(10000).select(key.alias("k"), "id")
    got = sorted(r.id for r in sampling.first_n(df, n, ["k", "id"]).collect())
    assert got == sorted(r.id for r in df.orderBy("k", "id").limit(n).collect())


def test_a_sketch_that_is_off_changes_nothing(spark, monkeypatch):
    df = spark.range(10000).select((F.col("id") * 7919 % 10007).alias("k"))
    want = sorted(r.k for r in df.orderBy("k").limit(700).collect())
    monkeypatch.setattr(sampling, "SLACK", -0.01)       # both cuts on the wrong side
    assert sorted(r.k for r in sampling.first_n(df, 700, ["k"]).collect()) == want
    monkeypatch.setattr(sampling, "HEAP", 0)
    assert sorted(r.k for r in sampling.first_n(df, 700, ["k"]).collect()) == want
    monkeypatch.setattr(sampling, "SLACK", 0.002)
    assert sorted(r.k for r in sampling.first_n(df, 700, ["k"]).collect()) == want
