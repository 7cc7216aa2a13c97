"""Game archive scan, header and main-line parsing, quality rules."""

import os
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import FIXTURES
from pairwright.functions import pgn
from pairwright.functions.text import to_sequence
from pairwright.operators import quality as Q
from pairwright.operators.sampling import first_n
from pairwright.plans.games import parse_games, render_games
from pairwright.plans import QUERIES
from pairwright.sources.games import INPUT_ORDER, read_game_records, read_games

PGN = os.path.join(FIXTURES, "games.pgn")


def _by_event(spark):
    g = read_games(spark, PGN)
    rows = g.select(pgn.header("headers", "Event").alias("event"), "moves").collect()
    return {r.event: r.moves for r in rows}


def test_scan_one_row_per_game(spark):
    recs = read_game_records(spark, PGN)
    assert recs.count() == 12
    assert recs.filter(~F.col("pgn").startswith("[Event ")).count() == 0
    assert recs.select("game_id").distinct().count() == 12


def test_mainline_drops_comments_variations_numbers(spark):
    m = _by_event(spark)
    assert m["Normal game"] == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "Ba4", "Nf6", "O-O", "Be7"]
    assert m["Short date"] == ["e4", "e5", "Nf3", "Nc6"]
    assert m["No moves"] == []
    assert len(m["Long"]) == 22


def test_headers_escape_and_duplicate_last_wins(spark):
    g = read_games(spark, PGN)
    r = g.filter(pgn.header("headers", "ECO") == "C60").select(
        pgn.header("headers", "Event").alias("e"), pgn.header("headers", "WhiteElo").alias("w")).first()
    assert r.e == 'Quoted "name" and duplicate'
    assert r.w == "2400"


def test_quality_reasons(spark):
    g = Q.quality(read_games(spark, PGN))
    got = {r.e: r.reason for r in g.select(pgn.header("headers", "Event").alias("e"), "reason").collect()}
    assert got == {
        "Normal game": None, "Bot white": "bot", "Unknown elo": "elo", "Missing elo": "elo",
        "Low elo": "elo", "Bad date": "date", "Unknown date": "date", "Short date": None,
        "Time forfeit": "termination", "No moves": None,
        'Quoted "name" and duplicate': None, "Long": None,
    }
    rep = {r.reason: r.n for r in Q.quality_report(g).collect()}
    assert rep == {"kept": 5, "bot": 1, "elo": 3, "date": 2, "termination": 1}


def test_empty_game_gives_empty_text(spark):
    g = Q.keep_quality(read_games(spark, PGN))
    texts = {r.t for r in g.select(to_sequence("moves").alias("t")).collect()}
    assert "" in texts


def test_crlf_archive(spark, tmp_path):
    data = open(PGN).read().replace("\n", "\r\n")
    p = tmp_path / "crlf.pgn"
    p.write_bytes(data.encode())
    assert read_games(spark, str(p)).count() == 12
    moves = [r.m for r in read_games(spark, PGN).select(F.array_join("moves", " ").alias("m")).collect()]
    assert sorted(moves) == sorted(r.m for r in read_games(spark, str(p)).select(F.array_join("moves", " ").alias("m")).collect())
    (tmp_path / "cr.pgn").write_bytes(open(PGN).read().replace("\n", "\r").encode())
    with pytest.raises(Exception, match="unknown line endings"):
        read_games(spark, str(tmp_path / "cr.pgn")).count()


def test_ids_are_unique_and_stay_when_an_archive_moves(spark, tmp_path):
    one = open(PGN).read().strip().split("\n\n[Event ")[0]
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.pgn").write_text("\n\n".join([one] * 3) + "\n")
    ids = [sorted(r.game_id for r in read_games(spark, str(tmp_path / f)).collect()) for f in ("a", "b")]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3
    assert read_games(spark, str(tmp_path / "a")).select("content_id").distinct().count() == 1


def test_input_order_over_two_files(spark, tmp_path):
    records = open(PGN).read().strip().split("\n\n[Event ")
    (tmp_path / "a.pgn").write_text("\n\n[Event ".join(records[:2]) + "\n")
    (tmp_path / "b.pgn").write_text("[Event " + "\n\n[Event ".join(records[2:]) + "\n")
    first = first_n(read_games(spark, str(tmp_path)), 4, INPUT_ORDER).orderBy(*INPUT_ORDER)
    want = [re.match(r'(?:\[Event )?"((?:[^"\\]|\\.)*)"', r)[1].replace('\\"', '"') for r in records[:4]]
    assert [r.e for r in first.select(pgn.header("headers", "Event").alias("e")).collect()] == want


def test_compressed_archive(spark, tmp_path):
    (tmp_path / "g.pgn.zst").write_bytes(zstandard.ZstdCompressor().compress(open(PGN, "rb").read()))
    g = read_games(spark, str(tmp_path / "g.pgn.zst"))
    assert g.count() == 12 and g.select("game_id").distinct().count() == 12


@pytest.mark.parametrize("text, moves", [
    ("1. e4!{good} e5", "e4 e5"), ("1. e4!$1 e5??;odd\n2. Nf3", "e4 e5 Nf3"), ("1. e4 e5) 2. Nf3", "e4 e5 Nf3"),
    ("1. e4 ( 1. d4 ) ) e5", "e4 e5"), ("1. e4 (((((d4)))) e5) c5", "e4 c5"), ("1. 0-0 0-0-0+ 2. 0-0# 0-1", "O-O O-O-O+ O-O#"),
    ("1. e4 (d4 (c4 (b4 (a4) a5) b5) c5) d5", "e4 d5"), ("  1.e4\t1...e5  \r\n 2. 1-0 ", "e4 e5"), ("1. e4 {open * e5 3.1-0 *", "e4 {open e5 1-0")])
def test_main_line(spark, text, moves):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.array_join(pgn.mainline("t"), " ")).first()[0] == moves


def _orders(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 4 > 0, F.col("id")).alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))


def test_records_of_one_file_are_parsed_by_several_tasks(spark):
    # a quarter of the keys is null
    games = parse_games(render_games(_orders(spark, 4000).coalesce(1)))
    met = games.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(met) >= 4 and max(r["count"] for r in met) <= 2 * 4000 / len(met)


def test_rl_prompts_parse_each_game_once(spark, tmp_path):
    _orders(spark, 400).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    out = QUERIES["rl_prompts"](spark, str(tmp_path))
    assert out.count() > 10
    assert "orders.parquet" not in out._jdf.queryExecution().toString()      # the staged rows feed every branch


def test_time_rule_rejects_only_known_fast_games(spark):
    rows = [({"TimeControl": "-"}, True), ({}, True), ({"TimeControl": "180+2"}, False), ({"TimeControl": "600"}, True),
            ({"TimeControl": "300+0"}, True)]
    df = spark.createDataFrame(rows, "headers map<string,string>, want boolean")
    assert all(r.ok == r.want for r in df.withColumn("ok", Q.min_time()).collect())


def test_cap_keeps_rows_without_a_key_and_any_limit(spark):
    df = spark.range(4000).select(F.col("id").alias("game_id"), F.when(F.col("id") % 4 < 2, "A").when(F.col("id") % 4 == 2, "").alias("eco"))
    out = Q.cap_per_group(df, "eco", 1500, ["game_id"])
    assert {r.eco: r["count"] for r in out.groupBy("eco").count().collect()} == {"A": 1500, "": 1000, None: 1000}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_min_elo_zero_lets_missing_pass(spark):
    g = Q.quality(read_games(spark, PGN), Q.default_rules(min_elo_value=0))
    missing = g.filter(pgn.header("headers", "Event") == "Missing elo").first()
    assert missing.reason is None  # missing rating = 0 >= 0 (D1); '?' still fails
    unknown = g.filter(pgn.header("headers", "Event") == "Unknown elo").first()
    assert unknown.reason == "elo"


def test_time_base_and_features(spark):
    df = spark.createDataFrame([("300+2",), ("60",), ("x+1",)], "tc string")
    assert [r[0] for r in df.select(pgn.time_base("tc")).collect()] == [300, None, None]
    moves = spark.createDataFrame([("Nxe5+",), ("O-O-O",), ("e8=Q#",), ("d4",)], "san string")
    rows = moves.select(*pgn.move_features("san")).collect()
    assert rows[0].capture and rows[0].check and rows[0].piece == "N" and rows[0].target == "e5"
    assert rows[1].castle and rows[1].piece == "K" and rows[1].target is None
    assert rows[2].promotion and rows[2].mate and rows[2].target == "e8"
    assert rows[3].piece == "P" and not rows[3].capture
