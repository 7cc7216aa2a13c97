"""Prompts, candidates, legality, pairs, ranks (P6-P15, J1-J8, W1-W3, F5-F8 of FIXTURES)."""

from pyspark.sql import functions as F

from pairwright.functions.text import (drop_move_numbers, first_token, prefix, prompt_or_default,
                                       rl_prompt_len, strip_prompt)
from pairwright.operators.pairs import (annotate_moves, build_pairs, candidates, dedup_pairs,
                                        extract_moves, first_legal, format_pairs, unprocessed)
from pairwright.operators.rank import arg_best, expert_rank, rank_moves
from pairwright.sources.games import probe_positions


def test_san_pattern_hits(spark):
    df = spark.createDataFrame([(" e4xd5 O-O-O Nbd7+ e8=Q#",)], "t string")
    assert df.select(extract_moves("t")).first()[0] == ["e4xd5", "O-O-O", "Nbd7+", "e8=Q#"]


def test_probe_normalisation(spark):
    p = probe_positions(spark)
    assert p.count() == 10
    r = p.filter(F.col("name") == "Italian Game").select(drop_move_numbers("moves")).first()[0]
    assert r == "e4 e5 Nf3 Nc6"


def test_rl_prompt_length(spark):
    df = spark.createDataFrame([(5,), (30,), (36,), (100,)], "n int")
    lens = [r[0] for r in df.select(rl_prompt_len("n")).collect()]
    assert lens == [16, 16, 18, 20]
    moves = spark.createDataFrame([(["a", "b", "c", "d", "e"],)], "m array<string>")
    assert moves.select(F.size(F.slice("m", 1, rl_prompt_len(F.size("m"))))).first()[0] == 5


def test_prefix_and_defaults(spark):
    df = spark.createDataFrame([(["e4", "e5", "Nf3"], 2), (["e4"], 0)], "m array<string>, k int")
    assert [r[0] for r in df.select(prefix("m", F.col("k"))).collect()] == ["e4 e5", ""]
    d = spark.createDataFrame([("",), (None,), ("e4",)], "p string")
    assert [r[0] for r in d.select(prompt_or_default("p")).collect()] == ["1.", "1.", "e4"]


def test_strip_prompt_modes(spark):
    df = spark.createDataFrame([("e4 e5 e4 e5 Nf3", "e4 e5")], "t string, p string")
    r = df.select(strip_prompt("t", "p").alias("a"), strip_prompt("t", "p", "all").alias("b")).first()
    assert r.a == " e4 e5 Nf3" and r.b == "  Nf3"
    assert df.select(first_token(F.lit("  Nf3 Nc6 "))).first()[0] == "Nf3"


def test_candidates_and_first_legal(spark):
    texts = spark.createDataFrame([
        (1, 1, "e4 e5 Qh5 then Nf3", "e4 e5"),
        (1, 2, "e4 e5 Nc3", "e4 e5"),
        (2, 1, "d4 zz", "d4"),
    ], "position_id long, text_no int, text string, prompt string")
    c = candidates(texts)
    got = [(r.position_id, r.text_no, r.cand_no, r.san) for r in c.orderBy("position_id", "text_no", "cand_no").collect()]
    assert got[:3] == [(1, 1, 1, "Qh5"), (1, 1, 2, "Qh5"), (1, 1, 3, "Nf3")]
    legal = spark.createDataFrame([(1, "Nf3"), (1, "Nc3")], "position_id long, san string")
    s = {r.position_id: r.move for r in first_legal(c, legal).collect()}
    assert s == {1: "Nf3"}  # text 1 comes first; position 2 has none (dropped)


def test_build_pairs_keeps_disagreements_only(spark):
    pos = spark.createDataFrame([(1, "e4 e5"), (2, "d4")], "position_id long, prompt string")
    student = spark.createDataFrame([(1, "Nc3"), (2, "d5")], "position_id long, move string")
    expert = spark.createDataFrame([(1, "Nf3"), (2, "d5")], "position_id long, move string")
    p = build_pairs(pos, student, expert)
    rows = p.collect()
    assert [(r.prompt, r.chosen, r.rejected) for r in rows] == [("e4 e5", "Nf3", "Nc3")]
    f = format_pairs(p).first()
    assert f.chosen == "e4 e5 Nf3" and f.rejected == "e4 e5 Nc3"
    assert dedup_pairs(p.union(p)).count() == 1


def test_unprocessed_and_annotations(spark):
    games = spark.range(6).withColumnRenamed("id", "game_id")
    done = spark.createDataFrame([(0,), (3,)], "game_id long")
    assert sorted(r.game_id for r in unprocessed(games, done).collect()) == [1, 2, 4, 5]
    moves = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "position_id long, move string")
    ex = spark.createDataFrame([(1, "a")], "position_id long, move string")
    st = spark.createDataFrame([(1, "a"), (1, "b")], "position_id long, move string")
    notes = {r.move: r.notes for r in annotate_moves(moves, ex, st).collect()}
    assert notes == {"a": "expert, student", "b": "student", "c": ""}


def test_ranks_tie_one_candidate_expert_last(spark):
    scored = spark.createDataFrame([
        (1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.1),   # tie -> by move text
        (2, "x", 0.3),                                 # one candidate
        (3, "p", 0.9), (3, "q", 0.8), (3, "e", 0.1),   # expert last
    ], "position_id long, move string, reward_score double")
    expert = spark.createDataFrame([(1, "b"), (2, "x"), (3, "e")], "position_id long, move string")
    r = {x.position_id: (x.best, x.expert_rank, x.agrees)
         for x in expert_rank(rank_moves(scored), expert).collect()}
    assert r == {1: ("a", 2, False), 2: ("x", 1, True), 3: ("p", 3, False)}
    best = {x.position_id: x.best for x in arg_best(scored).collect()}
    assert best == {1: "a", 2: "x", 3: "p"}


def test_evaluation_moves_union_distinct(spark):
    from pairwright.operators.pairs import evaluation_moves
    ex = spark.createDataFrame([(1, "e4"), (2, "d4")], "position_id long, move string")
    st = spark.createDataFrame([(1, "e4"), (1, "c4"), (1, "c4"), (2, "Nf3")], "position_id long, move string")
    got = sorted((r.position_id, r.move) for r in evaluation_moves(ex, st).collect())
    assert got == [(1, "c4"), (1, "e4"), (2, "Nf3"), (2, "d4")]
