"""Reward model (M3, M4), KL policy (M5), corpus expert (M6), plug-ins (U2, U3), n-gram student (M1, M2)."""

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.operators import ngram as N
from pairwright.operators.plugins import (PART_CHARS, PART_ROWS, lexical_variety_scorer, propose_with, recent_move_proposer,
                                          score_with)
from pairwright.operators.replay import expert_from_corpus
from pairwright.operators.report import pair_metrics
from pairwright.operators.reward import HASH_SEED, fit_reward, kl_policy, pair_features, score_texts


def test_reward_model_learns_separable_pairs(spark):
    rows = [(i, f"e4 e5 good{i % 3}", f"e4 e5 bad{i % 5}") for i in range(200)]
    pairs = spark.createDataFrame(rows, "pair_id long, chosen string, rejected string")
    w = fit_reward(pairs, steps=15, lr=1.0)
    assert w.count() <= 1 << 12            # weight table bounded by the hash width
    sc = score_texts(pairs, w, "pair_id", "chosen", name="s_chosen")
    sc = score_texts(sc, w, "pair_id", "rejected", name="s_rejected")
    m = pair_metrics(sc).first()
    assert m.n_pairs == 200 and m.accuracy == 1.0 and m.loss < 0.69


def test_reward_model_on_held_out_pairs(spark):
    # the preferred text holds a word of one set, the other a word of another
    rows = [(i, f"a{i % 37} b{i % 11} good{i % 4}", f"a{i % 41} b{i % 7} bad{i % 5}") for i in range(400)]
    pairs = spark.createDataFrame(rows, "pair_id long, chosen string, rejected string")
    w = fit_reward(pairs.filter("pair_id % 4 > 0"))
    held = pairs.filter("pair_id % 4 = 0")
    sc = score_texts(score_texts(held, w, "pair_id", "chosen", name="s_chosen"), w, "pair_id", "rejected", name="s_rejected")
    assert pair_metrics(sc).first().accuracy > 0.95
    with pytest.raises(ValueError):
        fit_reward(pairs, bits=19)


def _bucket(tok, bits):
    return int(hashlib.md5(f"{HASH_SEED}:{tok}".encode()).hexdigest()[:8], 16) % (1 << bits)


def test_texts_are_counted_inside_their_rows(spark):
    rows = [("a", "e4 e5  e4", "e5 d4"), ("a", "c4", None), ("b", "x y x", "x x y"), (None, "e4", "d4"), ("c", None, " "), ("d", "", "q q")]
    df = spark.createDataFrame(rows, "pair_id string, chosen string, rejected string")
    x = pair_features(df, bits=5)
    want = {}
    for k, c, r in rows:
        n = want.setdefault(k, Counter())
        n.update(_bucket(t, 5) for t in (c or "").split())
        n.subtract(_bucket(t, 5) for t in (r or "").split())
    want = {k: {b: v for b, v in n.items() if v} for k, n in want.items()}
    assert {r.pair_id: {e.bucket: e.value for e in r.x} for r in x.collect()} == {k: n for k, n in want.items() if n}
    w = {i: i / 8 - 1 for i in range(32) if i % 3}
    s = score_texts(df, spark.createDataFrame(list(w.items()), "bucket int, w double"), "pair_id", "chosen", bits=5)
    total = lambda k: sum(w.get(_bucket(t, 5), 0) for q, c, _ in rows if q == k and k for t in (c or "").split())
    assert sorted((r.pair_id or "", r.chosen or "", round(r.reward_score, 9)) for r in s.collect()) \
        == sorted((k or "", c or "", round(total(k), 9)) for k, c, _ in rows)
    for out in (x, s):      # no row a token: a task's memory would grow with its tokens
        assert "explode(" not in out._jdf.queryExecution().toString()


def test_pair_loss_of_far_apart_scores(spark):
    df = spark.createDataFrame([(-800.0, 0.0), (800.0, 0.0)], "s_chosen double, s_rejected double")
    assert pair_metrics(df).first().loss == 400.0


def test_kl_policy_properties(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.5), (1, "b", 0.0, 0.5), (2, "x", 3.0, 1.0)],
                               "position_id long, move string, reward_score double, p_ref double")
    r = {x.position_id: x for x in kl_policy(df, beta=1.0).collect()}
    assert r[1].kl > 0 and r[1].policy_best == "a" and r[1].mean_reward > r[1].ref_reward
    assert r[2].kl == 0.0 and r[2].policy_best == "x"


def test_corpus_expert(spark):
    g = spark.createDataFrame([(["e4", "e5"], "1-0"), (["e4", "c5"], "0-1"), (["d4", "d5"], "1-0"),
                               (["d4", "d5"], "1-0"), (["e4", "e5"], "1-0")], "moves array<string>, result string")
    key = lambda h, x: hashlib.md5(f"{h} {x}".encode()).hexdigest()
    got = {r.prefix_key: (r.move, r.score, r.n) for r in expert_from_corpus(g, min_n=2).collect()}
    # start: d4 and e4 both seen; d4 scored 1.0 twice, e4 2/3 -> d4
    assert got[""] == ("d4", 1.0, 2)
    assert got[key("", "e4")] == ("e5", 0.0, 2)   # black to move, white won both
    assert got[key("", "d4")] == ("d5", 0.0, 2)


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "k long, t string")
    s = {r.k: r.s for r in score_with(df, "t", lexical_variety_scorer, "s").collect()}
    assert abs(s[1] - 2 / 3) < 1e-9 and s[2] == 0.0
    p = propose_with(spark.createDataFrame([(7, "e4 e5 Nf3 e5")], "k long, prompt string"),
                     "k", "prompt", recent_move_proposer, n=2)
    assert [(r.text_no, r.text) for r in p.orderBy("text_no").collect()] == [(1, "e4 e5 Nf3 e5 e5"), (2, "e4 e5 Nf3 e5 Nf3")]


def test_proposer_gets_a_bounded_part_of_a_batch(spark):
    def sizes():
        return lambda prompts, n: [[f"{len(prompts)} {sum(map(len, prompts))}"] * n for _ in prompts]
    rows = [(i, None if i % 9 == 0 else "x" * (PART_CHARS if i == 700 else i % 5)) for i in range(2500)]
    p = propose_with(spark.createDataFrame(rows, "k long, prompt string").coalesce(1), "k", "prompt", sizes, n=2)
    got = p.select("k", "text_no", "text").collect()
    assert sorted((r.k, r.text_no) for r in got) == [(i, j) for i in range(2500) for j in (1, 2)]
    parts = [tuple(map(int, r.text.split())) for r in got]
    assert max(n for n, _ in parts) <= PART_ROWS and max(c for _, c in parts) <= PART_CHARS


def test_ngram_probabilities_and_proposals(spark):
    seqs = spark.createDataFrame([(["a", "b", "a", "c"],), (["a", "b", "d"],)], "moves array<string>")
    m = N.fit_ngrams(seqs, max_ctx=2)
    sums = m.groupBy("ctx_len", "ctx").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums)
    assert {(r.ctx, r.next): r["count"] for r in m.filter("ctx_len = 1").collect()}[("a", "b")] == 2
    prompts = spark.createDataFrame([(1, ["x", "a"]), (2, ["q"])], "position_id long, moves array<string>")
    d = N.proposal_distribution(prompts, m, k=40, p=0.9, max_ctx=2)
    tot = {r.position_id: r.s for r in d.groupBy("position_id").agg(F.sum("prob").alias("s")).collect()}
    assert all(abs(v - 1.0) < 1e-9 for v in tot.values()) and set(tot) == {1, 2}
    s = N.propose(prompts, m, n=8, max_ctx=2)
    assert s.count() == 16
    assert {r.next for r in s.filter("position_id = 1").collect()} <= {"b", "c"}


def test_ngram_counts_against_loops(spark, monkeypatch):
    rng = random.Random(4)
    rows = [None, [], ["é"], ["a"] * 9] + [[rng.choice("a a a a b c dd é 日本 x".split()) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    seqs = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, moves array<string>").repartition(3)
    want = Counter()
    for r in rows:
        want.update((c, " ".join(r[i - c:i]), r[i]) for i in range(len(r or [])) for c in range(min(i, 3) + 1))
    totals = Counter()
    for (c, ctx, _), n in want.items():
        totals[c, ctx] += n
    contexts = spark.createDataFrame([(0, ""), (1, "a"), (2, "a é"), (3, "b a a"), (3, "no such one")], "ctx_len int, ctx string")
    asked = {(r.ctx_len, r.ctx) for r in contexts.collect()}
    for share in (2, 1000):                                   # one hot token, all of them
        monkeypatch.setattr(N, "HOT_SHARE", share)
        m = N.fit_ngrams(seqs, max_ctx=3).collect()
        assert {(r.ctx_len, r.ctx, r.next): r["count"] for r in m} == want and len(m) == len(want)
        assert all(r.ctx_total == totals[r.ctx_len, r.ctx] for r in m)
        for lo, hi in ((0, 1), (1, 2), (2, 3), (1, 1), (0, 0)):
            got = N.ngram_counts(seqs, max_ctx=hi, min_ctx=lo).collect()
            assert {tuple(r[:3]): r["count"] for r in got} == {k: n for k, n in want.items() if lo <= k[0] <= hi}
    for few in (100, 1):                                      # broadcast, and by a Bloom filter
        monkeypatch.setattr(N, "BROADCAST_CONTEXTS", few)
        got = N.fit_ngrams(seqs, max_ctx=3, contexts=contexts).collect()
        assert {tuple(r[:3]): r["count"] for r in got} == {k: n for k, n in want.items() if k[:2] in asked}
        assert all(r.ctx_total == totals[r.ctx_len, r.ctx] for r in got)
    top = N.top_continuations(seqs, 2).collect()
    best = {c: sorted((k for k in want if k[:2] == c), key=lambda k: (-want[k], k[2]))[:2] for c in totals}
    assert {(*r[:3], r["count"], r["rank"]) for r in top} == {(*k, want[k], i) for ks in best.values() for i, k in enumerate(ks, 1)}


def test_ngram_rows_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(N, "TASK_ROWS", 1)                    # several tasks
    seqs = spark.createDataFrame([(["a", "b", "a", "c"],)], "moves array<string>")
    for df in (N.fit_ngrams(seqs), N.top_continuations(seqs, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(head") == 1 and "Exchange hashpartitioning(ctx_len" not in plan


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_ngram_chunks(chunk):
    rows = [["a", "b", "a"], None, [], ["b"], ["a", "b", "a", "b", "é"]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["moves"])
    got, windows = Counter(), Counter()
    for out in N._gram_task(1, 2, chunk)([batch, batch]):
        for ctx, nxt, n in zip(*(c.to_pylist() for c in out.columns)):
            got[ctx, nxt] += n
    for out in N._window_task(1, 2, ["b"], chunk)([batch, batch]):
        for head, rest, n in zip(*(c.to_pylist() for c in out.columns)):
            for j in range(len(rest.split())):
                windows[" ".join([head, *rest.split()[:j]]), rest.split()[j]] += n
    want = Counter((" ".join(r[i - c:i]), r[i]) for r in rows if r for i in range(len(r)) for c in (1, 2) if c <= i)
    assert got == windows == Counter({k: 2 * n for k, n in want.items()})


def _distribution(rows, model, k, p, t, penalty, max_ctx):
    """Prompts (key, moves) to {key: [(next, prob)]}, by loops; a token comes once for every prompt of a key that has it."""
    keys = {}
    for key, moves in rows:
        keys.setdefault(key, []).append(moves)
    out = {}
    for key, all_moves in keys.items():
        ends = [" ".join(m[len(m) - c:]) for m in all_moves for c in range(min(max_ctx, len(m)) + 1)]
        ctx = max((e for e in ends if e in model), key=lambda e: len(e.split()))
        total, cands = sum(model[ctx].values()), []
        for nxt, n in model[ctx].items():
            times = sum(nxt in m for m in all_moves)
            cands += [(math.log(n / total) * (penalty if times else 1) / t, nxt)] * max(1, times)
        cands = [(math.exp(s - max(cands)[0]), nxt) for s, nxt in sorted(cands, key=lambda c: (-c[0], c[1]))[:k]]
        mass, kept, before = sum(w for w, _ in cands), [], 0.0
        for w, nxt in cands:
            if before < p:
                kept.append((w / mass, nxt))
            before += w / mass
        mass = sum(w for w, _ in kept)
        out[key] = sorted((nxt, round(w / mass, 9)) for w, nxt in kept)
    return out


@pytest.mark.parametrize("threshold", [1000, 0])              # ranks by a window with a limit, and by one distributed sort
def test_distribution_against_loops(spark, threshold):
    rng = random.Random(8)
    words = [f"w{i:03}" for i in range(300)]
    seqs = [[words[int(300 * rng.random() ** 3)] for _ in range(40)] for _ in range(60)]
    model = {}
    for m in seqs:
        for i in range(len(m)):
            for c in range(min(i, 2) + 1):
                model.setdefault(" ".join(m[i - c:i]), Counter())[m[i]] += 1
    # short prompts, prompts that hold all frequent tokens (of the empty context too), and a key that comes twice
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(60)]
    rows += [(100 + i, words[:60 * i] + ["unseen"] * (i % 2) + words[:1] * (1 - i % 2)) for i in range(1, 5)]
    rows += [(200, ["w001", "w000", "w002"])] * 2
    prompts = spark.createDataFrame(rows, "position_id long, moves array<string>").repartition(3)
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(name, threshold)
    try:
        fitted = N.fit_ngrams(spark.createDataFrame([(m,) for m in seqs], "moves array<string>"), max_ctx=2)
        got = {}
        for r in N.proposal_distribution(prompts, fitted, k=3, p=0.9, max_ctx=2).collect():
            got.setdefault(r.position_id, []).append((r.next, round(r.prob, 9)))
    finally:
        spark.conf.unset(name)
    want = _distribution(rows, model, 3, 0.9, N.TEMPERATURE, N.REPETITION_PENALTY, 2)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_distribution_without_prompts_or_contexts(spark):
    fitted = N.fit_ngrams(spark.createDataFrame([(["a", "b"],)], "moves array<string>"), max_ctx=2)
    prompts = spark.createDataFrame([(1, ["a"])], "position_id long, moves array<string>")
    assert N.proposal_distribution(prompts.limit(0), fitted, max_ctx=2).count() == 0
    assert N.propose(prompts, fitted.limit(0), max_ctx=2).count() == 0


def test_distribution_writes_first_ranks_not_the_model(spark, monkeypatch):
    monkeypatch.setattr("pairwright.operators.ordering.global_row_number", None)     # of a whole table, written out
    seqs = spark.createDataFrame([([f"t{i}" for i in range(3000)],)], "moves array<string>")
    prompts = spark.createDataFrame([(i, ["unseen"]) for i in range(5)], "position_id long, moves array<string>")
    written, keep = [], N.staged
    monkeypatch.setattr(N, "staged", lambda df, name: written.append(keep(df, name)) or written[-1])
    d = N.proposal_distribution(prompts, N.fit_ngrams(seqs, max_ctx=0), k=2, p=1.0, max_ctx=0)
    assert d.count() == 10
    assert sum(df.count() for df in written) <= 10 and max(len(r._best) for df in written if "_best" in df.columns for r in df.collect()) <= 4


def test_draws_read_the_distribution_once(spark):
    dist = spark.createDataFrame([(1, "a", 0.75), (1, "b", 0.25), (None, "c", 1.0)], "position_id long, next string, prob double")
    s = N.sample_n(dist, 8)
    assert s._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert sorted((r.position_id, r.draw) for r in s.collect()) == [(1, i) for i in range(1, 9)]


def test_a_context_is_sent_once_with_all_behind_it(spark):
    seqs = spark.createDataFrame([(["a", "b", "a", "c", "a", "b"],)], "moves array<string>")
    contexts = spark.createDataFrame([(1, "a")], "ctx_len int, ctx string")
    m = N.fit_ngrams(seqs, max_ctx=2, min_ctx=1, contexts=contexts)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "nexts" in plan.split("Exchange hashpartitioning(ctx", 1)[1]
    assert sorted((r.ctx, r.next, r["count"], r.ctx_total) for r in m.collect()) == [("a", "b", 2, 3), ("a", "c", 1, 3)]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_follow_chunks(chunk):
    rows = [["a", "b", "a"], None, [], ["b"], ["a", "b", "a", "b", "é"], ["日本", "a", "日本", "é"]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["moves"])
    got, want = Counter(), Counter()
    for out in N._follow_task(1, 3, chunk)([batch, batch]):
        for ctx, nexts, ns in zip(*(c.to_pylist() for c in out.columns)):
            assert len(set(nexts.split(" "))) == len(ns)
            for nxt, n in zip(nexts.split(" "), ns):
                got[ctx, nxt] += n
    for out in N._gram_task(1, 3, chunk)([batch, batch]):
        for ctx, nxt, n in zip(*(c.to_pylist() for c in out.columns)):
            want[ctx, nxt] += n
    assert got == want


def test_total_of_the_empty_context_reads_no_text_again(spark):
    seqs = spark.createDataFrame([(["a", "b", "a"],), (None,)], "moves array<string>")
    contexts = spark.createDataFrame([(0, ""), (1, "a")], "ctx_len int, ctx string")
    m = N.fit_ngrams(seqs, max_ctx=1, contexts=contexts)
    assert "size(moves" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.ctx, r.next, r["count"], r.ctx_total) for r in m.collect()) == [("", "a", 2, 3), ("", "b", 1, 3), ("a", "b", 1, 1)]
