"""Model steps re-aimed as table jobs: corpus expert (M6), pairwise reward
model (M3, M4), user plug-ins (U2, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import drop_move_numbers, join_prompt, prompt_or_default
from ..operators.ordering import materialize, staged
from ..operators.pairs import (SAN_PATTERN, annotate_moves, attach_scores, build_pairs, candidates, canonical_move,
                               evaluation_moves, first_legal)
from ..operators.plugins import lexical_variety_scorer, propose_with, recent_move_proposer, score_with
from ..operators.rank import analysis_record, distinct_suggestions, expert_rank, rank_moves
from ..operators.replay import expert_from_corpus
from ..operators.report import pair_metrics
from ..operators.reward import HASH_SEED, fit_reward, score_texts
from ..operators.sampling import hash_split
from . import bindings as B
from .games import SQL_GAMES, synthetic_games
from .q_prep import _CONV_SQL, _conversation_pairs
from .registry import BOUNDS, SEQS, TOKENS, H, register

MIN_GAMES = 2


@register("corpus_expert", f"""WITH {SQL_GAMES.strip()},
mv AS (SELECT DISTINCT moves FROM gq),
ky AS (
  SELECT moves, i, list_reduce(list_slice(moves, 1, i - 1), lambda a, x: md5(a || ' ' || x), '') AS prefix_key
  FROM (SELECT moves, unnest(generate_series(1, len(moves))) AS i FROM mv)
),
pl AS (
  SELECT result, i, prefix_key, gq.moves[i] AS move FROM gq JOIN ky ON ky.moves = gq.moves
),
sc AS (
  SELECT i, prefix_key, move, count(*) AS n,
         avg(CASE WHEN result = '1/2-1/2' THEN 0.5
                  WHEN (result = '1-0') = ((i - 1) % 2 = 0) THEN 1.0 ELSE 0.0 END) AS score
  FROM pl GROUP BY ALL HAVING count(*) >= {MIN_GAMES}
)
SELECT CAST(i AS BIGINT) AS ply, prefix_key, move, round(score, 6) AS score, CAST(n AS BIGINT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY i, prefix_key ORDER BY score DESC, n DESC, move) AS r FROM sc)
WHERE r = 1""")
def corpus_expert(spark, sf_dir):
    """M6: the best-scoring frequent continuation of every position, at every ply."""
    g = synthetic_games(spark, sf_dir).select(
        "moves", F.element_at("headers", F.lit("Result")).alias("result"))
    return expert_from_corpus(g, min_n=MIN_GAMES)


def _reward_data(spark, sf_dir):
    pairs = _conversation_pairs(spark, sf_dir).withColumn(
        "pair_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return hash_split(pairs, "pair_id", 0.1)


@register("reward_fit_eval")
def reward_fit_eval(spark, sf_dir):
    """M3 + M4 + A11 (rows-only): Bradley-Terry model on hashed tokens fitted on
    90 % of the conversation pairs, pairwise accuracy and loss on the other 10 %."""
    data = staged(_reward_data(spark, sf_dir).select("pair_id", "split", "chosen", "rejected"), "reward-pairs")
    train = data.filter(F.col("split") == "train").select("pair_id", "chosen", "rejected")
    w = fit_reward(train)
    ev = data.filter(F.col("split") == "eval").select("pair_id", "chosen", "rejected")
    sc = score_texts(ev, w, "pair_id", "chosen", name="s_chosen")
    sc = score_texts(sc, w, "pair_id", "rejected", name="s_rejected")
    return pair_metrics(sc)


# a weight table that SQL can compute as well: one number for each bucket
_W = "((bucket * 7919) % 2001 - 1000) / 1000.0"
_BITS = 10
_SCORE = """
tk AS (SELECT {key}, unnest(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')) AS tok FROM {src}),
bk AS (SELECT {key}, {hash} % {size} AS bucket FROM tk),
sc AS (SELECT {key}, sum(((bucket * 7919) % 2001 - 1000) / 1000.0) AS score FROM bk GROUP BY ALL)"""


def _score_sql(src: str, key: str, text: str) -> str:
    return _SCORE.format(src=src, key=key, text=text, hash=H(HASH_SEED, "tok"), size=1 << _BITS)


def _weights(spark):
    return spark.range(1 << _BITS).select(F.col("id").cast("int").alias("bucket")).withColumn("w", F.expr(_W).cast("double"))


@register("reward_scores", f"""{_CONV_SQL}, {_score_sql("pairs", "conv_id, turn", "chosen")}
SELECT p.conv_id, p.turn, round(coalesce(score, 0.0), 6) AS reward_score FROM pairs p LEFT JOIN sc USING (conv_id, turn)""")
def reward_scores(spark, sf_dir):
    """M4: linear score of every chosen text under a given weight table."""
    p = _conversation_pairs(spark, sf_dir).select("conv_id", "turn", "chosen")
    out = score_texts(p, _weights(spark), ["conv_id", "turn"], "chosen", bits=_BITS)
    return out.select("conv_id", "turn", F.round("reward_score", 6).alias("reward_score"))


@register("plugin_scores", f"""{_CONV_SQL},
t AS (SELECT conv_id, turn, {TOKENS('chosen')} AS c, {TOKENS('rejected')} AS r FROM pairs)
SELECT conv_id, turn, round(coalesce(len(list_distinct(c)) / nullif(len(c), 0), 0.0), 6) AS s_chosen,
       round(coalesce(len(list_distinct(r)) / nullif(len(r), 0), 0.0), 6) AS s_rejected FROM t""")
def plugin_scores(spark, sf_dir):
    """A user scorer (pandas, Arrow batches) on every pair text."""
    p = _conversation_pairs(spark, sf_dir)
    p = score_with(p, "chosen", lexical_variety_scorer, "s_chosen")
    p = score_with(p, "rejected", lexical_variety_scorer, "s_rejected")
    return p.select("conv_id", "turn", F.round("s_chosen", 6).alias("s_chosen"),
                    F.round("s_rejected", 6).alias("s_rejected"))


_POSITIONS = f"""{SEQS.strip()},
b AS ({BOUNDS("seqs_n")}),
pos0 AS (SELECT doc_id, lang, moves, lo + ({H(B.SEED, 'doc_id')} % (hi - lo + 1)) AS k FROM b WHERE lo IS NOT NULL),
pos AS (SELECT doc_id, lang, list_slice(moves, 1, k) AS pm, array_to_string(list_slice(moves, 1, k), ' ') AS prompt,
               moves[k + 1] AS expert FROM pos0)"""


def _recent(src: str, n: int) -> str:
    """Distinct tokens of a list column ``pm``, newest first."""
    return (f"SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS no FROM "
            f"(SELECT doc_id, tok, max(i) AS i FROM (SELECT doc_id, unnest(pm) AS tok, generate_subscripts(pm, 1) AS i "
            f"FROM {src}) GROUP BY ALL) QUALIFY no <= {n}")


@register("plugin_pairs", f"""WITH {_POSITIONS},
gen AS (SELECT r.doc_id, r.no, trim(replace(p.prompt || ' ' || r.tok, p.prompt, '')) AS rest
        FROM ({_recent("pos", 8)}) r JOIN pos p USING (doc_id)),
cl AS (
  SELECT doc_id, no, list_filter(list_concat([coalesce(CASE WHEN rest = '' THEN NULL ELSE regexp_split_to_array(rest, '\\s+')[1] END, '')],
                                             regexp_extract_all(rest, '{SAN_PATTERN}')), lambda x: x <> '') AS lst FROM gen),
cands AS (SELECT doc_id, no, generate_subscripts(lst, 1) AS cand_no, unnest(lst) AS san FROM cl),
legal AS (SELECT lang, tok FROM (SELECT lang, unnest(moves) AS tok FROM seqs) GROUP BY lang, tok HAVING count(*) >= 2),
ok AS (SELECT c.* FROM cands c JOIN pos p USING (doc_id) JOIN legal l ON l.lang = p.lang AND l.tok = c.san),
student AS (SELECT doc_id, arg_min(san, (no, cand_no)) AS move FROM ok GROUP BY doc_id)
SELECT doc_id, expert AS chosen, move AS rejected FROM pos JOIN student USING (doc_id) WHERE expert <> move""")
def plugin_pairs(spark, sf_dir):
    """A user proposer (mapInPandas) feeding P14 -> J2 -> J5 on documents."""
    seqs = B.doc_sequences(spark, sf_dir)
    pos = materialize(B.doc_positions(seqs).select(F.col("doc_id").alias("position_id"), "lang", "prompt", "expert"))
    texts = propose_with(pos, "position_id", "prompt", recent_move_proposer, n=8)
    cands = candidates(texts, "position_id", "text", "prompt", "text_no", mode="all") \
        .join(pos.select("position_id", "lang"), "position_id")
    student = first_legal(cands, B.legal_tokens(seqs), keys=("lang", "san"))
    expert = pos.select("position_id", F.col("expert").alias("move"))
    return build_pairs(pos.select("position_id", "prompt"), student, expert) \
        .select(F.col("position_id").alias("doc_id"), "chosen", "rejected")


SUGGESTIONS = 5


@register("evaluation_records", f"""WITH {_POSITIONS},
nm AS (SELECT doc_id, list_filter(pm, lambda x: NOT contains(x, '.')) AS pm, expert || CASE WHEN doc_id % 3 = 0 THEN '+' ELSE '' END AS raw FROM pos),
pr AS (SELECT doc_id, pm, coalesce(nullif(array_to_string(pm, ' '), ''), '1.') AS prompt, regexp_replace(raw, '[+#]+$', '') AS expert FROM nm),
sug AS (SELECT doc_id, no, move FROM (SELECT doc_id, no, regexp_replace(tok, '[+#]+$', '') AS move FROM ({_recent("pr", SUGGESTIONS)}))
        QUALIFY row_number() OVER (PARTITION BY doc_id, move ORDER BY no) = 1),
mv AS (SELECT doc_id, expert AS move FROM pr UNION SELECT doc_id, move FROM sug),
st AS (SELECT doc_id, move, prompt || ' ' || move AS stext FROM mv JOIN pr USING (doc_id)), {_score_sql("st", "doc_id, move", "stext")},
rk AS (SELECT doc_id, move, round(coalesce(score, 0.0), 6) AS score,
              row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(score, 0.0), 6) DESC, move) AS rank FROM mv LEFT JOIN sc USING (doc_id, move)),
nt AS (SELECT rk.*, CASE WHEN rk.move = pr.expert AND sug.move IS NOT NULL THEN 'expert, student'
                         WHEN rk.move = pr.expert THEN 'expert' ELSE 'student' END AS notes
       FROM rk JOIN pr USING (doc_id) LEFT JOIN sug ON sug.doc_id = rk.doc_id AND sug.move = rk.move)
SELECT doc_id, any_value(pr.prompt) AS prompt, any_value(pr.expert) AS expert,
       string_agg(nt.move || ':' || CAST(CAST(round(nt.score * 1000) AS BIGINT) AS VARCHAR) || ':' || notes, '; ' ORDER BY rank) AS results,
       any_value(s.list) AS suggestions, min(rank) FILTER (WHERE nt.move = pr.expert)::BIGINT AS expert_rank,
       arg_min(nt.move, rank) AS best, arg_min(nt.move, rank) = any_value(pr.expert) AS agrees
FROM nt JOIN pr USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(move, ',' ORDER BY no) AS list FROM sug GROUP BY doc_id) s USING (doc_id)
GROUP BY doc_id""")
def evaluation_records(spark, sf_dir):
    """P15 + P8 -> O3 -> J6 -> W1 -> J8 -> P25: the expert's and the student's moves of every
    position, scored as ``prompt + ' ' + move``, ranked, annotated and gathered into a record.

    The prompt loses tokens with a dot, moves are compared in lexical canonical form (the
    binding adds a check sign to every third expert move), and the student suggests the
    latest distinct tokens of the prompt.
    """
    pos = B.doc_positions(B.doc_sequences(spark, sf_dir))
    raw = F.concat("expert", F.when(F.col("doc_id") % 3 == 0, F.lit("+")).otherwise(F.lit("")))
    pos = pos.select(F.col("doc_id").alias("position_id"), F.array_remove(F.split(drop_move_numbers("prompt"), " "), "").alias("toks"),
                     canonical_move(raw).alias("expert"))
    pos = materialize(pos.withColumn("prompt", prompt_or_default(F.array_join("toks", " "))))
    latest = F.slice(F.array_distinct(F.transform(F.slice(F.array_distinct(F.reverse("toks")), 1, SUGGESTIONS), canonical_move)), 1, SUGGESTIONS)
    student = pos.select("position_id", F.posexplode(latest).alias("seq", "move"))
    expert = pos.select("position_id", F.col("expert").alias("move"))
    moves = evaluation_moves(expert, student)
    texts = moves.join(pos.select("position_id", "prompt"), "position_id") \
                 .select("position_id", "move", join_prompt("prompt", "move").alias("stext"))
    scores = score_texts(texts, _weights(spark), ["position_id", "move"], "stext", bits=_BITS) \
        .withColumn("reward_score", F.round("reward_score", 6))
    ranked = annotate_moves(rank_moves(attach_scores(moves, scores)), expert, student)
    record = analysis_record(ranked, expert_rank(ranked, expert), extra=("notes",))
    sug = distinct_suggestions(student, order="seq").select("position_id", F.array_join("suggestions", ",").alias("suggestions"))
    shown = F.array_join(F.transform("results", lambda s: F.concat(
        s["move"], F.lit(":"), F.round(s["reward_score"] * 1000).cast("bigint").cast("string"), F.lit(":"), s["notes"])), "; ")
    return record.join(pos.select("position_id", "prompt"), "position_id").join(sug, "position_id", "left").select(
        F.col("position_id").alias("doc_id"), "prompt", "expert", shown.alias("results"), "suggestions", "expert_rank", "best", "agrees")
