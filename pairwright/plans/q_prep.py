"""Training-table preparation: splits, caps, RL prompts, pair sources (L2-L4, L7, P7, P9,
P22-P24, A9, O4, J5 on conversations and labels)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash32
from ..functions.text import rl_prompt_len, to_sequence
from ..operators import encode as E
from ..operators import quality as Q
from ..operators.ordering import global_row_number, group_row_number, staged
from ..operators.pairs import dedup_pairs, disagreements, format_pairs
from ..operators.report import split_sizes
from ..operators.sampling import exact_split, first_n, hash_split, take_samples
from ..operators.sampling import phase_positions as sampling_phase_positions
from . import bindings as B
from .games import SQL_GAMES, synthetic_games
from .q_docs import _PAIRS_SQL, _doc_pairs_df
from .registry import H, register

EVAL_FRACTION = 0.1  # reward and RL splits hold out 10 %
HEAD_ROWS = 500      # L3 in the query: small enough to cut the test tables
REWARD_BATCH, REWARD_EPOCHS = 24, 2
PAIR_TARGET = 100    # L2 in the query, likewise
_CUT10 = int(EVAL_FRACTION * 4294967296)


@register("doc_split", f"""
SELECT doc_id, CASE WHEN {H(42, 'doc_id')} < {_CUT10} THEN 'eval' ELSE 'train' END AS split FROM documents""")
def doc_split(spark, sf_dir):
    """L4: seeded 10 % hash split, no shuffle."""
    return hash_split(B.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", EVAL_FRACTION)


@register("doc_split_sizes", f"""
SELECT split, count(*)::BIGINT AS n, CAST(ceil(count(*) / {REWARD_BATCH}) * {REWARD_EPOCHS} AS BIGINT) AS steps FROM (
  SELECT CASE WHEN {H(42, 'doc_id')} < {_CUT10} THEN 'eval' ELSE 'train' END AS split FROM documents) GROUP BY split""")
def doc_split_sizes(spark, sf_dir):
    """Rows per split and optimizer steps (effective batch 24, 2 epochs)."""
    return split_sizes(doc_split(spark, sf_dir), REWARD_BATCH, REWARD_EPOCHS)


@register("doc_exact_split", f"""
SELECT doc_id, CASE WHEN r <= ceil(n * {EVAL_FRACTION}) THEN 'eval' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {H(42, 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents)""")
def doc_exact_split(spark, sf_dir):
    """L4 exact: exactly ceil(n * 10 %) rows held out, by hash rank."""
    return exact_split(B.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", EVAL_FRACTION)


_RL_SQL = f"""WITH {SQL_GAMES.strip()},
sft AS (SELECT game_id, array_to_string(moves, ' ') AS text FROM gq WHERE reason IS NULL),
vocab AS (
  SELECT tok, row_number() OVER (ORDER BY cnt DESC, tok) + 1 AS tid FROM (
    SELECT tok, count(*) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS tok FROM sft) WHERE tok <> ''
    GROUP BY tok)
),
pr AS (
  SELECT game_id, len(string_split(text, ' ')) AS n,
         least(20, greatest(16, len(string_split(text, ' ')) // 2)) AS plen,
         list_filter(list_slice(string_split(text, ' '), 1, least(20, greatest(16, len(string_split(text, ' ')) // 2))),
                     lambda x: x <> '') AS ptoks
  FROM sft
),
ex AS (SELECT game_id, generate_subscripts(ptoks, 1) AS pos, unnest(ptoks) AS tok FROM pr),
ids AS (
  SELECT ex.game_id, list(coalesce(v.tid, 1) ORDER BY ex.pos) AS ids
  FROM ex LEFT JOIN vocab v ON v.tok = ex.tok GROUP BY ex.game_id
),
rl AS (
  SELECT pr.game_id, pr.plen, coalesce(ids.ids, []) AS ids FROM pr LEFT JOIN ids USING (game_id)
)"""


@register("rl_prompts", f"""{_RL_SQL}
SELECT game_id, CAST(plen AS BIGINT) AS prompt_len, CAST(len(ids) AS BIGINT) AS n_tokens,
       array_to_string(list_resize(CAST(ids AS BIGINT[]), {E.MAX_LENGTH}, 0), ' ') AS input_ids,
       CAST(len(list_resize(ids, {E.MAX_LENGTH}, 0)) AS BIGINT) AS n_ids,
       CASE WHEN {H(42, 'game_id')} < {_CUT10} THEN 'eval' ELSE 'train' END AS split
FROM rl""")
def rl_prompts(spark, sf_dir):
    """Entry point E (P7, P22, P23, L4, D18): fixed-length prompt ids from the SFT table.

    The SFT text is split on one space; the prompt keeps min(20, max(16, n div 2))
    moves; ids come from the move vocabulary (0 pad, 1 unknown); every row is
    encoded and 10 % are held out (L3's cap is query ``head_games``).  ``input_ids`` is shown as
    text here; the library returns ``array<bigint>`` with the declared schema.
    """
    # the vocabulary, the prompts and the join back read the same rows: games are parsed once
    sft = staged(Q.keep_quality(synthetic_games(spark, sf_dir)).select("game_id", to_sequence("moves").alias("text")), "rl-sft")
    toks = sft.select("game_id", F.split("text", " ").alias("toks"))
    vocab = E.build_vocab(toks.select(F.filter("toks", lambda x: x != "").alias("toks")), "toks")
    plen = rl_prompt_len(F.size("toks"))
    pr = toks.select("game_id", plen.alias("plen"), F.slice("toks", 1, plen).alias("ptoks"))
    enc = E.encode(pr, vocab, "game_id", "ptoks")
    schema = T.StructType([*E.RL_SCHEMA.fields, T.StructField("game_id", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    rl = E.conform(enc, schema)
    out = rl.join(pr.select("game_id", "plen"), "game_id")
    out = hash_split(out, "game_id", EVAL_FRACTION)
    return out.select("game_id", F.col("plen").cast("bigint").alias("prompt_len"), "n_tokens",
                      F.array_join("input_ids", " ").alias("input_ids"),
                      F.size("input_ids").cast("bigint").alias("n_ids"), "split")


@register("head_games", f"""WITH {SQL_GAMES.strip()}
SELECT game_id, array_to_string(moves, ' ') AS text FROM gq WHERE reason IS NULL ORDER BY game_id LIMIT {HEAD_ROWS}""")
def head_games(spark, sf_dir, n: int = HEAD_ROWS):
    """L3: the first ``n`` rows of the SFT table in key order (the reference's RL step uses 50 000)."""
    sft = Q.keep_quality(synthetic_games(spark, sf_dir)).select("game_id", to_sequence("moves").alias("text"))
    return first_n(sft, n, ["game_id"])


_CONV_SQL = f"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, row_number() OVER (ORDER BY {H(42, 'conv_id')}, conv_id) AS rn, count(*) OVER () AS n FROM c),
fa AS (SELECT conv_id, arg_min(text, turn) AS atext FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
partner AS (SELECT a.conv_id, b.conv_id AS pconv FROM r a JOIN r b ON b.rn = a.rn % a.n + 1),
u AS (
  SELECT x.conv_id, x.turn, x.text AS prompt, y.text AS chosen
  FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 AND y.role = 'assistant'
  WHERE x.role = 'user'
),
pairs AS (
  SELECT u.conv_id, u.turn, u.prompt, u.chosen, fa.atext AS rejected
  FROM u JOIN partner p USING (conv_id) JOIN fa ON fa.conv_id = p.pconv
  WHERE p.pconv <> u.conv_id AND u.chosen <> fa.atext
)"""


def _conversation_pairs(spark, sf_dir):
    conv = B.table(spark, sf_dir, "conversations")
    ids = conv.select("conv_id").distinct().withColumn("_h", hash32(42, "conv_id"))
    ranked = global_row_number(ids, ["_h", "conv_id"], "rn")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.crossJoin(F.broadcast(n))  # one-row table
    partner = ranked.select("conv_id", ((F.col("rn") % F.col("n")) + 1).alias("prn")) \
        .join(ranked.select(F.col("rn").alias("prn"), F.col("conv_id").alias("pconv")), "prn")
    first_a = conv.filter(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("pconv")) \
        .agg(F.min_by("text", "turn").alias("rejected"))
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    nxt = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    u = user.join(nxt, ["conv_id", "turn"])
    pairs = u.join(partner, "conv_id").filter(F.col("pconv") != F.col("conv_id")).join(first_a, "pconv")
    return disagreements(pairs).select("conv_id", "turn", "prompt", "chosen", "rejected")


@register("conversation_pairs", f"""{_CONV_SQL}
SELECT conv_id, turn, prompt, chosen, rejected FROM pairs""")
def conversation_pairs(spark, sf_dir):
    """J5 on conversations: prompt = user turn, chosen = next assistant turn,
    rejected = first assistant turn of the next conversation in hash order."""
    return _conversation_pairs(spark, sf_dir)


@register("reward_records", f"""{_CONV_SQL}
SELECT DISTINCT prompt, prompt || ' ' || chosen AS chosen, prompt || ' ' || rejected AS rejected FROM pairs""")
def reward_records(spark, sf_dir):
    """Entry point D (O4 + P9): distinct pairs, chosen/rejected prefixed by the prompt."""
    p = dedup_pairs(_conversation_pairs(spark, sf_dir).select("prompt", "chosen", "rejected"))
    return format_pairs(p)


@register("label_pairs", f"""
WITH d AS (SELECT l.doc_id, l.quality, d.source, d.lang FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {H(42, 'doc_id')}, doc_id) AS i FROM d WHERE quality = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {H(42, 'doc_id')}, doc_id) AS j,
             count(*) OVER (PARTITION BY source, lang) AS m FROM d WHERE quality = 0)
SELECT c.source, c.lang, c.doc_id AS chosen_doc, r.doc_id AS rejected_doc
FROM c JOIN r ON r.source = c.source AND r.lang = c.lang AND r.j = (c.i - 1) % r.m + 1""")
def label_pairs(spark, sf_dir):
    """J5 by labels: each quality-1 document is paired with one quality-0
    document of the same (source, lang), cycling through the group's rejects.

    Ranks come from a distributed sort, so a group holding a third of the
    rows is still split across tasks; every chosen document gets exactly one
    partner, and no group emits all pairs.
    """
    lab = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    d = lab.join(docs, "doc_id").withColumn("_h", hash32(42, "doc_id"))
    keys = ["source", "lang"]
    c = group_row_number(d.filter(F.col("quality") == 1), keys, ["_h", "doc_id"], "i")
    r = group_row_number(d.filter(F.col("quality") == 0), keys, ["_h", "doc_id"], "j")
    m = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    c = c.join(m, keys).withColumn("j", (F.col("i") - 1) % F.col("m") + 1)
    out = c.select(*keys, "j", F.col("doc_id").alias("chosen_doc")) \
           .join(r.select(*keys, "j", F.col("doc_id").alias("rejected_doc")), [*keys, "j"])
    return out.select(*keys, "chosen_doc", "rejected_doc")


@register("token_cost", f"""WITH {SQL_GAMES.strip()},
sft AS (SELECT moves, array_to_string(moves, ' ') AS text FROM gq WHERE reason IS NULL)
SELECT CAST(sum(len(moves)) AS BIGINT) AS n_moves,
       CAST(sum(len(regexp_extract_all(text, '{E.PIECE_PATTERN}'))) AS BIGINT) AS n_pieces,
       round(sum(len(regexp_extract_all(text, '{E.PIECE_PATTERN}'))) / sum(len(moves)), 6) AS pieces_per_move,
       round(100.0 * (1.0 - sum(len(moves)) / sum(len(regexp_extract_all(text, '{E.PIECE_PATTERN}')))), 6) AS saving_pct
FROM sft""")
def token_cost(spark, sf_dir):
    """Character-class pieces per move vs one vocabulary id per move."""
    g = Q.keep_quality(synthetic_games(spark, sf_dir)).select("moves", to_sequence("moves").alias("text"))
    return E.token_cost(g)


@register("pairs_capped", f"""WITH p AS ({_PAIRS_SQL.strip()})
SELECT doc_id, chosen, rejected FROM p ORDER BY {H(42, 'doc_id')}, doc_id LIMIT {PAIR_TARGET}""")
def pairs_capped(spark, sf_dir, n: int = PAIR_TARGET):
    """L2: stop at ``n`` collected pairs (the reference: 750 000) -- those of lowest hash, repeatable."""
    return take_samples(_doc_pairs_df(spark, sf_dir), n, "doc_id").select("doc_id", "chosen", "rejected")


@register("phase_positions", f"""WITH {SQL_GAMES.strip()},
ph AS (
  SELECT game_id, moves, n_plies AS n,
    CASE WHEN n_plies > 15 THEN 8 + ({H(42, "game_id || ':opening'")} % (least(15, n_plies - 5) - 8 + 1)) END AS op,
    CASE WHEN n_plies > 25 THEN 16 + ({H(42, "game_id || ':middle'")} % (least(40, n_plies - 5) - 16 + 1)) END AS mid,
    list_min(list_filter(range(10, least(50, n_plies - 3)),
             lambda i: len(list_filter(list_slice(moves, i + 1, i + 3), lambda x: regexp_matches(x, '[x+#]'))) > 0)) AS tac
  FROM gq WHERE reason IS NULL
),
lst AS (SELECT game_id, list_slice(list_filter([op, mid, tac], lambda x: x IS NOT NULL), 1, 2) AS l FROM ph)
SELECT game_id, CAST(slot AS BIGINT) AS slot, CAST(move_index AS BIGINT) AS move_index FROM (
  SELECT game_id, generate_subscripts(l, 1) AS slot, unnest(l) AS move_index FROM lst)""")
def phase_positions(spark, sf_dir):
    """Up to two positions per game -- opening 8..15, middle 16..40, first
    tactic (capture/check/mate in the next three moves) from ply 10 -- cut to two."""
    g = Q.keep_quality(synthetic_games(spark, sf_dir)).select("game_id", "moves", "n_plies")
    return sampling_phase_positions(g)
