"""Entry point B on documents: n-gram student, decoding, candidates, pairs.

Model documents (``train`` half) fit the n-gram table; each ``eval`` document
gives one position; the student proposes 8 continuations per prompt with the
reference's decoding settings; generated texts are parsed into candidates
(P14), the first legal one is the student's move (J2), and a pair is emitted
when it differs from the real next move (J5).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import join_prompt
from ..operators import ngram as N
from ..operators.pairs import SAN_PATTERN, build_pairs, candidates, first_legal
from . import bindings as B
from .registry import BOUNDS, H, SEQS, register
from ..operators.ordering import staged

_CUT = int(B.PROPOSAL_FRACTION * 4294967296)
MAX_CTX = 3


def _parts(spark, sf_dir):
    seqs = B.split_docs(B.doc_sequences(spark, sf_dir))
    p = B.doc_positions(seqs.filter(F.col("split") == "eval").drop("split"))
    prompts = staged(p.select(F.col("doc_id").alias("position_id"), "lang", "prompt", "expert"), "prompts")
    # the prompt as tokens, recovered from the sampled slice of the sequence
    prompts = prompts.withColumn("moves", F.split("prompt", " "))
    # only contexts some prompt can back off to are counted (exactly)
    needed = staged(N.backoff_contexts(prompts, max_ctx=MAX_CTX).select("ctx_len", "ctx").distinct(), "contexts")
    model = N.fit_ngrams(seqs.filter(F.col("split") == "train"), max_ctx=MAX_CTX, contexts=needed)
    # the model feeds the back-off lookup, the ranking and the candidates
    return seqs, staged(model, "model"), prompts


def _model_sql(where: str) -> str:
    return f"""
cvals AS (SELECT * FROM (VALUES (0), (1), (2), (3)) v(c)),
trows AS (SELECT moves, unnest(generate_series(1, len(moves))) AS i FROM sp {where}),
nrows AS (
  SELECT c AS ctx_len, CASE WHEN c = 0 THEN '' ELSE array_to_string(list_slice(moves, i - c, i - 1), ' ') END AS ctx,
         moves[i] AS nxt
  FROM trows, cvals WHERE i - 1 >= c
),
model AS (SELECT ctx_len, ctx, nxt, count(*) AS cnt FROM nrows GROUP BY ALL),
tot AS (SELECT ctx_len, ctx, sum(cnt) AS ctx_total FROM model GROUP BY ALL)"""


_BASE = f"""
WITH {SEQS.strip()},
sp AS (SELECT *, CASE WHEN {H(B.SPLIT_SEED, 'doc_id')} < {_CUT} THEN 'eval' ELSE 'train' END AS split FROM seqs_n),
{_model_sql("WHERE split = 'train'").strip()},
b AS ({BOUNDS("(SELECT * FROM sp WHERE split = 'eval')")}),
pos0 AS (SELECT doc_id, lang, moves, lo + ({H(B.SEED, 'doc_id')} % (hi - lo + 1)) AS k FROM b WHERE lo IS NOT NULL),
pos AS (
  SELECT doc_id, lang, array_to_string(list_slice(moves, 1, k), ' ') AS prompt, moves[k + 1] AS expert,
         list_slice(moves, 1, k) AS pmoves
  FROM pos0
),
pctx AS (
  SELECT doc_id, c AS ctx_len,
         CASE WHEN c = 0 THEN '' ELSE array_to_string(list_slice(pmoves, len(pmoves) - c + 1, len(pmoves)), ' ') END AS ctx
  FROM pos, cvals WHERE len(pmoves) >= c
),
bo AS (
  SELECT doc_id, max(ctx_len) AS ctx_len, arg_max(ctx, ctx_len) AS ctx FROM pctx
  WHERE EXISTS (SELECT 1 FROM tot t WHERE t.ctx_len = pctx.ctx_len AND t.ctx = pctx.ctx)
  GROUP BY doc_id
),
cand AS (
  SELECT bo.doc_id, m.nxt, m.cnt / t.ctx_total AS prob, list_contains(p.pmoves, m.nxt) AS in_prompt
  FROM bo JOIN model m ON m.ctx_len = bo.ctx_len AND m.ctx = bo.ctx
          JOIN tot t ON t.ctx_len = bo.ctx_len AND t.ctx = bo.ctx
          JOIN pos p ON p.doc_id = bo.doc_id
),
rw AS (SELECT doc_id, nxt, (CASE WHEN in_prompt THEN ln(prob) * {N.REPETITION_PENALTY} ELSE ln(prob) END) / {N.TEMPERATURE} AS s FROM cand),
rw2 AS (SELECT doc_id, nxt, exp(s - max(s) OVER (PARTITION BY doc_id)) AS w FROM rw),
rw3 AS (SELECT doc_id, nxt, w / sum(w) OVER (PARTITION BY doc_id) AS prob FROM rw2),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, nxt) AS r FROM rw3) WHERE r <= {N.TOP_K}),
tk2 AS (SELECT doc_id, nxt, prob / sum(prob) OVER (PARTITION BY doc_id) AS prob FROM tk),
nu AS (
  SELECT * FROM (
    SELECT *, coalesce(sum(prob) OVER (PARTITION BY doc_id ORDER BY prob DESC, nxt
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tk2)
  WHERE before < {N.TOP_P}
),
dist AS (SELECT doc_id, nxt, prob / sum(prob) OVER (PARTITION BY doc_id) AS prob FROM nu),
cum AS (
  SELECT doc_id, nxt, prob,
         sum(prob) OVER (PARTITION BY doc_id ORDER BY prob DESC, nxt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
         lead(nxt) OVER (PARTITION BY doc_id ORDER BY prob DESC, nxt) IS NULL AS last
  FROM dist
),
cuml AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY prob DESC, nxt), 0) AS lo,
                max(hi) OVER (PARTITION BY doc_id) AS total FROM cum),
draws AS (
  SELECT doc_id, d AS draw,
         ('0x' || substr(md5('{B.SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(d AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM (SELECT DISTINCT doc_id FROM dist), generate_series(1, {N.N_SAMPLES}) g(d)
),
samples AS (
  SELECT d.doc_id, d.draw, c.nxt FROM draws d JOIN cuml c ON c.doc_id = d.doc_id
  WHERE d.u * c.total >= c.lo AND (d.u * c.total < c.hi OR c.last)
)"""

_PAIRS = f"""{_BASE},
gen AS (SELECT s.doc_id, s.draw, trim(replace(p.prompt || ' ' || s.nxt, p.prompt, '')) AS rest
        FROM samples s JOIN pos p USING (doc_id)),
cl AS (
  SELECT doc_id, draw,
         list_filter(list_concat([coalesce(CASE WHEN rest = '' THEN NULL ELSE regexp_split_to_array(rest, '\\s+')[1] END, '')],
                                 regexp_extract_all(rest, '{SAN_PATTERN}')), lambda x: x <> '') AS lst
  FROM gen
),
cands AS (SELECT doc_id, draw, generate_subscripts(lst, 1) AS cand_no, unnest(lst) AS san FROM cl),
legal AS (SELECT lang, tok FROM (SELECT lang, unnest(moves) AS tok FROM seqs) GROUP BY lang, tok HAVING count(*) >= 2),
ok AS (SELECT c.* FROM cands c JOIN pos p USING (doc_id) WHERE EXISTS (SELECT 1 FROM legal l WHERE l.lang = p.lang AND l.tok = c.san)),
student AS (SELECT doc_id, arg_min(san, (draw, cand_no)) AS move FROM ok GROUP BY doc_id),
pairs AS (
  SELECT p.doc_id, p.prompt, p.expert AS chosen, s.move AS rejected
  FROM pos p JOIN student s USING (doc_id) WHERE p.expert <> s.move
)"""


@register("ngram_model", f"""
WITH {SEQS.strip()}, sp AS (SELECT * FROM seqs_n),
{_model_sql("").strip()}
SELECT CAST(m.ctx_len AS BIGINT) AS ctx_len, m.ctx, m.nxt AS next, CAST(m.cnt AS BIGINT) AS count,
       CAST(t.ctx_total AS BIGINT) AS ctx_total, round(m.cnt / t.ctx_total, 6) AS prob
FROM model m JOIN tot t USING (ctx_len, ctx)""")
def ngram_model(spark, sf_dir):
    """M1: next-token counts and shares given the last 0..3 tokens, whole documents."""
    m = N.fit_ngrams(B.doc_sequences(spark, sf_dir), max_ctx=MAX_CTX)
    return m.select(F.col("ctx_len").cast("bigint").alias("ctx_len"), "ctx", "next",
                    F.col("count").cast("bigint").alias("count"),
                    F.col("ctx_total").cast("bigint").alias("ctx_total"), F.round("prob", 6).alias("prob"))


@register("ngram_topk", f"""
WITH {SEQS.strip()}, sp AS (SELECT * FROM seqs_n),
{_model_sql("").strip()}
SELECT CAST(ctx_len AS BIGINT) AS ctx_len, ctx, nxt AS next, CAST(cnt AS BIGINT) AS count, CAST(r AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ctx_len, ctx ORDER BY cnt DESC, nxt) AS r FROM model)
WHERE r <= {N.TOP_K}""")
def ngram_topk(spark, sf_dir):
    """The 40 most frequent continuations of every context."""
    t = N.top_continuations(B.doc_sequences(spark, sf_dir), N.TOP_K, max_ctx=MAX_CTX)
    return t.select(F.col("ctx_len").cast("bigint").alias("ctx_len"), "ctx", "next",
                    F.col("count").cast("bigint").alias("count"), F.col("rank").cast("bigint").alias("rank"))


@register("backoff_contexts", f"""{_BASE}
SELECT doc_id, CAST(ctx_len AS BIGINT) AS ctx_len, ctx FROM bo""")
def backoff_contexts(spark, sf_dir):
    """Longest known context (3, 2, 1 or 0 tokens) of every prompt."""
    _, model, prompts = _parts(spark, sf_dir)
    b = N.backoff_lookup(prompts, model, max_ctx=MAX_CTX)
    return b.select(F.col("position_id").alias("doc_id"), F.col("ctx_len").cast("bigint").alias("ctx_len"), "ctx")


@register("student_distribution", f"""{_BASE}
SELECT doc_id, nxt AS next, round(prob, 6) AS prob FROM dist""")
def student_distribution(spark, sf_dir):
    """L10 + L8 + L9: penalty 1.1, temperature 0.8, top-k 40, top-p 0.9."""
    _, model, prompts = _parts(spark, sf_dir)
    d = N.proposal_distribution(prompts, model, max_ctx=MAX_CTX)
    return d.select(F.col("position_id").alias("doc_id"), "next", F.round("prob", 6).alias("prob"))


@register("student_samples", f"""{_BASE}
SELECT doc_id, CAST(draw AS BIGINT) AS draw, nxt AS next FROM samples""")
def student_samples(spark, sf_dir):
    """M2 + L11: eight hashed draws per prompt (exact top-k via ranks 1..k+s)."""
    _, model, prompts = _parts(spark, sf_dir)
    s = N.propose(prompts, model, max_ctx=MAX_CTX)
    return s.select(F.col("position_id").alias("doc_id"), F.col("draw").cast("bigint").alias("draw"), "next")


def _student_pairs(spark, sf_dir):
    seqs, model, prompts = _parts(spark, sf_dir)
    s = N.propose(prompts, model, max_ctx=MAX_CTX)
    texts = s.join(prompts.select("position_id", "prompt"), "position_id") \
             .withColumn("text", join_prompt("prompt", "next")) \
             .withColumnRenamed("draw", "text_no")
    cands = candidates(texts, "position_id", "text", "prompt", "text_no", mode="all") \
        .join(prompts.select("position_id", "lang"), "position_id")
    # legality is a semi join on (lang, san): never positions x vocabulary
    student = first_legal(cands, B.legal_tokens(seqs), keys=("lang", "san"))
    expert = prompts.select("position_id", F.col("expert").alias("move"))
    pairs = build_pairs(prompts.select("position_id", "prompt"), student, expert)
    return pairs.select(F.col("position_id").alias("doc_id"), "prompt", "chosen", "rejected")


@register("student_pairs", f"""{_PAIRS}
SELECT doc_id, prompt, chosen, rejected FROM pairs""")
def student_pairs(spark, sf_dir):
    """Entry point B: P14 candidates -> J2 first legal -> J5 pairs (chosen = real next)."""
    return _student_pairs(spark, sf_dir)
