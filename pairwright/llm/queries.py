"""The registered queries of this subpackage: thin, over whole tables, with their contract's columns."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, embedding_dedup, filter_audit, html_main, maxent, packing, secret_scan, sharding,
               simhash, source_audit, substring_dedup, token_counts, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id", fifth: int = 0):
    """The fifth of the documents that is never learnt from (null ids: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == fifth, F.lit(False))


def outside_held_out(id_col: str = "doc_id"):
    return ~held_out(id_col)


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


@register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: the base patterns' and what the CRF adds."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", secret_scan.spans("text", secret_scan.train(docs)).alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "crf")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return rows.select("doc_id", *[count(k) for k in (*secret_scan.KINDS, "crf")],
                       F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
                       secret_scan.as_text(F.col("found")).alias("spans"))


_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@register("op4_substring_dedup", f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS span FROM d, unnest(range(1, len(w) - 18)) AS t(s)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY span ORDER BY doc_id, s) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM ranked, unnest(range(s, s + 20)) AS t(p) WHERE r > 1),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)) AS k FROM d LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 20-word windows that stand earlier in the corpus."""
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


@register("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 40 equal shards by their id, and with one shard more."""
    out = sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 and components of all vectors."""
    out = embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), allowed=outside_held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "lang", toxicity.score("text", model).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       toxicity.threshold("lang", model).alias("lang_threshold"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{decontamination.WORD}')"


@register("op8_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item, 13 AS len, array_to_string(w[s:s + 12], ' ') AS span FROM b, unnest(range(1, len(w) - 11)) AS t(s) WHERE len(w) >= 13
  UNION ALL SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
lens AS (SELECT DISTINCT len FROM iw),
dw AS (SELECT rid, s, lens.len, array_to_string(w[s:s + lens.len - 1], ' ') AS span FROM d, lens, unnest(range(1, len(w) - lens.len + 2)) AS t(s)),
spans AS (SELECT DISTINCT span FROM iw),
met AS (SELECT rid, s, len, span FROM dw SEMI JOIN spans USING (span)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM met, unnest(range(s, s + len)) AS t(p) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, item FROM met JOIN iw USING (span) WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
""")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 13-word window of a benchmark item."""
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      decontamination.is_contaminated().alias("contaminated"))


@register("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's winning paths."""
    return html_main.main_text(table(spark, sf_dir, "pages"))


@register("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, 3 bits)."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", "fingerprint", "component_id")


@register("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document, by counts alone and by the trained model."""
    docs, held = table(spark, sf_dir, "documents"), held_out(fifth=1)
    model, counts = maxent.fit(docs, allowed=~held)
    out = maxent.score(docs, model, counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@register("op12_filter_audit", rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_SPLIT} AS w FROM documents),
least_id AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
lab AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > m, false)] AS fails
  FROM d JOIN least_id USING (t) LEFT JOIN lab USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM l a, l b, l c, l e, l g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
walk AS (
  SELECT part, o, l.i AS step, o[l.i] AS filter, n, good, toxic, fails[o[l.i]] AS fails_it,
    len(list_filter(o[1:l.i - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM cells, orders, l),
sums AS (
  SELECT part, o, step, filter, sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN alone AND fails_it THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM walk GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step, kept, removed, redundant,
  unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM sums
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in all 120 orders."""
    return filter_audit.interactions(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op13_source_audit", rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM n JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM whole JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term)
        WHERE a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that each uses more than its language."""
    return source_audit.divergence(table(spark, sf_dir, "documents"))
