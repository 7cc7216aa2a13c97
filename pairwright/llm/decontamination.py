"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are runs of digits, letters and non-ASCII characters of the text with A-Z
in lower case.  Of every 13 consecutive words, in documents and items alike, the
smallest hash of its nine 5-word grams is kept (winnowing: a shared span of 13
words always shares a kept hash).  Documents meet the items on kept hashes, and
each hit is extended to the 13-word windows it stands for, which are compared
word by word with the items' windows.  An item of fewer than 13 words is one
window of its own length; it is met by the hash of its first word.

One scan computes everything that a document contributes: its kept hashes are
probed while its words are at hand, and only a marker row and the windows of
hits go on.  The items' hashes are broadcast while there are at most
``BROADCAST_ROWS``; beyond that narrow (document, hash) rows are shuffled and
the documents that were hit are read again.

Null or empty text, or text without a word: no words, not contaminated.  Items
without words have no window; items with a null id count as hits but are not
listed.  Repeated items and repeated document rows are handled like any others
(rows with the same id are told apart by their text).  Empty tables: no rows, or
no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import computed_once
from ..operators.bloom import anti_join
from .shared import stage

GRAM = 5
WINDOW = 13
BROADCAST_ROWS = 400_000       # narrow rows of item hashes: some 20 MB
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _grams(hashes: str, gram: int) -> Column:
    """Hash of every run of ``gram`` words."""
    h = F.col(hashes)
    runs = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, gram)]))
    return F.slice(runs, 1, F.greatest(F.size(h) - (gram - 1), F.lit(0)))


def _kept(grams: str, width: int) -> Column:
    """Smallest of every ``width`` consecutive gram hashes."""
    g = F.col(grams)
    lows = F.transform(g, lambda _, i: F.array_min(F.slice(g, i + 1, width)))
    return F.slice(lows, 1, F.greatest(F.size(g) - (width - 1), F.lit(0)))


def _winnowed(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` and ``words``, ``word_hashes``, ``kept`` (one for each full window)."""
    df = computed_once(df.select(*keep, F.col(text).alias("_text")), [*keep], words=words_of("_text"))
    df = computed_once(df, [*keep, "words"], word_hashes=F.transform("words", lambda w: F.xxhash64(w)))
    df = computed_once(df, [*keep, "words", "word_hashes"], grams=_grams("word_hashes", GRAM))
    return computed_once(df, [*keep, "words", "word_hashes"], kept=_kept("grams", WINDOW - GRAM + 1))


def _window(words: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``short, h, length, span, item`` for every window of every item."""
    rows = _winnowed(items.select(F.col(id_col).cast("string").alias("item"), text_col), ["item"], text_col)
    long = rows.select("item", "words", F.posexplode("kept").alias("start", "h")) \
               .select(F.lit(False).alias("short"), "h", F.lit(WINDOW).alias("length"),
                       _window(F.col("words"), F.col("start"), WINDOW).alias("span"), "item")
    short = rows.filter(F.size("words").between(1, WINDOW - 1)) \
                .select(F.lit(True).alias("short"), F.element_at("word_hashes", 1).alias("h"),
                        F.size("words").alias("length"), F.array_join("words", " ").alias("span"), "item")
    return long.union(short)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``id_col, text_key, n_words, n_hit, item_ids`` (sorted as strings)."""
    windows = stage(item_windows(items, item_col, item_text_col), "decontam-items")
    probes = windows.select("short", "h", "length").distinct()
    has_short = windows.filter("short").limit(1).count() > 0
    rows = _document_rows(docs, id_col, text_col)
    element = "array<struct<short:boolean,h:bigint>>"
    kept = F.transform(F.array_distinct("kept"), lambda h: F.struct(F.lit(False).alias("short"), h.alias("h")))
    if has_short:
        kept = F.concat(kept, F.transform(F.array_distinct("word_hashes"),
                                          lambda h: F.struct(F.lit(True).alias("short"), h.alias("h"))))
    marker = F.array(F.struct(F.lit(None).cast("boolean").alias("short"), F.lit(None).cast("bigint").alias("h")))
    probed = computed_once(rows, ["_id", "_key", "words", "word_hashes", "kept"],
                           probe=F.concat(marker.cast(element), kept.cast(element)))
    marked = ["_id", "_key", F.size("words").cast("bigint").alias("n_words")]
    if probes.count() <= broadcast_rows:
        met = probed.select("_id", "_key", "words", "word_hashes", "kept", F.inline("probe")) \
                    .join(F.broadcast(probes), ["short", "h"], "left") \
                    .filter(F.col("h").isNull() | F.col("length").isNotNull())
    else:
        met = _met_by_shuffle(probed, probes)
    found = stage(met.select(*marked, F.col("h").isNull().alias("marker"), _starts().alias("starts")), "decontam-met")
    spans = windows.groupBy("span").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = found.filter("not marker").select("_id", "_key", F.inline("starts")) \
                .join(spans, "span").groupBy("_id", "_key") \
                .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("runs"),
                     F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hits = hits.select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), _covered("runs").alias("n_hit"), "item_ids")
    return found.filter("marker").join(
        hits, F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_key").eqNullSafe(F.col("_key2")), "left") \
        .select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), "n_words",
                F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def _document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_body"))
    return _winnowed(rows, ["_id", "_key"], "_body")


def _met_by_shuffle(probed: DataFrame, probes: DataFrame) -> DataFrame:
    """For item tables beyond the broadcast bound: narrow rows meet the probes, then the
    documents that were hit."""
    narrow = probed.select("_id", "_key", F.inline("probe")).filter("h is not null").distinct()
    hit = stage(narrow.join(probes, ["short", "h"]).select(
        F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "short", "h", "length"), "decontam-hit")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_key").eqNullSafe(F.col("_key2"))
    nothing = {"short": "boolean", "h": "bigint", "length": "int"}
    markers = probed.select("_id", "_key", "words", "word_hashes", "kept",
                            *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    found = probed.select("_id", "_key", "words", "word_hashes", "kept").join(hit, same) \
                  .select("_id", "_key", "words", "word_hashes", "kept", *nothing)
    return markers.union(found)


def _starts() -> Column:
    """The windows that a met probe stands for: ``start, length, span``."""
    words = F.col("words")
    long = F.filter(F.transform("kept", lambda x, i: F.when(x == F.col("h"), i)), lambda i: i.isNotNull())
    short = F.filter(F.transform("word_hashes", lambda x, i: F.when(
        (x == F.col("h")) & (i + F.col("length") <= F.size(words)), i)), lambda i: i.isNotNull())
    at = F.when(F.col("h").isNull(), F.array().cast("array<int>")).when(F.col("short"), short).otherwise(long)
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.col("length").alias("length"),
                                              _window(words, i, F.col("length")).alias("span")))


def _covered(runs: str) -> Column:
    """Positions covered by sorted ``(start, length)`` runs."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(runs, zero, lambda acc, r: F.struct(
        F.greatest(acc["end"], r["start"] + r["length"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), r["start"] + r["length"] - F.greatest(acc["end"], r["start"]))).alias("n")),
        lambda acc: acc["n"])


def is_contaminated(n_hit: Column | str = "n_hit", n_words: Column | str = "n_words") -> Column:
    """At least one word in twenty lies in a benchmark window."""
    n_hit, n_words = (F.col(c) if isinstance(c, str) else c for c in (n_hit, n_words))
    return (n_hit > 0) & (20 * n_hit >= n_words)


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; the columns stay as they are.

    The contaminated ones are found first, as narrow keys; no document is shuffled
    while there are at most ``BROADCAST_ROWS`` of them, and beyond that only those that a Bloom filter marks."""
    bad = contamination(docs, items, id_col, text_col).filter(is_contaminated()) \
        .select(F.col(id_col).alias("_bad_id"), F.col("text_key").alias("_bad_key"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[id_col].alias("_bad_id"),
                        F.xxhash64(docs[text_col]).alias("_bad_key"))
    return anti_join(keyed, stage(bad, "decontam-bad"), ["_bad_id", "_bad_key"], BROADCAST_ROWS).select("_doc.*")
