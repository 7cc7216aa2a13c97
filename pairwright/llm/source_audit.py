"""How far the sources of a language differ in their words.

Terms are runs of ASCII letters (A-Z in lower case) and non-ASCII characters.  A
language's vocabulary is every term in at least ``MIN_DOCS`` of its documents,
numbered in the order of their bytes.  It is held as minimal acyclic transducers
from term to ordinal; the texts are streamed through them and counted again by
ordinal, so no string is grouped or shuffled in the second pass.  Ordinals also
break ties, and only the terms of the report are spelled out again.

A bucket of at most about ``BUCKET`` terms has one transducer, built in one task.
Vocabularies of at most ``BROADCAST`` terms in all (documented bound; one bucket a
language; spelled out, ``BROADCAST_BYTES``) travel with the tasks that read the texts.  Beyond it the terms of each
task are counted first, and the sums are dealt out to the buckets, where each
task streams them through its bucket's transducer.  Both ways give the same rows.

Shares are integers: 1 + floor(10^9 (count + 5) / (N + 5 V)) in decimals of 38
digits.  Pairs of sources are compared in blocks of ordinals, (sources x block)
numbers at a time, and summed; a source without a term in the block counts with
its share of none.  Of many sources a task takes only some as the first of a pair.

Null text, language and source are empty strings.  Repeated rows count one by
one.  A language without kept terms still gives its pairs, at 0.  An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import group_row_number
from .shared import stage
from .transducer import Transducer
from .wordnum import Words, text_chunks

MIN_DOCS = 30
TOP = 50
BUCKET = 400_000          # terms of one transducer
BROADCAST = 400_000       # terms whose transducers may travel with the tasks
BROADCAST_BYTES = 32 << 20   # and what they may spell in all
CELLS = 1 << 16           # of one block: sources x ordinals
PAIRS = 1 << 20           # of one block: rows that a task returns
HELD = 1 << 20            # sums that a task holds before it sends them
CHUNK = 4 << 20           # bytes of text counted at once

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(words: Words) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a chunk, lower case, as codes of its own dictionary, and the text of each."""
    sizes = words.ends - words.starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = words.data[LETTERS[words.data]]
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)),
                                                                    pa.py_buffer(data)])
    return spelled.dictionary_encode(), np.repeat(np.arange(words.hi - words.lo), words.counts())


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, list[list]]:
    """Number of the combination of values in each row, and the values of each combination."""
    codes = [c.dictionary_encode() for c in columns]
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for c in codes:
        key = key * (len(c.dictionary) + 1) + c.indices.to_numpy()
    _, first, number = np.unique(key, return_index=True, return_counts=False, return_inverse=True)
    return number, [c.take(pa.array(first)).to_pylist() for c in columns]


def _frequency_task(batches):
    """lang, term, n: in how many of the chunk's texts of that language a term stands."""
    for batch in batches:
        for words in text_chunks(batch.column(1), CHUNK, LETTERS):
            if not len(words.starts):
                continue
            spelled, text = _terms(words)
            size = len(spelled.dictionary)
            seen = np.unique(text * np.int64(size) + spelled.indices.to_numpy())
            number, (langs,) = _codes([batch.column(0).slice(words.lo, words.hi - words.lo)])
            key, n = np.unique(number[seen // size] * np.int64(size) + seen % size, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(key // size)),
                 spelled.dictionary.take(pa.array(key % size)).cast(pa.binary()), pa.array(n, pa.int64())], ["lang", "term", "n"])


def vocabulary(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term (binary), ordinal (from 0 in each language, by bytes): staged."""
    counts = texts.select("lang", "text").mapInArrow(_frequency_task, "lang string, term binary, n long") \
                  .groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = stage(counts.filter(F.col("n") >= min_docs).select("lang", "term"), "source-terms")
    return stage(group_row_number(kept, ["lang"], ["term"], "r").select("lang", "term", (F.col("r") - 1).alias("ordinal")),
                 "source-vocabulary")


def _bucket(term: Column | str, n: Column) -> Column:
    return F.pmod(F.xxhash64(term), n)


def _build_task(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("ordinal")
    blob = Transducer.build(frame["term"]).to_bytes()
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "bucket": frame["bucket"].iloc[:1], "blob": [blob],
                         "ordinals": [frame["ordinal"].to_numpy(np.int64).tobytes()]})


def transducers(vocab: DataFrame, buckets: Column) -> DataFrame:
    """lang, bucket, blob, ordinals: a transducer for each bucket of a language, and the ordinals of its words."""
    rows = vocab.withColumn("bucket", _bucket("term", buckets))
    return rows.groupBy("lang", "bucket").applyInPandas(_build_task, "lang string, bucket long, blob binary, ordinals binary")


class _Sums:
    """Counts by (group, ordinal) of one task, sent when there are ``HELD`` of them."""

    def __init__(self):
        self.clear()

    def number(self, langs: list[str], sources: list[str]) -> np.ndarray:
        return np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources)], dtype=np.int64)

    def add(self, group: np.ndarray, ordinal: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(group << np.int64(40) | ordinal)
        self.counts.append(n)
        self.size += len(n)

    def clear(self) -> None:
        self.groups, self.keys, self.counts, self.size = {}, [], [], 0

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, slot = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.zeros(len(keys), dtype=np.int64)
            np.add.at(counts, slot, np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def batches(self, last: bool):
        if self.size <= HELD and not last:
            return                     # not merged yet
        self.merge()
        if self.keys and (last or self.size > HELD // 2):
            key = self.keys[0]
            langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
            group = pa.array(key >> np.int64(40))
            yield pa.RecordBatch.from_arrays(
                [langs.take(group), sources.take(group), pa.array(key & np.int64((1 << 40) - 1)), pa.array(self.counts[0])],
                ["lang", "source", "ordinal", "n"])
            self.clear()


def _lookup(transducer: Transducer, spelled: pa.Array) -> np.ndarray:
    """Ordinals of a dictionary's words in a transducer."""
    offsets = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset: spelled.offset + len(spelled) + 1]
    raw = spelled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return transducer.ordinals(data, offsets[:-1], np.diff(offsets))


def _recount_task(blobs: dict[str, bytes]):
    """Texts streamed through the transducer of their language."""
    def run(batches):
        machines = {lang: Transducer.from_bytes(blob) for lang, blob in blobs.items()}
        sums = _Sums()
        for batch in batches:
            for words in text_chunks(batch.column(2), CHUNK, LETTERS):
                if not len(words.starts):
                    continue
                spelled, text = _terms(words)
                codes, size = spelled.indices.to_numpy(), np.int64(len(spelled.dictionary))
                number, (langs, sources) = _codes([batch.column(i).slice(words.lo, words.hi - words.lo) for i in (0, 1)])
                key, n = np.unique(number[text] * size + codes, return_counts=True)
                group, code = key // size, key % size
                ordinal = np.full(len(key), -1, dtype=np.int64)
                of = np.array(langs, dtype=object)[group]
                for lang in set(langs):
                    if lang in machines:
                        own = np.flatnonzero(of == lang)
                        used, back = np.unique(code[own], return_inverse=True)
                        ordinal[own] = _lookup(machines[lang], spelled.dictionary.take(pa.array(used)))[back]
                known = ordinal >= 0
                sums.add(sums.number(langs, sources)[group[known]], ordinal[known], n[known])
                yield from sums.batches(last=False)
        yield from sums.batches(last=True)
    return run


def _terms_task(batches):
    """lang, source, term, n of each chunk."""
    for batch in batches:
        for words in text_chunks(batch.column(2), CHUNK, LETTERS):
            if not len(words.starts):
                continue
            spelled, text = _terms(words)
            size = np.int64(len(spelled.dictionary))
            number, (langs, sources) = _codes([batch.column(i).slice(words.lo, words.hi - words.lo) for i in (0, 1)])
            key, n = np.unique(number[text] * size + spelled.indices.to_numpy(), return_counts=True)
            group = pa.array(key // size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(group), pa.array(sources, pa.string()).take(group),
                 spelled.dictionary.take(pa.array(key % size)).cast(pa.binary()), pa.array(n, pa.int64())],
                ["lang", "source", "term", "n"])


def _bucket_task(batches):
    """Rows of one bucket after another, its transducer first."""
    machine = lang = ordinals = None
    for batch in batches:
        blobs = batch.column(4)
        cuts = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(blobs)]):
            if lo < len(blobs) and blobs[lo].is_valid:
                if lo >= hi:
                    continue
                machine, lang = Transducer.from_bytes(blobs[lo].as_py()), batch.column(0)[lo]
                ordinals = np.frombuffer(batch.column(5)[lo].as_py(), np.int64)
                lo += 1
            if machine is None or lo >= hi:
                continue
            part = batch.slice(lo, hi - lo)
            # a bucket without kept terms has no transducer; the one before knows none of its terms, but
            # for another language's
            found = _lookup(machine, part.column(2).cast(pa.large_binary()))
            known = np.flatnonzero((found >= 0) & pc.equal(part.column(0), lang).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(known)), part.column(1).take(pa.array(known)),
                 pa.array(ordinals[found[known]]), part.column(3).take(pa.array(known))], ["lang", "source", "ordinal", "n"])


def recount(texts: DataFrame, vocab: DataFrame, sizes: DataFrame, broadcast_terms: int = BROADCAST,
            bucket_terms: int = BUCKET) -> DataFrame:
    """lang, source, ordinal, n: occurrences of every kept term, from the texts streamed through the transducers.

    ``sizes``: lang, v and bytes, the terms of each language and what they take spelled out."""
    total, spelled = (x or 0 for x in sizes.agg(F.sum("v"), F.sum("bytes")).first())
    found = "lang string, source string, ordinal long, n long"
    if total <= broadcast_terms and spelled <= BROADCAST_BYTES:
        blobs = {r["lang"]: r["blob"] for r in transducers(vocab, F.lit(1)).select("lang", "blob").collect()}
        rows = texts.select("lang", "source", "text").mapInArrow(_recount_task(blobs), found)
        return rows.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
    buckets = sizes.select("lang", F.ceil(F.col("v") / bucket_terms).alias("buckets"))
    machines = transducers(vocab.join(buckets, "lang"), F.col("buckets"))
    rows = texts.select("lang", "source", "text").mapInArrow(_terms_task, "lang string, source string, term binary, n long") \
                .groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(buckets, "lang") \
                .select("lang", "source", "term", "n", _bucket("term", F.col("buckets")).alias("bucket"))
    none = F.lit(None)
    both = rows.select("lang", "source", "term", "n", none.cast("binary").alias("blob"), none.cast("binary").alias("ordinals"), "bucket") \
        .union(machines.select("lang", none.cast("string"), none.cast("binary"), none.cast("long"), "blob", "ordinals", "bucket"))
    dealt = both.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", F.col("blob").isNull())
    # the transducer stands before its bucket's rows; a bucket without one is told by its first row
    return dealt.select("lang", "source", "term", "n", "blob", "ordinals").mapInArrow(_bucket_task, found)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact."""
    wide = "decimal(38,0)"
    over = (count.cast(wide) + F.lit(5).cast("decimal(2,0)")).cast("decimal(27,0)") * F.lit(10 ** 9).cast("decimal(11,0)")
    under = (total.cast("decimal(20,0)") + 5 * terms.cast("decimal(20,0)")).cast("decimal(21,0)")
    return F.call_function("div", over, under) + 1


def _block_task(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of the differences of pairs of sources over a block of ordinals, for the task's own first sources.

    A row without an ordinal names a source, its share of a term that it lacks and the width of the block."""
    marks = frame[frame["ordinal"].isna()].sort_values("source")
    sources = marks["source"].to_numpy()
    own = np.flatnonzero((marks["tile"] == marks["of"]).to_numpy())
    width = int(marks["width"].iloc[0])
    shares = np.repeat(marks["share"].to_numpy(np.int64)[:, None], width, axis=1)
    rows = frame[frame["ordinal"].notna()]
    place = {s: i for i, s in enumerate(sources)}
    at = rows["source"].map(place).to_numpy(np.int64)
    shares[at, rows["ordinal"].to_numpy(np.int64)] = rows["share"].to_numpy(np.int64)
    sums = np.array([np.abs(shares - shares[i]).sum(axis=1) for i in own], dtype=np.int64).reshape(len(own), len(sources))
    a, b = np.nonzero(own[:, None] != np.arange(len(sources)))
    return pd.DataFrame({"lang": marks["lang"].iloc[0], "source": sources[own[a]], "item": sources[b], "value": sums[a, b]})


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS, top: int = TOP, broadcast_terms: int = BROADCAST, bucket_terms: int = BUCKET) -> DataFrame:
    """lang, source, part, item, value, rank: how far each pair of sources of a language differs (``pair``) and
    the terms that a source uses more than its language (``term``, the first ``top``)."""
    blank = F.lit("")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(k)
                          for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    vocab = vocabulary(texts, min_docs)
    groups = stage(texts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")), "source-groups")
    v = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.octet_length("term")).alias("bytes"))
    counts = stage(recount(texts, vocab, v, broadcast_terms, bucket_terms), "source-counts")
    v = v.drop("bytes")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s")).join(v, "lang", "left").fillna(0, ["v"])
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang") \
                   .select("lang", "source", "v", "s", F.coalesce("total", F.lit(0)).alias("total"))
    p = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "ordinal", "n", "s", _share(F.col("n"), F.col("total"), F.col("v")).alias("share"))

    # blocks of ordinals of CELLS numbers; every block holds a row for each source
    width = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("s"))).cast("bigint")
    none = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(F.lit(0))
    last = F.greatest(F.lit(1), F.ceil(F.col("v") / width)).cast("bigint") - 1
    tiles = F.ceil(F.col("s") / F.greatest(F.lit(1), F.floor(F.lit(PAIRS) / F.col("s")))).cast("bigint")
    tile = F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)).alias("tile")
    marks = groups.select("lang", "source", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"), "v", "s",
                          width.alias("w"), none.cast("bigint").alias("share")) \
                  .select("lang", "block", tile, "source", F.lit(None).cast("double").alias("ordinal"), "share",
                          F.least(F.col("w"), F.col("v") - F.col("block") * F.col("w")).alias("width"),
                          F.pmod(F.xxhash64("source"), tiles).alias("of"))
    nothing = F.lit(None).cast("bigint")
    rows = p.select("lang", F.floor(F.col("ordinal") / width).cast("bigint").alias("block"), tile, "source",
                    F.pmod("ordinal", width).cast("double").alias("ordinal"), F.col("share").cast("bigint").alias("share"),
                    nothing.alias("width"), nothing.alias("of"))
    pairs = marks.union(rows).groupBy("lang", "block", "tile").applyInPandas(
        _block_task, "lang string, source string, item string, value long") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    whole = whole.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang").join(v, "lang") \
                 .select("lang", "ordinal", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    best = p.join(whole, ["lang", "ordinal"]).filter("share > q") \
            .select("lang", "source", "ordinal", (F.col("share") - F.col("q")).cast("bigint").alias("value")) \
            .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    terms = best.join(vocab, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"),
                                                         F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
