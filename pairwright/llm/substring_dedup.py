"""Removal of repeated passages: every 20-word window but its first occurrence.

1. *Phrases.* Of the thirteen 8-word phrases in a window the one with the
   smallest hash is kept (a repeated window always keeps a repeated phrase).
   Hashes are counted over the corpus; those kept at two places or more come
   back with their words.
2. *Confirmation.* Words, not hashes, are counted: a phrase recurs if its eight
   words are kept at two places or more.
3. *Automata.* Texts are dealt into shards of about a megabyte.  A shard's
   dictionary holds the confirmed phrases of all its texts; it is compiled into
   one Aho-Corasick automaton over word numbers, and every text of the shard is
   streamed through it.  What it locates decides: a window goes on only if its
   kept phrase is located there, word for word.
4. *First occurrences.* The smallest (document, start) of each window is a
   partial minimum of one packed number.  It goes back to its document alone.
5. *Removal.* The texts are streamed once more; a located window that is not a
   first occurrence is removed, together with all words it covers.

Equal texts are one class: the smallest id of each takes part above, the others
repeat all their windows.  Text crosses the network compressed, once for each
run of the automata, dealt by id and text so that no group of copies meets.  All
dictionaries together grow with the corpus, and a text is streamed by one shard.

Phrases are compared by their words, windows by 96 bits of two hashes, texts by
128 bits of two hashes.  A text of more than 67 million words raises.

Documents come in the order of their ids, nulls last, then by text hash.  Rows
that repeat both id and text are one document and get the same result.  Null
text has no words; fewer than 20 words are never removed.  An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bloom import bloom_filter, may_hold
from ..operators.ordering import global_row_number
from .shared import delete, stage, stage_at
from .wordnum import Words, mix, text_chunks, window_hashes

WINDOW = 20
PHRASE = 8
SHARD_BYTES = 1 << 20    # text of a shard, about
SLICE_TEXTS = 512        # texts at most that are unpacked at once
START_BITS = 26          # words of a document that can be numbered: 67 million
_SPAN = WINDOW - PHRASE + 1
_OTHER = np.uint64(0xA0761D6478BD642F)
_PHRASES, _CLASSES, _TEXTS = 0, 1, 2      # rows of a shard, in this order


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """Minimum or maximum (``pick``) of every run of ``size`` values."""
    width = 1
    while width * 2 <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return pick(values[:-rest], values[rest:]) if rest else values


def _kept_phrases(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes, each window's smallest one, and which windows lie in one document."""
    phrases = window_hashes(words, PHRASE)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return phrases, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    return phrases, _sliding(phrases, _SPAN, np.minimum), doc[:n] == doc[WINDOW - 1:]


def _kept_places(phrases: np.ndarray, low: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places of the phrases that some window keeps: equal to the largest minimum around them."""
    if not len(low):
        return np.zeros(0, dtype=np.int64)
    edge = np.zeros(_SPAN - 1, dtype=np.uint64)
    around = _sliding(np.concatenate([edge, np.where(whole, low, np.uint64(0)), edge]), _SPAN, np.maximum)
    return np.flatnonzero(around == phrases)


def _documents(chunk: Words) -> np.ndarray:
    return np.repeat(np.arange(chunk.hi - chunk.lo), chunk.counts())


def _odd_gaps(chunk: Words) -> np.ndarray:
    """How many of the first n words are followed by anything but one space and a word (len words + 1)."""
    odd = np.zeros(len(chunk.starts) + 1, dtype=np.int64)
    gap = np.ones(len(chunk.starts), dtype=bool)
    gap[:-1] = (chunk.starts[1:] - chunk.ends[:-1] != 1) | (chunk.data[chunk.ends[:-1]] != 0x20) if len(gap) > 1 else True
    np.cumsum(gap, out=odd[1:])
    return odd


def _spelled(chunk: Words, places: np.ndarray) -> list[bytes]:
    """The words of the phrases at ``places``, with one space between two."""
    raw, odd = chunk.data.tobytes(), _odd_gaps(chunk)
    plain = odd[places + PHRASE - 1] == odd[places]
    bounds = zip(chunk.starts[places].tolist(), chunk.ends[places + PHRASE - 1].tolist(), plain.tolist())
    return [raw[a:b] if one else b" ".join(raw[a:b].split()) for a, b, one in bounds]


def phrases(docs: DataFrame, spelled: bool = False) -> DataFrame:
    """``phrase, k, n`` (and ``words``): the kept phrases of every text ``(k, text)``, how often each is kept."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for chunk in text_chunks(batch.column(1)):
                doc = _documents(chunk)
                values, low, whole = _kept_phrases(chunk.hashes(), doc)
                at = _kept_places(values, low, whole)
                if not len(at):
                    continue
                if spelled:           # a row for each place: equal hashes may be other words
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values[at].view(np.int64)), pa.array(keys[chunk.lo + doc[at]]),
                         pa.array(np.ones(len(at), np.int64)), pa.array(_spelled(chunk, at), pa.binary())], names)
                    continue
                order = np.lexsort((values[at], doc[at]))
                value, owner = values[at][order], doc[at][order]
                new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[new].view(np.int64)), pa.array(keys[chunk.lo + owner[new]]),
                     pa.array(np.diff(np.append(new, len(value))), pa.int64())], names)

    names = ["phrase", "k", "n"] + ["words"] * spelled
    return docs.mapInArrow(run, "phrase long, k long, n long" + ", words binary" * spelled)


class _Shard:
    """A shard's dictionary as an automaton, and what is known of its texts."""

    def __init__(self) -> None:
        self.entries: dict[tuple, tuple] = {}     # numbers of eight words -> the phrases that have them
        self.classes: dict[tuple, tuple] = {}     # (k, k2, i) -> number, starts of first windows, whether a copy
        self.automaton = None

    def add(self, words: pa.Array) -> None:
        spelled = words.to_pylist()
        for chunk in text_chunks(words):
            numbers = _numbers(chunk.hashes()).reshape(-1, PHRASE).tolist()
            for key, entry in zip(map(tuple, numbers), spelled[chunk.lo: chunk.hi]):
                self.entries[key] = self.entries.get(key, ()) + (entry,)

    def know(self, rows: pa.RecordBatch) -> None:
        what = [rows.column(c).to_pylist() for c in ("k", "k2", "i", "number", "firsts", "copy")]
        for k, k2, i, number, firsts, copy in zip(*what):
            self.classes[k, k2, i] = (number, firsts, copy)

    def locate(self, chunk: Words, hashes: np.ndarray) -> np.ndarray:
        """Whether a phrase of the dictionary stands at each word: found by word numbers, confirmed by the words."""
        import ahocorasick

        found = np.zeros(len(hashes), dtype=bool)
        if self.automaton is None and self.entries:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, entries in self.entries.items():
                self.automaton.add_word(key, entries)
            self.automaton.make_automaton()
            self.entries = {}
        if self.automaton is not None and len(hashes):
            hits = list(self.automaton.iter(tuple(_numbers(hashes).tolist())))
            if hits:
                places = np.array([end for end, _ in hits]) - PHRASE + 1
                found[places] = [words in entries for words, (_, entries) in zip(_spelled(chunk, places), hits)]
        return found


def _numbers(hashes: np.ndarray) -> np.ndarray:
    """Words as letters of an automaton: 32 bits of their hashes."""
    return hashes & np.uint64(0xFFFFFFFF)


def _streamed(batches):
    """``(shard, slice of its texts)``: a shard's rows are its phrases, then its classes, then its texts."""
    number, shard = None, None
    for batch in batches:
        numbers, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = (np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if lo == hi:
                continue
            if number is None or numbers[lo] != number:
                number, shard = numbers[lo], _Shard()
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == _PHRASES:
                shard.add(part.column("body"))
            elif kinds[lo] == _CLASSES:
                shard.know(part)
            else:
                for at in range(0, part.num_rows, SLICE_TEXTS):
                    yield shard, part.slice(at, SLICE_TEXTS)


def _keys(rows: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[rows.column(c).to_pylist() for c in ("k", "k2", "i")]))


def _windows(chunk: Words, shard: _Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a chunk whose kept phrase the automaton locates: whether, word hashes, and document of each word."""
    hashes, doc = chunk.hashes(), _documents(chunk)
    values, low, whole = _kept_phrases(hashes, doc)
    if not len(low):
        return whole, hashes, doc
    found = shard.locate(chunk, hashes)[: len(values)]
    if not found.any():
        return found[: len(low)], hashes, doc
    located = np.where(found, values, np.uint64(0xFFFFFFFFFFFFFFFF))
    return whole & (_sliding(located, _SPAN, np.minimum) == low), hashes, doc


def _texts(column: pa.Array) -> pa.Array:
    whole = zstandard.ZstdDecompressor().decompress
    return pa.array([whole(x) if x else b"" for x in column.to_pylist()], pa.binary())


def _packed_text(text: Column) -> Column:
    """The text's bytes, compressed (none: null)."""

    @F.arrow_udf("binary")
    def udf(column: pa.Array) -> pa.Array:
        packed = zstandard.ZstdCompressor(level=1).compress
        return pa.array([packed(x) if x else None for x in column.cast(pa.binary()).to_pylist()], pa.binary())

    return udf(text)


def windows(rows: DataFrame) -> DataFrame:
    """``h, h2, at`` (document number and start, packed) of every window that may recur.

    ``rows``: shards, their classes being those that windows are looked for in.
    """
    def run(batches):
        for shard, part in _streamed(batches):
            known = [shard.classes.get(key) for key in _keys(part)]
            mine = [j for j, c in enumerate(known) if c is not None]
            if not mine:
                continue
            number = np.array([known[j][0] for j in mine], dtype=np.int64)
            raw = _texts(part.column("body").take(pa.array(mine)))
            for chunk in text_chunks(raw):
                most = int(chunk.counts().max())
                if most >> START_BITS:
                    raise ValueError(f"a text of {most} words is over {1 << START_BITS}")
                ok, words, doc = _windows(chunk, shard)
                i = np.flatnonzero(ok)
                if not len(i):
                    continue
                h = window_hashes(words, WINDOW)[i]
                other = (window_hashes(mix(words ^ _OTHER), WINDOW)[i] >> np.uint64(32)).astype(np.uint32)
                at = (number[chunk.lo + doc[i]] << START_BITS) | (i - chunk.first[doc[i]])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(other.view(np.int32)),
                                                  pa.array(at, pa.int64())], ["h", "h2", "at"])

    return rows.mapInArrow(run, "h long, h2 int, at long")


def _removal(rows: DataFrame, id_col: str, id_type: str, with_text: bool) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` and the kept text, if asked for."""

    def run(batches):
        for shard, part in _streamed(batches):
            raw = _texts(part.column("body"))
            known = [shard.classes.get(key, (None, None, False)) for key in _keys(part)]
            bodies = raw.to_pylist()
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for chunk in text_chunks(raw):
                ok, _, _ = _windows(chunk, shard)
                so_far = np.concatenate([[0], np.cumsum(ok)])
                odd = _odd_gaps(chunk)
                for d in range(chunk.hi - chunk.lo):
                    text, (_, firsts, copy) = bodies[chunk.lo + d], known[chunk.lo + d]
                    first, n = int(chunk.first[d]), int(chunk.first[d + 1] - chunk.first[d])
                    gone = None
                    if n >= WINDOW and copy:
                        gone = np.ones(n, dtype=bool)
                    elif n >= WINDOW and so_far[first + n - WINDOW + 1] > so_far[first]:
                        hit = ok[first: first + n - WINDOW + 1].copy()
                        if firsts:
                            hit[firsts] = False
                        step = np.zeros(n + 1, dtype=np.int64)
                        at = np.flatnonzero(hit)
                        step[at] += 1
                        step[at + WINDOW] -= 1
                        gone = np.cumsum(step)[:n] > 0
                    left = n
                    if gone is not None and gone.any():
                        words = [w for w, g in zip(text.split(), gone.tolist()) if not g]
                        left, body = len(words), b" ".join(words)
                    elif n and odd[first + n - 1] == odd[first] and chunk.ends[first + n - 1] - chunk.starts[first] == len(text):
                        body = text                 # one space between two words, and nothing else
                    else:
                        body = b" ".join(text.split())
                    n_words.append(n)
                    n_removed.append(n - left)
                    digests.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        kept_texts.append(body.decode("utf-8"))
            made = [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(digests, pa.string())]
            if with_text:
                made.append(pa.array(kept_texts, pa.string()))
            yield pa.RecordBatch.from_arrays(made, names)

    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = f"`{id_col}` {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.mapInArrow(run, schema)


def _dealt(dictionary: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of all shards, each shard's together and in order."""
    columns = ["shard", "kind", "id", "k", "k2", "i", "number", "body", "firsts", "copy"]
    parts = [dictionary.withColumn("kind", F.lit(_PHRASES)), classes.withColumn("kind", F.lit(_CLASSES)),
             texts.withColumn("kind", F.lit(_TEXTS))]
    types = dict(field for part in parts for field in part.dtypes)
    parts = [part.select(*[F.col(c) if c in part.columns else F.lit(None).cast(types[c]).alias(c) for c in columns])
             for part in parts]
    return parts[0].union(parts[1]).union(parts[2]).repartition("shard").sortWithinPartitions("shard", "kind")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    with_text: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_words, n_removed, kept_sha256`` (and ``kept_text``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"),
                       F.xxhash64(F.lit("other"), text).alias("k2"), text.alias("text"))
    # classes of equal texts, their first documents numbered in order
    owned = stage(rows.groupBy("id", "k", "k2").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")),
                  "repeats-documents")
    shards = max(1, -(-(owned.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))

    def placed(df: DataFrame, id_name: str) -> DataFrame:
        return df.withColumn("i", F.xxhash64(id_name)).withColumn(
            "shard", F.pmod(F.xxhash64("k", "k2", "i"), F.lit(shards)))

    first = owned.groupBy("k", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("f")) \
                 .select("k", "k2", F.col("f.none").alias("none"), F.col("f.id").alias("low"))
    first = stage(placed(global_row_number(first, ["none", "low", "k", "k2"], "number"), "low"), "repeats-classes")
    # recurring phrases, the words of those that may be, and each shard's dictionary of the confirmed ones
    hashed = phrases(rows.select("k", "text")).groupBy("phrase").agg(F.sum("n").alias("n")).filter("n > 1").select("phrase")
    hashed, hashed_at = stage_at(hashed, "repeats-phrases")
    bits, size = bloom_filter(hashed, ["phrase"], hashed.count())
    spelled = phrases(rows.select("k", "text"), spelled=True)
    maybe = spelled.join(F.broadcast(bits), may_hold(F.col("_bits"), size, [spelled["phrase"]]), "left_semi")
    local = maybe.join(first.select("k", "shard").hint("shuffle_hash"), "k").groupBy("shard", "words").agg(F.sum("n").alias("n"))
    local, local_at = stage_at(local, "repeats-spelled")
    confirmed = local.groupBy("words").agg(F.sum("n").alias("n")).filter("n > 1").select("words")
    dictionary = stage(local.join(confirmed.hint("shuffle_hash"), "words", "left_semi").select("shard", F.col("words").alias("body")),
                       "repeats-dictionary")
    delete(docs.sparkSession, hashed_at)
    delete(docs.sparkSession, local_at)
    # first occurrences of the windows that may recur
    texts = placed(rows.select("id", "k", "k2", _packed_text(F.col("text")).alias("body")), "id")
    none = F.lit(None).cast("array<int>").alias("firsts")
    at_first = first.select("shard", "k", "k2", "i", "number", none, F.lit(False).alias("copy"))
    mask = (1 << START_BITS) - 1
    firsts = windows(_dealt(dictionary, at_first, texts)).groupBy("h", "h2").agg(F.min("at").alias("at")) \
        .select(F.shiftright("at", START_BITS).alias("number"), F.col("at").bitwiseAND(F.lit(mask)).cast("int").alias("start")) \
        .groupBy("number").agg(F.collect_list("start").alias("firsts"))
    known = first.select("shard", "k", "k2", "i", "number").join(firsts, "number") \
                 .select("shard", "k", "k2", "i", "number", "firsts", F.lit(False).alias("copy"))
    copies = placed(owned, "id").join(first.select("k", "k2", "low"), ["k", "k2"]) \
        .filter(~F.col("id").eqNullSafe(F.col("low"))) \
        .select("shard", "k", "k2", "i", F.lit(None).cast("int").alias("number"), none, F.lit(True).alias("copy"))
    known = stage(known.union(copies), "repeats-known")
    return _removal(_dealt(dictionary, known, texts), id_col, docs.schema[id_col].dataType.simpleString(), with_text)
