"""Hashed maximum-entropy language model: scores of whole texts.

Tokens are runs of characters other than ASCII white space, A-Z in lower case,
and one end token a text.  The model is a softmax over ``CLASSES`` word classes
(by a word's first two bytes; the end has its own) and, inside the class, a
softmax over its ``SLOTS`` - 1 most frequent words and one slot for all others;
inside that slot words share by their counts, with half a count for each known
word and for any unknown one.  So the probabilities of all words sum to one
after every history.  Both softmaxes add a bias, the logarithm of exact counts,
and one hashed row for each feature: the word before (2-gram), the two words
before (3-gram) and the second last word alone (skip).

Training covers all allowed texts once, in ``ROUNDS`` rounds of distributed
gradient updates: in each round every task starts from the weights so far, takes
mini-batch steps (AdaGrad by row) through its own texts and sends what each row
gained; gains are averaged by how often a task met the row, in streams by block
of rows.  Only the tables of fixed size come to the driver.

Word counts are exact and stay distributed.  The most frequent words (at most
``FREQUENT``, none over ``MAX_BYTES``) travel with the model; of the others each
document's occurrences meet the counts in a join.

Null and empty texts have the end token alone.  Null ids are held to be allowed
where ``allowed`` is null.  Repeated rows are counted and scored one by one.
Without allowed texts every class is alike and a base score is 0.  An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage
from .wordnum import Words, mix, text_chunks

CLASSES = 32
SLOTS = 16
CLASS_ROWS = 1 << 13      # hashed rows that add to the classes' logits
SLOT_ROWS = 1 << 14       # hashed rows that add to the slots' logits
FEATURES = 3
ROUNDS = 2
BATCH = 8192              # tokens of one training step
BLOCK = 8192              # tokens scored at once
RATE = 0.15
LIMIT = 8.0               # no weight goes beyond: sums of logits stay within what exp() holds
CALM = 1.0                # squared gradient that every row begins with: rows seldom met move little
FREQUENT = 400_000        # words whose counts travel with the model
MAX_BYTES = 64            # of such a word
BINS = 8                  # of a doubling of counts, where the cut for them is looked for
ROW_BLOCK = 256           # rows sent together
MERGERS = 24              # tasks that average the gains
_END = b"\xff"            # no byte of UTF-8: the end token
_LN10 = math.log(10)


def _token_chunks(column: pa.Array):
    """Chunks of words with an end token after every text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    none = pa.scalar(b"", pa.binary())
    whole = pc.fill_null(column.cast(pa.binary()), b"")
    yield from text_chunks(pc.binary_join_element_wise(whole, pa.scalar(b" " + _END, pa.binary()), none))


def _classes(words: Words) -> np.ndarray:
    first = words.data[words.starts].astype(np.uint64)
    upper = (first >= 65) & (first <= 90)
    first[upper] += np.uint64(32)
    at = np.minimum(words.starts + 1, len(words.data) - 1)
    second = words.data[at].astype(np.uint64)
    second[(second >= 65) & (second <= 90)] += np.uint64(32)
    second[words.ends - words.starts < 2] = 0
    out = (mix(first + second * np.uint64(256)) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    out[first == _END[0]] = 0
    return out


def _spelled(words: Words) -> pa.DictionaryArray:
    """The words themselves, lower case, as codes of a dictionary of the chunk."""
    sizes = words.ends - words.starts
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.ones(starts[-1], dtype=np.int64)           # steps from byte to byte
    at[0] = words.starts[0]
    at[starts[1:-1]] = words.starts[1:] - words.ends[:-1] + 1
    data = words.data[np.cumsum(at)]
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(starts.astype(np.int64)),
                                                                 pa.py_buffer(data)]).dictionary_encode()


def _first(codes: np.ndarray, size: int) -> np.ndarray:
    """Where each code stands first."""
    out = np.empty(size, dtype=np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


def _features(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Feature hashes (FEATURES, tokens); before a text's first token stand constants."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    last, second = (np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), hashes[:-k]])[:len(hashes)], np.uint64(k))
                    for k in (1, 2))
    return np.stack([mix(last + np.uint64(11)), mix(last * np.uint64(3) + mix(second + np.uint64(5))),
                     mix(second + np.uint64(77))])


@dataclass
class Model:
    class_bias: np.ndarray     # (CLASSES)
    slot_bias: np.ndarray      # (CLASSES, SLOTS); no word: far below all others
    class_rows: np.ndarray     # (CLASS_ROWS, CLASSES)
    slot_rows: np.ndarray      # (SLOT_ROWS, SLOTS)
    known: np.ndarray          # rising hashes of the words that have a slot
    slot: np.ndarray           # their slots
    rest_total: np.ndarray     # of each class: occurrences and number of the words in its common slot
    rest_types: np.ndarray
    train_tokens: int
    types: int
    frequent: pa.Array         # most frequent words, by rising hash, with their hashes and counts
    frequent_hashes: np.ndarray
    frequent_counts: np.ndarray
    cut: int                   # words in fewer bins of counts, or over MAX_BYTES, are not among them

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.slot[at], 0)

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent ones, found by hash and confirmed by spelling; -1: not there."""
        if not len(self.frequent):
            return np.full(len(words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.frequent_hashes, hashes), len(self.frequent) - 1)
        spelled = pc.equal(words, self.frequent.take(pa.array(at))).to_numpy(zero_copy_only=False)
        return np.where(spelled, at, -1)

    def places(self, features: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each feature for the class and, with the class, for the slot."""
        own = classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((features & np.uint64(CLASS_ROWS - 1)).astype(np.int64),
                (mix(features + own) & np.uint64(SLOT_ROWS - 1)).astype(np.int64))

    def logits(self, for_class: np.ndarray, for_slot: np.ndarray, classes: np.ndarray):
        a = np.take(self.class_rows, for_class[0], axis=0, mode="clip")
        b = np.take(self.slot_rows, for_slot[0], axis=0, mode="clip")
        for k in range(1, FEATURES):
            a += np.take(self.class_rows, for_class[k], axis=0, mode="clip")
            b += np.take(self.slot_rows, for_slot[k], axis=0, mode="clip")
        return a + self.class_bias, b + np.take(self.slot_bias, classes, axis=0, mode="clip")

    def log10(self, features: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """log10 P(class, slot | history) of every token, in blocks."""
        out = np.empty(len(classes))
        ones = np.ones(CLASSES, np.float32), np.ones(SLOTS, np.float32)
        for lo in range(0, len(classes), BLOCK):
            part = slice(lo, lo + BLOCK)
            a, b = self.logits(*self.places(features[:, part], classes[part]), classes[part])
            i = np.arange(len(a))
            out[part] = a[i, classes[part]] + b[i, slots[part]]
            out[part] -= np.log((np.exp(a, out=a) @ ones[0]) * (np.exp(b, out=b) @ ones[1]))
        return out / _LN10


class _Steps:
    """Mini-batch training steps of one task."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = [model.class_rows.copy(), model.slot_rows.copy()]
        self.begin = [model.class_rows, model.slot_rows]
        self.squares = [np.full(len(t), CALM, np.float32) for t in self.tables]
        self.met = [np.zeros(len(t)) for t in self.tables]
        model.class_rows, model.slot_rows = self.tables

    def step(self, features: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> None:
        rows = self.model.places(features, classes)
        i = np.arange(len(classes))
        for k, (logits, want) in enumerate(zip(self.model.logits(*rows, classes), (classes, slots))):
            miss = np.exp(logits)
            miss /= miss.sum(axis=1, keepdims=True)
            miss[i, want] -= 1
            at, n = rows[k].ravel(), len(self.tables[k])
            miss = np.ascontiguousarray(miss.T, dtype=np.float64)
            # sums by row, one outcome at a time
            gradient = np.stack([np.bincount(at, np.tile(x, FEATURES), n) for x in miss]).astype(np.float32)
            self.squares[k] += (gradient * gradient).mean(axis=0)
            self.tables[k] -= RATE * (gradient / np.sqrt(self.squares[k])).T
            np.clip(self.tables[k], -LIMIT, LIMIT, out=self.tables[k])
            self.met[k] += np.bincount(at, minlength=n)

    def gains(self):
        """(block, times met, gain) of the blocks of rows that were met."""
        block = 0
        for now, was, met in zip(self.tables, self.begin, self.met):
            for lo in range(0, len(now), ROW_BLOCK):
                part = slice(lo, lo + ROW_BLOCK)
                if met[part].any():
                    yield block, met[part].tobytes(), (now[part] - was[part]).astype(np.float16).tobytes()
                block += 1


def _train_task(model: Model):
    def run(batches):
        steps = _Steps(model)
        for batch in batches:
            for words in _token_chunks(batch.column(0)):
                hashes, classes = words.hashes(lower=True), _classes(words)
                features, slots = _features(hashes, words.counts()), model.slots(hashes)
                for lo in range(0, len(hashes), BATCH):
                    part = slice(lo, lo + BATCH)
                    steps.step(features[:, part], classes[part], slots[part])
        rows = list(steps.gains())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                             ["block", "met", "gain"])
    return run


def _merge_task(batches):
    """Sums by block of the gains times how often they were met; one block at a time in memory."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, met, gain in zip(*(c.to_pylist() for c in batch.columns)):
            met = np.frombuffer(met, dtype=np.float64)
            gain = np.frombuffer(gain, dtype=np.float16).reshape(len(met), -1).astype(np.float64) * met[:, None]
            if block in sums:
                sums[block][0] += met
                sums[block][1] += gain
            else:
                sums[block] = [met.copy(), gain]
    for block, (met, gain) in sums.items():
        mean = gain / np.maximum(met, 1)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())],
                                         ["block", "gain"])


def _count_task(batches):
    for batch in batches:
        for words in _token_chunks(batch.column(0)):
            spelled = _spelled(words)
            codes = spelled.indices.to_numpy()
            first = _first(codes, len(spelled.dictionary))
            yield pa.RecordBatch.from_arrays(
                [spelled.dictionary.cast(pa.binary()), pa.array(_classes(words)[first], pa.int32()),
                 pa.array(words.hashes(lower=True)[first].view(np.int64), pa.int64()),
                 pa.array(np.bincount(codes, minlength=len(first)), pa.int64())], ["token", "class", "hash", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary), class, hash, c: exact counts of all tokens, the end included."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")) \
               .mapInArrow(_count_task, "token binary, class int, hash long, n long")
    return rows.groupBy("token", "class", "hash").agg(F.sum("n").alias("c"))


def _bin() -> Column:
    """Which part of a doubling a count lies in."""
    return F.floor(F.log2("c") * BINS).cast("int")


def _start(counts: DataFrame) -> Model:
    """The model before training: biases from the counts, no row learnt."""
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(F.col("c").desc(), "token"))) \
                .filter(F.col("r") < SLOTS).select("class", "r", "hash", "c").collect()
    totals, types = np.zeros(CLASSES, dtype=object), np.zeros(CLASSES, dtype=object)
    for r in counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        totals[r["class"]], types[r["class"]] = int(r["n"]), int(r["v"])
    weight = np.zeros((CLASSES, SLOTS))
    rest, rest_types = totals.copy(), types.copy()
    for r in top:
        weight[r["class"], r["r"]] = r["c"]
        rest[r["class"]] -= r["c"]
        rest_types[r["class"]] -= 1
    weight[:, 0] = rest.astype(float) + 0.5
    share = weight / weight.sum(axis=1, keepdims=True)
    slot_bias = np.where(weight > 0, np.log(np.maximum(share, 1e-300)), -1e9).astype(np.float32)
    class_bias = np.log((totals.astype(float) + 0.5) / (float(totals.sum()) + 0.5 * CLASSES)).astype(np.float32)
    hashes = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    # the cut: whole bins of counts, from the highest down, while they fit
    short = counts.filter(F.octet_length("token") <= MAX_BYTES)
    cut, room = 1 << 30, FREQUENT
    for r in sorted(short.groupBy(_bin().alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        room -= r["count"]
        if room < 0:
            break
        cut = r["bin"]
    often = short.filter(_bin() >= cut).select("token", "hash", "c").toArrow()
    often_hashes = often.column(1).to_numpy().view(np.uint64)
    rising = np.argsort(often_hashes)
    if len(np.unique(often_hashes)) < len(rising):      # two of one hash: all words meet their counts in the join
        cut, rising = 1 << 30, rising[:0]
    return Model(class_bias, slot_bias, np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((SLOT_ROWS, SLOTS), np.float32),
                 hashes[order], np.array([r["r"] for r in top], dtype=np.int64)[order], rest.astype(float),
                 rest_types.astype(float), int(totals.sum()), int(types.sum()),
                 often.column(0).combine_chunks().cast(pa.large_binary()).take(pa.array(rising)), often_hashes[rising],
                 often.column(2).to_numpy()[rising], cut)


def fit(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
        rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The trained model and the staged counts it belongs to; learns from ``allowed`` rows only."""
    train = docs.filter(F.coalesce(allowed, F.lit(True)))
    counts = stage(word_counts(train, text_col), "maxent-counts")
    model = _start(counts)
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(rounds))
    for r in range(rounds):
        gains = train.filter(part == r).select(F.col(text_col).cast("string").alias("text")) \
                     .mapInArrow(_train_task(model), "block int, met binary, gain binary")
        for row in gains.repartition(MERGERS, "block").mapInArrow(_merge_task, "block int, gain binary").collect():
            table, at = model.class_rows, row["block"] * ROW_BLOCK
            if at >= CLASS_ROWS:
                table, at = model.slot_rows, at - CLASS_ROWS
            table[at: at + ROW_BLOCK] += np.frombuffer(row["gain"], dtype=np.float32).reshape(ROW_BLOCK, -1)
        for table in (model.class_rows, model.slot_rows):
            np.clip(table, -LIMIT, LIMIT, out=table)
    return model, counts


def _score_task(model: Model):
    unit = model.train_tokens + 0.5 * (model.types + 1)

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for words in _token_chunks(batch.column(1)):
                counts, spelled = words.counts(), _spelled(words)
                codes, hashes, classes = spelled.indices.to_numpy(), words.hashes(lower=True), _classes(words)
                seen = model.find(spelled.dictionary, hashes[_first(codes, len(spelled.dictionary))])
                slots, begin = model.slots(hashes), np.cumsum(counts) - counts
                if len(model.frequent_counts):
                    c = np.where(seen >= 0, model.frequent_counts[seen], 0)[codes].astype(np.float64)
                else:
                    c = np.zeros(len(codes))
                met = (seen >= 0)[codes]
                score = model.log10(_features(hashes, counts), classes, slots)
                other = met & (slots == 0)
                score[other] += np.log10((c[other] + 0.5) / (model.rest_total + 0.5 * (model.rest_types + 1))[classes[other]])
                base = np.where(met, np.log10((c + 0.5) / unit), 0.0)
                of = number + np.arange(len(counts))
                number += len(counts)
                docs = np.repeat(np.arange(len(counts)), counts)
                # the words that are not among the frequent ones, once a document
                away = np.flatnonzero(~met)
                key, at, n = np.unique(docs[away] * np.int64(len(seen)) + codes[away], return_index=True, return_counts=True)
                at = away[at]
                own = pa.array([b"%b%d" % (_END * 2, i) for i in of], pa.binary())   # a key that no token has
                both = len(counts) + len(at)
                first = np.arange(both) < len(counts)
                fill = np.zeros(len(at))

                def joined(mine, theirs, kind):
                    return pa.array(np.concatenate([mine, theirs]), kind)

                yield pa.RecordBatch.from_arrays([
                    joined(of, of[docs[at]], pa.int64()),
                    pa.concat_arrays([ids.slice(words.lo, len(counts)), pa.nulls(len(at), ids.type)]),
                    pa.concat_arrays([own, spelled.dictionary.take(pa.array(codes[at])).cast(pa.binary())]),
                    joined(np.zeros(len(counts), np.int64), classes[at], pa.int32()),
                    joined(np.zeros(len(counts), np.int64), n, pa.int64()),
                    joined(np.zeros(len(counts), np.int64), n * (slots[at] == 0), pa.int64()),
                    joined(counts, np.zeros(len(at), np.int64), pa.int64()),
                    joined(np.add.reduceat(met.astype(np.int64), begin), np.zeros(len(at), np.int64), pa.int64()),
                    joined(np.add.reduceat(base, begin), fill, pa.float64()),
                    joined(np.add.reduceat(score, begin), fill, pa.float64()),
                    pa.array(first, pa.bool_()),
                ], ["uid", "id", "token", "class", "n", "n_rest", "n_tokens", "n_known", "base", "score", "own"])
    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, base_score, score`` of every row.

    Every task sends a row for each document and one for each of its words that
    is not among the frequent ones; those meet the counts of such words, and a
    document's rows are summed."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _score_task(model), f"uid long, id {kind}, token binary, class int, n long, n_rest long, n_tokens long, "
                            "n_known long, base double, score double, own boolean")
    rare = counts.filter((_bin() < model.cut) | (F.octet_length("token") > MAX_BYTES)).select("token", "c")
    c = F.coalesce(F.col("c"), F.lit(0))
    unit = F.lit(model.train_tokens + 0.5 * (model.types + 1))
    rest = F.element_at(F.array(*[F.lit(float(x)) for x in model.rest_total + 0.5 * (model.rest_types + 1)]), F.col("class") + 1)
    met = rows.join(rare, "token", "left").select(
        "uid", "id", "own", "n_tokens",
        F.when(F.col("own"), F.col("n_known")).when(c > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"),
        F.when(F.col("own"), F.col("base")).otherwise(F.col("n") * F.log10((c + 0.5) / unit)).alias("base"),
        (F.col("score") + F.when(F.col("n_rest") > 0, F.col("n_rest") * F.log10((c + 0.5) / rest)).otherwise(F.lit(0.0))).alias("score"))
    return met.groupBy("uid").agg(
        F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("uid")
