"""Convolutional text classifier for toxicity, trained in numpy.

Words (runs of letters, digits and non-ASCII characters, A-Z in lower case) get
the sum of ``HASHES`` hashed embeddings, so two words share all their rows only
by a rare accident.  Filters of several widths slide over the whole text, each
keeps its maximum, and a logistic layer gives the score.  Thresholds are
calibrated by language on all labelled rows that training does not see: the
score itself depends on the text alone.

Training reads at most ``PER_CLASS`` labelled rows of each class (those with
the smallest hash of their id), less one in ``CALIBRATION``.  All other labelled
rows are scored in Spark and counted by language, label and bin of the score;
only these counts reach the driver.  Scoring is an Arrow function over every whole
text; the model of a few megabytes travels with it.

Null or empty text, and any text without a word: scored like a text of no
words.  Null labels, labels other than 0 and 1, and labels without a document
are left out; without examples of both classes every score is 0.  Repeated rows
are scored alike.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import stage
from .wordnum import ALNUM, text_chunks

PER_CLASS = 2500         # labelled rows of each class that training may read
BUCKETS = 1 << 14        # rows of each hashed embedding
HASHES = 3
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8              # of each width
EPOCHS = 5
MIN_TEXTS = 4            # of the sample, that hold a word that is learnt
LEAST_STEPS = 300        # of training, for small samples
BATCH = 50
CALIBRATION = 5          # one row in so many of those read sets thresholds, as all rows not read do
BINS = 50                # of scores, to a unit of the log-odds
BROADCAST_LABELS = 400_000   # labelled rows (16 bytes each) that may be broadcast
SHRINK = 100             # examples of its own that outweigh the threshold of all languages
PAD = HASHES * BUCKETS   # a row of zeros


def _rows(words: np.ndarray) -> np.ndarray:
    """Embedding rows of word hashes: (words, HASHES)."""
    return np.stack([((words >> np.uint64(16 * k + 3)) % np.uint64(BUCKETS)).astype(np.int32) + k * BUCKETS
                     for k in range(HASHES)], axis=1)


def _padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with padding after each text, and where each text begins."""
    pad = max(WIDTHS)
    begin = np.concatenate([[0], np.cumsum(counts + pad)])
    out = np.full((begin[-1], HASHES), PAD, dtype=np.int32)
    texts = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(rows)) + texts * pad] = rows
    return out, begin


def _across(begin: np.ndarray) -> np.ndarray:
    """Windows that begin in one text's padding and may reach into the next text: they belong to neither."""
    return np.concatenate([begin[1:-1] - k for k in range(1, max(WIDTHS))])


@dataclass
class Model:
    embedding: np.ndarray                 # (PAD + 1, DIM)
    filters: list[np.ndarray]             # of each width: (width, DIM, FILTERS)
    bias: np.ndarray                      # (widths * FILTERS)
    weights: np.ndarray
    intercept: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    trained: bool = True

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter, what each embedding row adds."""
        return [[(self.embedding @ w[j]).astype(np.float32) for j in range(len(w))] for w in self.filters]

    def pooled(self, rows: np.ndarray, begin: np.ndarray, tables) -> np.ndarray:
        """Maximum of every filter over each text, before the bias."""
        best = []
        n = len(rows) - max(WIDTHS) + 1
        across = _across(begin)
        for width, table in zip(WIDTHS, tables):
            out = np.zeros((max(n, 0), FILTERS), dtype=np.float32)
            for j in range(width):
                for k in range(HASHES):
                    out += table[j][rows[j: j + n, k]]
            out[across] = -np.inf
            best.append(np.maximum.reduceat(out, begin[:-1], axis=0))
        return np.concatenate(best, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.intercept

    def log_odds(self, rows: np.ndarray, counts: np.ndarray, tables=None) -> np.ndarray:
        padded, begin = _padded(rows, counts)
        z = self.logits(self.pooled(padded, begin, tables or self.tables()))
        return np.clip(z.astype(np.float64), -40, 40)

    def score(self, rows: np.ndarray, counts: np.ndarray, tables=None) -> np.ndarray:
        if not self.trained or not len(counts):
            return np.zeros(len(counts))
        return _sigmoid(self.log_odds(rows, counts, tables))


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def _features(column: pa.Array):
    for chunk in text_chunks(column, letters=ALNUM):
        yield _rows(chunk.hashes(lower=True)), chunk.counts()


def _fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Mini-batch Adam on the logistic loss; every batch holds both classes alike."""
    rng = np.random.default_rng(seed)
    rows, known = _known_words(rows)
    embedding = np.zeros((PAD + 1, DIM), dtype=np.float32)
    embedding[known] = rng.normal(0, 0.1, (len(known), DIM))
    params = [embedding] + [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS] + [
        np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    per_epoch = max(1, -(-2 * max(len(c) for c in classes) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    rate, step = 0.02, 0
    for epoch in range(epochs):
        orders = [np.concatenate([rng.permutation(c) for _ in range(-(-per_epoch * BATCH // (2 * len(c))))])
                  for c in classes]
        for b in range(per_epoch):
            half = slice(b * BATCH // 2, (b + 1) * BATCH // 2)
            pick = np.concatenate([o[half] for o in orders])
            model = Model(params[0], params[1:-3], params[-3], params[-2], float(params[-1][0]))
            touched, grads = _gradient(model, [rows[i] for i in pick], labels[pick])
            step += 1
            lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for i, (p, g, m, v) in enumerate(zip(params, grads, first, second)):
                m *= 0.9
                v *= 0.999
                at = touched if i == 0 else slice(None)       # of the embedding, the rows in the batch's maxima
                m[at] += 0.1 * g
                v[at] += 0.001 * g * g
                p -= lr * m / (np.sqrt(v) + 1e-7)
            params[0][PAD] = 0
    return Model(params[0], params[1:-3], params[-3], params[-2], float(params[-1][0]))


def _known_words(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts with the words of fewer than ``MIN_TEXTS`` of them blanked, and the rows in use.

    A rare word would only be learnt by heart; rows without a known word stay zero."""
    keys = [(r.astype(np.int64) * np.array([1, BUCKETS, BUCKETS ** 2])).sum(axis=1) for r in rows]
    word, texts = np.unique(np.concatenate([np.unique(k) for k in keys]), return_counts=True)
    often = texts >= MIN_TEXTS
    out = [np.where(often[np.searchsorted(word, k)][:, None], r, np.int32(PAD)) for k, r in zip(keys, rows)]
    used = np.unique(np.concatenate(out))
    return out, used[used != PAD]


def _gradient(model: Model, rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Embedding rows that take part, and the gradient of (those rows, filters, bias, weights, intercept)."""
    counts = np.array([len(r) for r in rows])
    padded, begin = _padded(np.concatenate(rows), counts)
    vectors = model.embedding[padded[:, 0]]
    for k in range(1, HASHES):
        vectors = vectors + model.embedding[padded[:, k]]
    n = len(padded) - max(WIDTHS) + 1
    outputs = [sum(vectors[j: j + n] @ w[j] for j in range(len(w))) for w in model.filters]
    for o in outputs:
        o[_across(begin)] = -np.inf
    pooled = np.concatenate([np.maximum.reduceat(o, begin[:-1], axis=0) for o in outputs], axis=1)
    active = pooled + model.bias > 0
    hidden = np.where(active, pooled + model.bias, 0)
    z = hidden @ model.weights + model.intercept
    miss = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)).astype(np.float32)
    d_hidden = np.where(active, miss[:, None] * model.weights, 0).astype(np.float32)
    d_filters, places, pushes = [], [], []
    texts = np.repeat(np.arange(len(rows)), np.diff(begin))[:n]
    for i, (width, out) in enumerate(zip(WIDTHS, outputs)):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        # the place of each maximum (of several, the first)
        where, f = np.nonzero(out >= pooled[texts, part])
        at = np.empty((len(rows), FILTERS), dtype=np.int64)
        at[texts[where[::-1]], f[::-1]] = where[::-1]
        d_filters.append(np.stack([np.einsum("bf,bfd->df", d_hidden[:, part], vectors[at + j]) for j in range(width)]))
        for j in range(width):
            push = d_hidden[:, part, None] * model.filters[i][j].T[None]   # (texts, FILTERS, DIM)
            for k in range(HASHES):
                places.append(padded[(at + j).ravel(), k])
                pushes.append(push.reshape(-1, DIM))
    touched, slot = np.unique(np.concatenate(places), return_inverse=True)
    d_rows = 2e-6 * model.embedding[touched]
    np.add.at(d_rows, slot, np.concatenate(pushes))
    return touched, [d_rows, *d_filters, d_hidden.sum(axis=0), (hidden * miss[:, None]).sum(axis=0).astype(np.float32),
                     np.array([miss.sum()], np.float32)]


def _best_threshold(z: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The score between two bins that gives the best F1 (ties: the widest gap).

    ``z``: log-odds of the middle of each bin in use, rising; weights of both labels in it."""
    low = np.concatenate([[-40.0], z[:-1]])
    missed = np.cumsum(positive) - positive
    alarms = negative.sum() - (np.cumsum(negative) - negative)
    caught = positive.sum() - missed
    f1 = 2 * caught / np.maximum(caught + alarms + positive.sum(), 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    best = best[np.argmax(_sigmoid(z[best]) - _sigmoid(low[best]))]
    edges = _sigmoid(low[best] + 0.5 / BINS), _sigmoid(z[best] - 0.5 / BINS)
    return float(np.clip((_sigmoid(low[best]) + _sigmoid(z[best])) / 2, min(edges), max(edges)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", lang_col: str | None = "lang", allowed: Column | None = None,
        per_class: int = PER_CLASS, broadcast_labels: int = BROADCAST_LABELS) -> Model:
    """Train on at most ``per_class`` rows of each class among the ``allowed`` labels, calibrate on all others.

    The sample's rows are found on the narrow label table and met with the
    documents by a broadcast of at most ``2 * per_class`` ids.  More than
    ``broadcast_labels`` other labels meet the documents' scores in a shuffle of
    narrow rows instead.
    """
    wanted = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if allowed is not None:
        wanted = wanted.filter(allowed)
    wanted = wanted.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct() \
                   .withColumn("_h", F.xxhash64("_id"))
    counts = {r["_y"]: r["count"] for r in wanted.groupBy("_y").count().collect()}
    if len(counts) < 2:
        return _untrained()
    sample = wanted.filter("_y = 1").orderBy("_h", "_id").limit(per_class).union(
        wanted.filter("_y = 0").orderBy("_h", "_id").limit(per_class))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("_id"), lang.alias("_lang"), F.col(text_col).alias("_text")) \
                .join(F.broadcast(sample), "_id").select("_id", "_y", "_h", "_lang", "_text")

    def encode(batches):
        for batch in batches:
            rows = []
            for r, counts in _features(batch.column(4)):
                cuts = np.cumsum(counts)[:-1]
                rows += [x.astype("<i4").tobytes() for x in np.split(r, cuts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.binary())],
                                             ["_id", "_y", "_h", "_lang", "rows"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.mapInArrow(encode, f"_id {kind}, _y int, _h long, _lang string, rows binary").toPandas()
    if got["_y"].nunique() < 2:
        return _untrained()
    got = got.sort_values(["_h", "_y", "rows"], kind="stable").drop_duplicates(["_h", "_y"]).reset_index(drop=True)
    rows = [np.frombuffer(r, dtype="<i4").reshape(-1, HASHES) for r in got["rows"]]
    y = got["_y"].to_numpy(dtype=np.float32)
    # one in CALIBRATION of each class never trains, so that small tables calibrate too
    rank = got.groupby("_y").cumcount().to_numpy()
    held = rank % CALIBRATION == CALIBRATION - 1
    held &= np.array([(y[held] == c).sum() >= 5 for c in (0, 1)]).all()
    model = _fit([r for r, h in zip(rows, held) if not h], y[~held])
    if held.any():
        learnt = docs.sparkSession.createDataFrame([(x,) for x in got["_id"][~held].tolist()], f"_id {kind}")
        others = wanted.join(F.broadcast(learnt), "_id", "left_anti").select("_id", "_y")
        texts = docs.select(F.col(id_col).alias("_id"), lang.alias("_lang"), F.col(text_col).alias("_text"))
        if sum(counts.values()) <= broadcast_labels:
            met = texts.join(F.broadcast(others), "_id").select("_lang", "_y", _bin("_text", model).alias("bin"))
        else:
            met = texts.filter("_id is not null").select("_id", "_lang", _bin("_text", model).alias("bin")).join(others, "_id")
        _calibrate(model, stage(met.groupBy("_lang", "_y", "bin").count(), "toxicity-bins"), counts)
    return model


def _bin(text: str, model: Model) -> Column:
    """The bin of each text's log-odds."""
    tables = model.tables()

    @F.arrow_udf("int")
    def udf(column: pa.Array) -> pa.Array:
        parts = [np.floor(model.log_odds(rows, counts, tables) * BINS) for rows, counts in _features(column)]
        return pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32), pa.int32())

    return udf(F.col(text))


def _calibrate(model: Model, bins: DataFrame, counts: dict[int, int]) -> None:
    """Shift the score towards 0.5 as the best threshold over all languages, then set one
    for each language with 20 examples of each class (others: 0.5), drawn to 0.5 where they are few.

    ``bins``: rows ``_lang, _y, bin, count`` of all labelled rows outside the sample."""
    rows = [(r["bin"], r["_y"], r["n"]) for r in bins.groupBy("bin", "_y").agg(F.sum("count").alias("n")).collect()]
    seen = {y: sum(n for _, own, n in rows if own == y) for y in (0, 1)}
    # batches hold both classes alike, the labels do not: the odds as they are
    shift = float(np.log(counts[1] / counts[0]))
    if min(seen.values()) >= 5:
        weight = {y: counts[y] / seen[y] for y in (0, 1)}
        n = min(seen.values())
        best = np.clip(_best_threshold(*_totals(rows, shift, weight)), 1e-6, 1 - 1e-6)
        shift -= float(np.log(best / (1 - best)) * n / (n + SHRINK))
        label = [F.sum(F.when(F.col("_y") == y, F.col("count")).otherwise(0)) for y in (0, 1)]
        often = bins.filter("_lang is not null").groupBy("_lang").agg(F.least(*label).alias("n")).filter("n >= 20")
        own: dict[str, list] = {}
        fewest = {}
        for r in bins.join(often, "_lang").collect():
            own.setdefault(r["_lang"], []).append((r["bin"], r["_y"], r["count"]))
            fewest[r["_lang"]] = r["n"]
        for lang in sorted(own):
            best, n = _best_threshold(*_totals(own[lang], shift, weight)), fewest[lang]
            model.thresholds[lang] = float((n * best + SHRINK * 0.5) / (n + SHRINK))
    model.intercept += shift


def _totals(rows: list[tuple[int, int, int]], shift: float, weight: dict[int, float]):
    """Log-odds of the bins in use, and the weight of both labels in each."""
    used, slot = np.unique([r[0] for r in rows], return_inverse=True)
    sums = {y: np.bincount(slot, [n * weight[y] * (own == y) for _, own, n in rows], len(used)) for y in (0, 1)}
    return (used + 0.5) / BINS + shift, sums[1], sums[0]


def _untrained() -> Model:
    return Model(np.zeros((PAD + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                 np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0,
                 trained=False)


def score(text: Column | str, model: Model) -> Column:
    """Toxicity of each text, from 0 to 1."""
    tables = model.tables()

    @F.arrow_udf(DoubleType())
    def udf(column: pa.Array) -> pa.Array:
        parts = [model.score(rows, counts, tables) for rows, counts in _features(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return udf(F.col(text) if isinstance(text, str) else text)


def threshold(lang: Column | str, model: Model) -> Column:
    """The calibrated threshold of each row's language (0.5 where there is none)."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    out = F.lit(0.5)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out
