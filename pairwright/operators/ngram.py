"""Count-based next-move model and the student proposer.

The reference's student is a fine-tuned language model sampled with
repetition penalty, temperature, top-k and top-p.  Here the model is the
table ``(ctx_len, ctx, next, count, ctx_total, prob)`` of next-move counts
given the last 0..n tokens, and every decoding step is a relational step:

* k-grams are counted as numbers in chunks of ``CHUNK_TOKENS`` tokens, so a task
  holds one chunk and sends each context and next token of it once;
* rows are shuffled once: a token and the tokens behind it are one row that holds all
  contexts beginning there, dealt by that token (by two where the first is frequent), so
  sums, totals and ranks of a context need no other shuffle.  The empty context, which
  every token would share, is apart: its rows are dealt by token and its total is one number;
* the empty context's top k uses ``row_number() <= k``, which Spark plans with a
  partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from .bloom import bloom_filter, may_hold
from .ordering import group_row_number, staged

# Decoding settings of the reference's student (fixed values):
# 8 continuations per prompt, top_k 40, top_p 0.9, temperature 0.8,
# repetition penalty 1.1; the evaluation probe uses 5 samples and top_k 40.
N_SAMPLES = 8
TOP_K = 40
TOP_P = 0.9
TEMPERATURE = 0.8
REPETITION_PENALTY = 1.1
CHUNK_TOKENS = 1 << 19     # tokens whose k-grams are counted at once
TASK_ROWS = 1_500_000      # k-grams, repeats included, for which a task of the counts is meant
HOT_SHARE = 1000           # a token is hot above this fraction of all; so there are fewer

# Contexts that may be broadcast to filter k-grams before they are counted.
BROADCAST_CONTEXTS = 1_000_000


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings ``data[starts: starts + sizes]``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])]) \
        .cast(pa.string())


def _chunks(batches, chunk: int, reach: int):
    """Of sequences: (data, starts, sizes, code, words, row, own) of every ``chunk`` tokens and ``reach`` more.

    Token ``i`` is ``data[starts[i]: starts[i] + sizes[i]]`` with a space behind it; ``code`` numbers
    it in the dictionary ``words``, ``row`` is its sequence, and the first ``own`` tokens are the chunk's."""
    for batch in batches:
        column = batch.column(0)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = pc.list_flatten(column)
        row = np.repeat(np.arange(len(lengths)), lengths)
        for at in range(0, len(tokens), chunk):
            own = min(chunk, len(tokens) - at)
            wide = tokens.slice(at, own + reach).cast(pa.large_string())
            offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset: wide.offset + len(wide) + 1]
            sizes, n, raw = np.diff(offsets), np.arange(len(wide)), wide.buffers()[2]
            raw = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            data = np.full(len(raw) + len(wide), 32, dtype=np.uint8)
            data[np.arange(len(raw)) + np.repeat(n, sizes)] = raw
            words = wide.dictionary_encode()
            yield (data, offsets[:-1] - offsets[0] + n, sizes, words.indices.to_numpy().astype(np.int64), words.dictionary,
                   row[at: at + len(wide)], own)


def _gram_task(lo: int, hi: int, chunk: int = CHUNK_TOKENS):
    """Arrow task: sequences to ctx, next, n -- every context of ``lo`` to ``hi`` tokens and its next token, once a chunk."""
    def run(batches):
        for data, starts, sizes, code, words, row, own in _chunks(batches, chunk, hi):
            begin, gram = np.arange(own), code[:own]         # where the k-grams begin, and a number of each
            for k in range(hi + 1):
                if k:
                    inside = begin + k < len(row)
                    inside[inside] = row[begin[inside]] == row[begin[inside] + k]
                    begin = begin[inside]
                    gram = gram[inside] * np.int64(len(words)) + code[begin + k]
                _, first, gram, count = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
                if k >= lo and len(first):
                    i = begin[first]
                    yield pa.RecordBatch.from_arrays(
                        [_pieces(data, starts[i], np.maximum(starts[i + k] - 1 - starts[i], 0)),
                         _pieces(data, starts[i + k], sizes[i + k]), pa.array(count, pa.int64())], ["ctx", "next", "n"])
    return run


def _follow_task(lo: int, hi: int, chunk: int = CHUNK_TOKENS):
    """Arrow task: sequences to ctx, nexts, ns -- every context of ``lo`` (1 at least) to ``hi`` tokens, once a chunk,
    with the different tokens behind it, a space between them, and how often each is there."""
    def run(batches):
        for data, starts, sizes, code, words, row, own in _chunks(batches, chunk, hi):
            begin, gram = np.arange(own), code[:own]
            for k in range(1, hi + 1):
                inside = begin + k < len(row)
                inside[inside] = row[begin[inside]] == row[begin[inside] + k]
                begin = begin[inside]
                pair = gram[inside] * np.int64(len(words)) + code[begin + k]
                value, first, gram, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                if k >= lo and len(first):
                    i = begin[first]
                    at = np.flatnonzero(np.diff(value // len(words), prepend=-1))   # equal contexts are side by side
                    ends = np.append(at[1:], len(value))
                    size = np.append(0, np.cumsum(sizes[i + k] + 1))                # each with the space behind it
                    follow = data[np.arange(size[-1]) + np.repeat(starts[i + k] - size[:-1], sizes[i + k] + 1)]
                    yield pa.RecordBatch.from_arrays(
                        [_pieces(data, starts[i[at]], np.maximum(starts[i[at] + k] - 1 - starts[i[at]], 0)),
                         _pieces(follow, size[at], size[ends] - 1 - size[at]),
                         pa.ListArray.from_arrays(pa.array(np.append(at, len(value)), pa.int32()), pa.array(count, pa.int32()))],
                        ["ctx", "nexts", "ns"])
    return run


def _window_task(lo: int, hi: int, hot: list[str], chunk: int = CHUNK_TOKENS):
    """Arrow task: sequences to head, rest, n -- every token with the ``hi`` tokens after it, once a chunk.

    The head is its first ``lo`` tokens, so all contexts that begin with them are in it.  Behind a
    ``hot`` token the head is one token longer, and the shortest context is a row of its own."""
    def run(batches):
        for data, starts, sizes, code, words, row, own in _chunks(batches, chunk, hi):
            def rows(i, h, length, count):
                last = i + length - 1
                return pa.RecordBatch.from_arrays(
                    [_pieces(data, starts[i], starts[i + h] - 1 - starts[i]),
                     _pieces(data, starts[i + h], starts[last] + sizes[last] - starts[i + h]), pa.array(count, pa.int64())],
                    ["head", "rest", "n"])

            is_hot = pc.is_in(words, pa.array(hot, words.type)).to_numpy(zero_copy_only=False)[code]
            i = np.arange(own)
            gram, length, on = code[:own], np.ones(own, dtype=np.int64), np.ones(own, dtype=bool)
            for k in range(1, hi + 1):
                on = on & (i + k < len(row))
                on[on] = row[i[on]] == row[i[on] + k]
                after = np.zeros(own, dtype=np.int64)              # 0: the sequence has ended
                after[on] = code[i[on] + k] + 1
                length += on
                _, first, gram, count = np.unique(gram * np.int64(len(words) + 1) + after, return_index=True,
                                                  return_inverse=True, return_counts=True)
                if k == lo:
                    short = is_hot[first] & (length[first] > lo)
                    if short.any():
                        yield rows(first[short], lo, lo + 1, count[short])
            h = lo + is_hot[first]
            some = length[first] > h
            if some.any():
                yield rows(first[some], h[some], length[first[some]], count[some])
    return run


def _grams(df: DataFrame, moves: str, lo: int, hi: int) -> DataFrame:
    return df.select(moves).mapInArrow(_gram_task(lo, hi), "ctx string, next string, n long")


def _single(df: DataFrame, moves: str) -> DataFrame:
    """ctx_len, ctx, next, count of the empty context."""
    counts = _grams(df, moves, 0, 0).groupBy("next").agg(F.sum("n").alias("count"))
    return counts.select(F.lit(0).alias("ctx_len"), F.lit("").alias("ctx"), "next", "count")


def _among(rows: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose ctx is among ``contexts``, and the contexts they must still meet once they are counted, if any.

    Few ``contexts`` are broadcast; of more, a Bloom filter holds back most other rows before the shuffle."""
    wanted = contexts.select("ctx").distinct()
    n = wanted.count()
    if n <= BROADCAST_CONTEXTS:
        return rows.join(F.broadcast(wanted), "ctx", "left_semi"), None
    bits, words = bloom_filter(wanted, ["ctx"], n)
    return rows.join(F.broadcast(bits), may_hold(F.col("_bits"), words, [rows["ctx"]]), "left_semi"), wanted


def _of_contexts(df: DataFrame, moves: str, lo: int, hi: int, contexts: DataFrame | None) -> DataFrame:
    """ctx, next, count, the rows of a context in one partition; of ``contexts`` alone if there are any.

    A context is then sent once a chunk, with all that follows it."""
    many = None
    if contexts is None:
        rows = _grams(df, moves, lo, hi).repartition("ctx")
    else:
        rows = df.select(moves).mapInArrow(_follow_task(lo, hi), "ctx string, nexts string, ns array<int>")
        rows, many = _among(rows, contexts.filter(F.col("ctx_len") > 0))
        follow = F.arrays_zip(F.split("nexts", " ").alias("next"), F.col("ns").alias("n"))
        rows = rows.repartition("ctx").select("ctx", F.inline(follow).alias("next", "n"))
    counts = rows.groupBy("ctx", "next").agg(F.sum("n").alias("count"))
    return counts if many is None else counts.join(many, "ctx", "left_semi")


def _of_windows(df: DataFrame, moves: str, lo: int, hi: int, single: DataFrame) -> DataFrame:
    """head, ctx, next, count: windows shuffled once, by head, and cut into contexts where they arrive."""
    total = single.agg(F.sum("count")).first()[0] or 0
    hot = [r["next"] for r in single.filter(F.col("count") > total / HOT_SHARE).select("next").collect()] if lo == 1 else []
    rows = df.select(moves).mapInArrow(_window_task(lo, hi, hot), "head string, rest string, n long")
    # a row becomes several where it arrives: tasks follow these, not the bytes shuffled
    dealt = rows.repartition(max(1, -(-total * (hi - lo + 1) // TASK_ROWS)), "head")
    size = F.length("rest") - F.length(F.replace(F.col("rest"), F.lit(" "), F.lit(""))) + 1
    cuts = []
    for j in range(1, hi - lo + 2):
        ctx = F.col("head") if j == 1 else F.concat("head", F.lit(" "), F.substring_index("rest", " ", j - 1))
        nxt = F.substring_index(F.substring_index("rest", " ", j), " ", -1)
        cuts.append(F.struct(ctx.alias("ctx"), F.when(size >= j, nxt).alias("next")))
    return dealt.select("head", "n", F.inline(F.array(*cuts))).filter(F.col("next").isNotNull()) \
                .groupBy("head", "ctx", "next").agg(F.sum("n").alias("count"))


def _counts(df: DataFrame, moves: str, max_ctx: int, min_ctx: int,
            contexts: DataFrame | None) -> list[tuple[DataFrame, list[str]]]:
    """Counts of the empty context and of longer ones, whichever is asked for, and the columns that name a
    context there; its rows are together unless it is empty."""
    lo, out = max(min_ctx, 1), []
    windows = contexts is None and max_ctx > lo
    single = _single(df, moves) if windows or min_ctx == 0 else None
    if windows:
        single = staged(single, "tokens")                    # the vocabulary, read several times
    if min_ctx == 0:
        asked = single
        if contexts is not None:
            wanted = contexts.filter(F.col("ctx_len") == 0).select("ctx").distinct()       # one row at most
            asked = single.join(F.broadcast(wanted), "ctx", "left_semi")
        out.append((asked.select("ctx_len", "ctx", "next", "count"), ["ctx"]))
    if max_ctx > 0:
        longer = _of_windows(df, moves, lo, max_ctx, single) if windows else _of_contexts(df, moves, lo, max_ctx, contexts)
        # a context's text says its length (tokens hold no space)
        spaces = F.length("ctx") - F.length(F.replace(F.col("ctx"), F.lit(" "), F.lit("")))
        out.append((longer.withColumn("ctx_len", (spaces + 1).cast("int")), ["head", "ctx"] if windows else ["ctx"]))
    return out


COUNTS = ["ctx_len", "ctx", "next", "count"]


def ngram_counts(df: DataFrame, moves: str = "moves", max_ctx: int = 3,
                 min_ctx: int = 0, contexts: DataFrame | None = None) -> DataFrame:
    """(ctx_len, ctx, next, count), combined before the shuffle.

    ``contexts`` (ctx_len, ctx) keeps the rows of those contexts alone."""
    return reduce(DataFrame.union, [c.select(*COUNTS) for c, _ in _counts(df, moves, max_ctx, min_ctx, contexts)])


def top_continuations(df: DataFrame, k: int, moves: str = "moves", max_ctx: int = 3, min_ctx: int = 0) -> DataFrame:
    """L8 on counts: the ``k`` most frequent next tokens of every context, with ``rank``."""
    return reduce(DataFrame.union, [top_k(c, k, keys=keys).select(*COUNTS, "rank")
                                    for c, keys in _counts(df, moves, max_ctx, min_ctx, None)])


def fit_ngrams(df: DataFrame, moves: str = "moves", max_ctx: int = 3,
               min_count: int = 1, min_ctx: int = 0, contexts: DataFrame | None = None) -> DataFrame:
    """M1: counts and probability of the next token given the last 0..max_ctx.

    ``contexts`` (ctx_len, ctx) restricts the table to the contexts a set of
    prompts can back off to; their counts and shares stay exact.
    """
    parts = _counts(df, moves, max_ctx, min_ctx, contexts)
    if min_count > 1:
        parts = [(c.filter(F.col("count") >= min_count), keys) for c, keys in parts]
    out = []
    if min_ctx == 0:
        # the empty context holds the vocabulary; its total is one number
        single, _ = parts.pop(0)
        zero = df.agg(F.sum(F.size(moves)).alias("ctx_total")) if min_count == 1 and contexts is None else \
            single.agg(F.sum("count").alias("ctx_total"))
        out.append(single.crossJoin(F.broadcast(zero)))
    out += [c.withColumn("ctx_total", F.sum("count").over(Window.partitionBy(*keys))).select(*COUNTS, "ctx_total")
            for c, keys in parts]
    return reduce(DataFrame.union, out).withColumn("prob", F.col("count") / F.col("ctx_total"))


def top_k(model: DataFrame, k: int = TOP_K, keys=("ctx_len", "ctx"),
          score: str = "count", item: str = "next") -> DataFrame:
    """The k best rows per context (score desc, item asc), with ``rank``."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item))
    return model.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def argmax_next(model: DataFrame, keys=("ctx_len", "ctx"), score: str = "count",
                item: str = "next", name: str = "prediction") -> DataFrame:
    """L12 on the model: one best item per context; ties -> smallest item.

    ``min_by`` over (-score, item) is a partial aggregate: it combines map-side,
    so a context with millions of rows never lands whole in one task.
    """
    return model.groupBy(*keys).agg(
        F.min_by(F.col(item), F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")))
        .alias(name))


def nucleus(df: DataFrame, p: float = TOP_P, keys=("position_id",), prob: str = "prob",
            item: str = "next") -> DataFrame:
    """Keep rows while the probability mass before them is < p."""
    w = (Window.partitionBy(*keys).orderBy(F.col(prob).desc(), F.col(item))
         .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum(prob).over(w), F.lit(0.0))
    return df.withColumn("_before", before).filter(F.col("_before") < p).drop("_before")


def renormalise(df: DataFrame, keys=("position_id",), prob: str = "prob") -> DataFrame:
    """Probabilities of each group sum to 1."""
    w = Window.partitionBy(*keys)
    return df.withColumn(prob, F.col(prob) / F.sum(prob).over(w))


def reweight(df: DataFrame, t: float = TEMPERATURE, penalty: float = REPETITION_PENALTY,
             in_prompt: str = "in_prompt", keys=("position_id",), prob: str = "prob") -> DataFrame:
    """Repetition penalty then temperature on ``ln p``, renormalised.

    ``ln p <= 0``, so the penalty multiplies it for tokens already in the prompt.
    """
    lnp = F.ln(F.col(prob))
    s = F.when(F.coalesce(F.col(in_prompt), F.lit(False)), lnp * F.lit(penalty)).otherwise(lnp)
    s = s / F.lit(t)
    w = Window.partitionBy(*keys)
    out = df.withColumn("_s", s).withColumn("_s", F.col("_s") - F.max("_s").over(w))
    out = out.withColumn(prob, F.exp("_s")).drop("_s")
    return renormalise(out, keys, prob)


def sample_n(df: DataFrame, n: int = N_SAMPLES, seed: int = 42, keys=("position_id",),
             prob: str = "prob", item: str = "next") -> DataFrame:
    """``n`` independent draws per group by inverse CDF on a hash.

    ``u`` = hash(seed, key, draw) / 2^32 scaled by the group's mass; the drawn
    row is the first whose running sum exceeds it.  Output: keys, draw, item.
    """
    key = keys[0]
    w_order = Window.partitionBy(*keys).orderBy(F.col(prob).desc(), F.col(item))
    # each interval begins where the one before ends, and the last takes the rest:
    # sums of doubles leave neither gaps nor overlaps
    cum = df.withColumn("_hi", F.sum(prob).over(w_order.rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("_lo", F.coalesce(F.lag("_hi").over(w_order), F.lit(0.0))) \
            .withColumn("_tot", F.max("_hi").over(Window.partitionBy(*keys))) \
            .withColumn("_last", F.lead("_hi").over(w_order).isNull())
    # a group's rows meet its draws where they are: the distribution is read once
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda d: F.struct(d.alias("draw"), unit_hash(seed, key, d).alias("_u")))
    j = cum.dropna(subset=list(keys)).select(*cum.columns, F.inline(draws))
    hit = (F.col("_u") * F.col("_tot") >= F.col("_lo")) & ((F.col("_u") * F.col("_tot") < F.col("_hi")) | F.col("_last"))
    return j.filter(hit).select(*keys, "draw", item)


def backoff_contexts(prompts: DataFrame, moves: str = "moves", key: str = "position_id",
                     max_ctx: int = 3) -> DataFrame:
    """Candidate contexts of each prompt: its last 0..max_ctx tokens."""
    arr = F.col(moves)
    n = F.size(arr)
    items = [F.struct(F.lit(0).alias("ctx_len"), F.lit("").alias("ctx"))]
    for c in range(1, max_ctx + 1):
        items.append(F.when(n >= c, F.struct(F.lit(c).alias("ctx_len"),
                                             F.array_join(F.slice(arr, n - F.lit(c - 1), F.lit(c)), " ")
                                             .alias("ctx"))))
    flat = F.filter(F.array(*items), lambda s: s.isNotNull())
    return prompts.select(key, F.inline(flat))


def backoff_lookup(prompts: DataFrame, model: DataFrame, moves: str = "moves",
                   key: str = "position_id", max_ctx: int = 3, min_count: int = 1) -> DataFrame:
    """The longest context of each prompt that the model knows.

    Contexts with too few observations are dropped before the join.  Output:
    key, ctx_len, ctx (one row per prompt that has any context).
    """
    known = model.filter(F.col("ctx_total") >= min_count).select("ctx_len", "ctx").distinct()
    cands = backoff_contexts(prompts, moves, key, max_ctx)
    hits = cands.join(known, ["ctx_len", "ctx"], "left_semi")
    return hits.groupBy(key).agg(F.max_by(F.struct("ctx_len", "ctx"), F.col("ctx_len")).alias("b")) \
               .select(key, "b.ctx_len", "b.ctx")


def proposal_distribution(prompts: DataFrame, model: DataFrame, moves: str = "moves",
                          key: str = "position_id", k: int = TOP_K, p: float = TOP_P,
                          t: float = TEMPERATURE, penalty: float = REPETITION_PENALTY,
                          max_ctx: int = 3) -> DataFrame:
    """Next-move distribution of each prompt after penalty, temperature, top-k, top-p.

    Exact top-k under the penalty without scanning whole contexts: only tokens
    of the prompt can drop in rank, so the k best after re-weighting lie in the
    raw ranks 1 .. k + s, where s = prompt tokens found there, and end where k
    others were found.  So a prompt meets the first ranks of its context, one row;
    the few prompts that hold too many of these tokens meet more ranks of theirs.
    A prompt that backs off to the unigram context reads no vocabulary.
    Output: key, next, prob.
    """
    own, depth, parts = ["ctx_len", "ctx"], 2 * k, []
    ctx = staged(backoff_lookup(prompts, model, moves, key, max_ctx), "backoff")
    words = prompts.select(F.col(key).alias("_key"), F.array_join(F.array_distinct(F.col(moves)), " ").alias("_words"))
    left, total = ctx, ctx.count()
    while total or not parts:
        asked = left.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
        known, texts = model, words
        if parts:
            asked = staged(asked, "asked")
            if asked.count() <= BROADCAST_CONTEXTS:
                known = model.join(F.broadcast(asked.select(*own)), own, "left_semi")
            if total <= BROADCAST_CONTEXTS:
                texts = words.join(F.broadcast(left), F.col("_key") == F.col(key), "left_semi")
        # raw ranks inside each context; the other rows leave before the shuffle
        ranked = group_row_number(known, own, [F.col("count").desc(), F.col("next")], "raw_rank", first=depth)
        best = ranked.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("raw_rank", "next", "prob"))).alias("_best"))
        # a context that many prompts share would be one task: there are few, and their first ranks are broadcast
        hot = F.broadcast(asked.filter(F.col("n") * (HOT_SHARE * 2 * k) > total * depth).select(*own))
        met = left.join(hot, own, "left_anti").join(best, own) \
                  .unionByName(left.join(F.broadcast(best.join(hot, own, "left_semi")), own))
        # a key that comes again has the tokens of each of its prompts
        found = F.array_intersect(F.col("_best.next"), F.split("_words", " "))
        met = met.join(texts, F.col(key) == F.col("_key"), "left").select(key, *own, "_best", found.alias("_found")) \
                 .groupBy(key).agg(*[F.first(c).alias(c) for c in (*own, "_best")],
                                   F.flatten(F.collect_list("_found")).alias("_found"))
        s = F.size(F.array_distinct("_found"))
        met = staged(met.select(key, *own, F.slice("_best", 1, F.lit(k) + s).alias("_best"), "_found",
                                ((F.size("_best") < depth) | (F.size("_best") - s >= k)).alias("_all")), "best")
        parts.append(met.filter("_all").select(key, "_found", F.inline("_best")))
        left, depth = met.filter(~F.col("_all")).select(key, *own), depth * 8
        total = left.count()
    cand = reduce(DataFrame.union, parts)
    # a token comes once for every prompt of its key that has it, and once if none has
    times = F.size("_found") - F.size(F.array_remove("_found", F.col("next")))
    cand = cand.select(key, "next", "prob", (times > 0).alias("in_prompt"),
                       F.explode(F.array_repeat(F.lit(1), F.greatest(F.lit(1), times))))
    cand = reweight(cand.select(key, "next", "prob", "in_prompt"), t, penalty, keys=(key,))
    cand = top_k(cand, k, keys=(key,), score="prob").drop("rank")
    return renormalise(nucleus(renormalise(cand, (key,)), p, (key,)), (key,))


def propose(prompts: DataFrame, model: DataFrame, moves: str = "moves", key: str = "position_id",
            n: int = N_SAMPLES, k: int = TOP_K, p: float = TOP_P, t: float = TEMPERATURE,
            penalty: float = REPETITION_PENALTY, seed: int = 42, max_ctx: int = 3) -> DataFrame:
    """M2: n sampled next moves per prompt.  Output: key, draw, next."""
    dist = proposal_distribution(prompts, model, moves, key, k, p, t, penalty, max_ctx)
    return sample_n(dist, n, seed, (key,))
