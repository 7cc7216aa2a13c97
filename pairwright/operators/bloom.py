"""Bloom filters as columns, for anti joins against long lists of keys.

A filter is one row: an array of 64-bit words.  It is built with partial
aggregates (``bit_or`` by word) and probed with ``xxhash64`` and ``getbit``, so
both sides stay in generated code.  Its size follows the number of keys up to
``MAX_WORDS``; beyond that it lets more rows through, which costs time, not
correctness: rows it lets through meet the keys themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)     # of no fixed width
HASHES = 4
BITS_PER_KEY = 16        # about 0.2 % of other keys pass
MAX_WORDS = 1 << 20      # 8 MB


def _bits(key: list[Column], words: int) -> list[tuple[Column, Column]]:
    """(word, bit) of each hash of a key."""
    out = []
    for seed in range(HASHES):
        h = F.xxhash64(*key, F.lit(seed))
        out.append((F.pmod(F.shiftrightunsigned(h, 6), F.lit(words)), F.pmod(h, F.lit(64)).cast("int")))
    return out


def bloom_filter(keys: DataFrame, columns: list[str], n: int) -> tuple[DataFrame, int]:
    """One row ``_bits`` for about ``n`` keys, and how many words it has."""
    words = min(MAX_WORDS, max(64, -(-n * BITS_PER_KEY // 64)))
    at = F.array(*[F.struct(w.cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), b).alias("v"))
                   for w, b in _bits([F.col(c) for c in columns], words)])
    set_words = keys.select(F.inline(at)).groupBy("w").agg(F.bit_or("v").alias("v"))
    # every word is there, so a word's place is its number
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("v"))
    dense = set_words.union(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda s: s["v"]).alias("_bits")), words


def may_hold(bits: Column, words: int, key: list[Column]) -> Column:
    """False where the filter surely does not hold the key (a null part counts as a value)."""
    return reduce(and_, [F.getbit(F.get(bits, w.cast("int")), b) == 1 for w, b in _bits(key, words)])


def anti_join(rows: DataFrame, gone: DataFrame, columns: list[str], broadcast_keys: int = 0) -> DataFrame:
    """``rows`` whose key is not in ``gone``: exact, and null-safe.

    Rows that a Bloom filter over ``gone`` tells apart stay where they are; only
    the others, the keys that are gone and a few more, are shuffled to meet them.
    Up to ``broadcast_keys`` keys of fixed width are broadcast instead, and no row moves.
    """
    gone = gone.select(*columns).distinct()
    n = gone.count()
    if n == 0:
        return rows
    if n <= broadcast_keys and not any(isinstance(f.dataType, _LONG) for f in gone.schema.fields):
        few = F.broadcast(gone.select(*[F.col(c).alias(f"_gone_{c}") for c in columns]))
        return rows.join(few, reduce(and_, [rows[c].eqNullSafe(few[f"_gone_{c}"]) for c in columns]), "left_anti")
    bits, words = bloom_filter(gone, columns, n)
    bits = F.broadcast(bits)                 # one row, at most MAX_WORDS words
    maybe = may_hold(F.col("_bits"), words, [rows[c] for c in columns])
    sure = rows.join(bits, maybe, "left_anti")
    gone = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in columns])
    same = reduce(and_, [rows[c].eqNullSafe(gone[f"_gone_{c}"]) for c in columns])
    return sure.union(rows.join(bits, maybe, "left_semi").join(gone, same, "left_anti"))
