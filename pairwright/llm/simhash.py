"""SimHash near-dedup by pigeonhole blocks.

Fingerprint: words are runs of characters other than ASCII white space of the
text with A-Z in lower case; each run of ``shingle`` words (repeats included,
fewer words: the whole sequence) gives an XXH64 (UTF-8, seed 42); a bit is 1 if
it is set in more than half of the hashes.

Search: the 64 bits are cut into ``max_bits + 3`` blocks.  Two fingerprints
with at most ``max_bits`` differing bits agree on at least three blocks, so
they meet under one of the C(max_bits + 3, 3) keys made of three blocks (about
32 bits for three bits).  Only distinct fingerprints take part.  A key's bucket
is verified by Hamming distance inside one task and returns a spanning forest,
never its pairs.  A bucket of more than ``BUCKET`` fingerprints is keyed again
by the same argument on finer blocks of the bits it does not share, until the
open bits alone bound its size.

Null or empty text: fingerprint zero, linked like any other.  Null ids keep
their rows and never become a component's id unless all are null.  Repeated
rows give repeated result rows.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators.bloom import anti_join
from .shared import components, stage

BUCKET = 4096          # distinct fingerprints verified together in one task
BROADCAST_ROWS = 1_000_000   # rows to drop, 8 bytes each, that may be broadcast
_ONES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of ``hashes`` (uint64)."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros((8, 8), dtype=np.int64)            # [bit in byte, byte]
    padded = np.zeros(-(-n // 255) * 255, dtype=np.uint64)
    padded[:n] = hashes
    rows = padded.reshape(-1, 255)                       # 255 ones fit into a byte lane
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _ONES).sum(axis=1, dtype=np.uint64)
        counts[bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    out = 0
    for byte in range(8):
        for bit in range(8):
            if 2 * counts[bit, byte] > n:
                out |= 1 << (8 * byte + bit)
    return out


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8").lower().split()   # ASCII rules for case and space
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), 42)] if words else []
    else:
        join = b" ".join
        hashes = [digest(join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))]
    value = _majority(np.array(hashes, dtype=np.uint64))
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """Column of signed 64-bit fingerprints, computed in Arrow batches of texts alone."""

    @F.arrow_udf(LongType())
    def udf(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_py(), shingle) for x in column], pa.int64())

    return udf(F.col(text) if isinstance(text, str) else text)


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``parts`` nearly equal blocks."""
    at = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _mask(blocks) -> int:
    return sum(((1 << n) - 1) << a for a, n in blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _first_masks(max_bits: int) -> list[int]:
    cut = _blocks(64, max_bits + 3)
    return [_mask(c) for c in combinations(cut, 3)]


def _finer_masks(mask: int, max_bits: int) -> list[int]:
    """Masks that keep ``mask`` and all but ``max_bits`` of eight blocks of the open bits."""
    bits = [i for i in range(64) if not mask >> i & 1]
    parts = max(8, max_bits + 1)
    groups = [sum(1 << i for i in bits[a: a + n]) for a, n in _blocks(len(bits), parts)]
    return [mask | sum(c) for c in combinations(groups, parts - max_bits)]


def _forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the values that differ in at most ``max_bits`` bits."""
    n = len(values)
    label = np.arange(n)
    bits = values.view(np.uint64)
    todo = np.ones(n, dtype=bool)
    child, parent = [], []
    for start in range(n):                     # breadth first, one row of distances at a time
        if not todo[start]:
            continue
        todo[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(todo & (np.bitwise_count(bits ^ bits[at]) <= max_bits))
            todo[near] = False
            label[near] = start
            child.extend(near)
            parent.extend([at] * len(near))
            queue.extend(near.tolist())
    return values[child].astype(np.int64), values[parent].astype(np.int64)


def _verify(buckets: DataFrame, max_bits: int) -> DataFrame:
    """``buckets (fps array)`` to spanning edges ``(a, b)``."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column("fps"):
                got = _forest(np.sort(row.values.to_numpy(zero_copy_only=False)), max_bits)
                a.append(got[0])
                b.append(got[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints reachable by links.

    ``distinct``: one row ``fp`` for each distinct fingerprint.
    """
    def keyed(df, masks):
        return F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                         for i, m in enumerate(masks)])

    first = _first_masks(max_bits)
    rows = distinct.select("fp", F.inline(keyed(distinct, first)))
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = stage(sizes, "simhash-buckets")
    small = rows.join(sizes.filter(F.col("n") <= BUCKET), ["t", "k"]) \
                .groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    found = [_verify(small.select("fps"), max_bits)]
    if sizes.filter(F.col("n") > BUCKET).limit(1).count():
        big = rows.join(sizes.filter(F.col("n") > BUCKET).select("t", "k"), ["t", "k"]).select("t", "fp")
        finer = F.array(*[F.array(*[F.struct(F.lit(j).alias("u"),
                                             F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                                    for j, m in enumerate(_finer_masks(mask, max_bits))]) for mask in first])
        again = big.select("t", "fp", F.inline(finer[F.col("t")])) \
                   .groupBy("t", "u", "k").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        found.append(_verify(again.select("fps"), max_bits))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``id_col, fingerprint (16 hex digits), component_id,
    component`` (a fingerprint, one for each component).

    ``component_id`` is the smallest id reachable over links, itself included.
    """
    fps = stage(docs.select(F.col(id_col), fingerprint(text_col, shingle).alias("fp")), "simhash-fp")
    groups = component_of(fps, id_col, max_bits)
    return fps.join(groups, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component")


def component_of(fps: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """``fp, component (a fingerprint), component_id`` for every distinct ``fp`` of ``fps``."""
    distinct = stage(fps.groupBy("fp").agg(F.min(id_col).alias("_low")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    member = distinct.join(roots, "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    lowest = member.groupBy("component").agg(F.min("_low").alias("component_id"))
    return member.join(lowest, "component").select("fp", "component", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, max_bits: int = 3, keep_blank: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (nulls last; of repeated
    rows, one).  With ``keep_blank`` all rows without a word stay: they share a fingerprint, not a text.

    What goes is found on narrow rows; the documents themselves are not shuffled
    while at most ``BROADCAST_ROWS`` rows go, and beyond that only those that a Bloom filter marks."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), fingerprint(docs[text_col], shingle).alias("fp"))
    # only a text without a word and a rare other one has fingerprint zero
    blank = (F.col("fp") == 0) & ~F.coalesce(F.col("doc")[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = stage(rows.select("doc", "fp", blank.alias("blank"), F.monotonically_increasing_id().alias("row")), "simhash-docs")
    narrow = rows.select(F.col("doc")[id_col].alias("id"), "row", "fp", "blank")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    member = stage(narrow.join(component_of(narrow, "id", max_bits), "fp").select("id", "row", "blank", "component"), "simhash-member")
    kept = member.groupBy("component").agg(first.alias("best")).select(F.col("best.row").alias("row"))
    gone = member.filter(~F.col("blank")) if keep_blank else member
    gone = stage(gone.select("row").join(kept, "row", "left_anti"), "simhash-gone")
    return anti_join(rows, gone, ["row"], BROADCAST_ROWS).select("doc.*")
