"""Near-duplicate vectors by a forest of random projection trees.

Equal vectors are merged first and counted.  A tree halves the vectors again and
again by random directions; a threshold lies where few vectors are near it, and
vectors within a margin of it go to both sides (spill), so two near vectors part
only by a rare draw.  Several trees make a miss rarer still: with the settings
here some 999 of 1000 pairs at the threshold itself meet, nearer ones almost
always.  Within a leaf all vectors are compared by cosine in double precision.

Directions and thresholds are fitted on at most ``SAMPLE`` vectors; every vector
is routed.  Leaves hold a few hundred vectors; where vectors crowd so closely
that no threshold parts them, the leaf stays whole and is compared in pairs of
blocks of at most ``BLOCK`` vectors, each a task of its own.

A pair met in several leaves counts in the smallest of them only: vectors carry
the list of their leaves, so neither pairs nor links are emitted, only each
vector's count of links and a spanning forest of the links.

Null vectors, empty or zero ones, and those with null or non-finite components
link with nothing.  Vectors of different lengths are compared within their
length.  Null ids keep their rows and are no component's id unless all are null.
An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, stage

SAMPLE = 20_000        # vectors that trees are fitted on
TREES = 3
LEAF = 400             # vectors in a leaf, about
SPILL = 0.65           # half width of the margin, in spreads of a pair's projected difference
NODE_SAMPLE = 48       # sample vectors that a threshold of its own needs
CROWDED = 0.45         # no split where the margin holds more of the sample
BLOCK = 2048
MAX_DEPTH = 24


@dataclass
class Tree:
    directions: np.ndarray                 # (depth, dim)
    own: dict[tuple[int, int], float]      # thresholds of (level, node); None of the crowded
    common: list[float]                    # for nodes that the sample does not reach
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf codes (a leading 1, then a bit for each split)."""
        row, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        done_row, done_node = [], []
        for level, direction in enumerate(self.directions):
            kinds, at = np.unique(node, return_inverse=True)
            cut = np.array([self.own.get((level, int(k)), self.common[level]) for k in kinds])[at]
            stop = np.isnan(cut)
            done_row.append(row[stop])
            done_node.append(node[stop])
            row, node, cut = row[~stop], node[~stop], cut[~stop]
            value = x[row] @ direction
            low, high = value < cut + self.margin, value >= cut - self.margin
            row = np.concatenate([row[low], row[high]])
            node = np.concatenate([2 * node[low], 2 * node[high] + 1])
        return np.concatenate([*done_row, row]), np.concatenate([*done_node, node])


def _threshold(values: np.ndarray, margin: float) -> float:
    """Between the quarters, the place with the fewest values in the margin; nan if crowded."""
    s = np.sort(values)
    cuts = s[np.linspace(len(s) * 0.25, len(s) * 0.75, 33).astype(int).clip(0, len(s) - 1)]
    near = np.searchsorted(s, cuts + margin) - np.searchsorted(s, cuts - margin)
    # among places about as empty, the most even one
    best = np.flatnonzero(near <= near.min() + 0.02 * len(s))
    pick = best[np.argmin(np.abs(best - 16))]
    return float(cuts[pick]) if near[pick] <= CROWDED * len(s) else float("nan")


def fit_tree(sample: np.ndarray, total: int, threshold: float, seed: int) -> Tree:
    """A tree for ``total`` unit vectors like those of ``sample``."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    margin = SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(dim)
    depth = int(np.clip(np.ceil(np.log2(max(total, 1) / LEAF)), 0, MAX_DEPTH))
    directions = rng.normal(size=(depth, dim))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    tree = Tree(directions, {}, [], margin)
    nodes = {1: np.arange(len(sample))}
    for level, direction in enumerate(directions):
        values = sample @ direction
        tree.common.append(_threshold(values, margin) if len(values) else float("nan"))
        below = {}
        for node, rows in nodes.items():
            if len(rows) < NODE_SAMPLE:
                continue
            # a crowd that no direction parts stays one leaf; else the next level tries another direction
            cut = _threshold(values[rows], margin)
            tree.own[level, node] = cut
            if not np.isnan(cut):
                below[2 * node] = rows[values[rows] < cut + margin]
                below[2 * node + 1] = rows[values[rows] >= cut - margin]
        nodes = below
    return tree


def _unit(column: pa.Array) -> np.ndarray:
    """Unit rows of a column of valid vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(vector: Column | str) -> Column:
    """Whether a vector can link: numbers only, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _routed(vectors: DataFrame, forest: list[Tree]) -> DataFrame:
    """``leaf`` (tree and code), ``node``, ``n``, ``v`` and all ``leaves`` of the vector."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v"))
            rows, codes = [], []
            for k, tree in enumerate(forest):
                r, c = tree.leaves(x)
                rows.append(r)
                codes.append(c * len(forest) + k)
            rows, codes = np.concatenate(rows), np.concatenate(codes)
            order = np.lexsort((codes, rows))
            rows, codes = rows[order], codes[order]
            counts = np.bincount(rows, minlength=len(x))
            ends = np.cumsum(counts)
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(codes, pa.int64()))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.int64()), batch.column("node").take(take), batch.column("n").take(take),
                 batch.column("v").take(take), own.take(take)], ["leaf", "node", "n", "v", "leaves"])

    return vectors.select("node", "n", "v").mapInArrow(
        run, "leaf long, node long, n long, v array<double>, leaves array<long>")


def _earlier(leaves: list, leaf: int) -> np.ndarray:
    """Which of the leaves before ``leaf`` each vector is in."""
    kinds: dict[int, int] = {}
    at = [[kinds.setdefault(x, len(kinds)) for x in own if x < leaf] for own in leaves]
    out = np.zeros((len(leaves), max(1, len(kinds))), dtype=np.float32)
    for i, own in enumerate(at):
        out[i, own] = 1
    return out


def _spanning(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric boolean matrix."""
    todo = linked.any(axis=1)
    child, parent = [], []
    for start in np.flatnonzero(todo):
        if not todo[start]:
            continue
        todo[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & todo)
            todo[new] = False
            child += new.tolist()
            parent += [at] * len(new)
            queue += new.tolist()
    return child, parent


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _unit(table.column("v").combine_chunks())
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        leaf, b, lo, hi = (table.column(c)[0].as_py() for c in ("leaf", "b", "lo", "hi"))
        block = table.column("b").to_numpy()
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if lo != hi:
            linked &= block[:, None] != block[None, :]
        child, parent = _spanning(linked)
        some = np.flatnonzero(linked.any(axis=1))
        links = np.zeros(0, dtype=np.int64)
        if len(some):
            mine = linked[np.ix_(some, some)]
            before = _earlier([table.column("leaves")[int(i)].as_py() for i in some], leaf)
            links = ((mine & (before @ before.T == 0)) * n[some][None, :]).sum(axis=1)
        nothing = [None] * len(some)
        return pa.table({"node": pa.array([*node[some].tolist(), *node[child].tolist()], pa.int64()),
                         "other": pa.array([*nothing, *node[parent].tolist()], pa.int64()),
                         "links": pa.array([*links.tolist(), *[None] * len(child)], pa.int64())})
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.95, trees: int = TREES) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id``."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(valid(v), F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    rows = stage(rows, "vectors")
    distinct = stage(rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
                     .withColumn("node", F.monotonically_increasing_id()), "vectors-distinct")
    found = None
    # one forest for each length of vectors
    for dim, total in sorted(tuple(r) for r in distinct.groupBy(F.size("v")).count().collect()):
        own = distinct.filter(F.size("v") == dim)
        sample = own.orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        forest = [fit_tree(_unit(sample), total, threshold, seed) for seed in range(trees)]
        routed = stage(_routed(own, forest), "vectors-routed")
        sizes = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        spread = routed.join(sizes.select("leaf", blocks.alias("blocks")), "leaf") \
                       .withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
                       .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
                       .select("leaf", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), "b",
                               "node", "n", "v", "leaves")
        part = spread.groupBy("leaf", "lo", "hi").applyInArrow(_compare(threshold), "node long, other long, links long")
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, other long, links long")
    found = stage(found, "vectors-links")
    links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    member = distinct.join(links, "node", "left").join(roots, "node", "left") \
                     .withColumn("root", F.coalesce("root", "node"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    known = member.join(lowest, "root").select(
        F.col("v").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.join(known, F.col("v") == F.col("v2"), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
