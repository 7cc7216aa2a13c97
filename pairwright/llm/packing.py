"""Order-preserving packing of token streams by dynamic programming.

Documents keep the order of the input within each partition.  Their ids (each
document followed by an end id) form a stream; the windows are the stretches
between chosen cuts, at most ``size`` tokens long.  Cuts may lie at document
ends (free), sentence ends (a small penalty) or, inside stretches without a
sentence end, at regular places (a larger one).  The cuts minimise padding plus
penalties over the whole stream of a segment:

    best[i] = penalty[i] + min(best[j] + size - (at[i] - at[j])),  at[i] - at[j] <= size

The inner minimum is that of ``best[j] + at[j]`` over a sliding range, held in
a monotone queue, so each cut is handled in constant amortised time.  Segments
hold a bounded number of tokens; the last window of a segment opens the next,
so padding arises once more for each partition only.  No shuffle is needed, and
a re-run task gives the same pieces.

Null or empty text: only the end id.  Repeated rows and null ids are packed like
any others.  A text of any length is cut into pieces.  An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import default_vocabulary, encoder

SIZE = 1024
SENTENCE_PENALTY = 6.0       # tokens of padding that a cut at a sentence end is worth
INNER_PENALTY = 96.0         # the same for a cut inside a sentence
INNER_STEP = 64              # such cuts are offered this far apart, where no other is near
SEGMENT_TOKENS = 1 << 18


def choose_cuts(at: list[int], penalty: list[float], size: int) -> list[int]:
    """Indices of the chosen cuts, first (0) and last included.

    ``at``: increasing stream positions with steps of at most ``size``.
    """
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for i in range(1, len(at)):
        here = at[i]
        while at[queue[0][1]] < here - size:
            queue.popleft()
        value, j = queue[0]
        best[i] = value + size - here + penalty[i]
        back[i] = j
        key = best[i] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class _Segment:
    """Documents (or the rest of one) waiting to be packed."""

    def __init__(self, size: int):
        self.size, self.tokens = size, 0
        self.docs: list[tuple] = []          # id, first token, its tokens, ids, sentence ends

    def add(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append((doc_id, start, doc_tokens, ids, stops))
        self.tokens += len(ids)

    def _cuts(self) -> tuple[list[int], list[float]]:
        at, penalty, base = [0], [0.0], 0
        for _, _, _, ids, stops in self.docs:
            places = [*stops[(stops > 0) & (stops < len(ids))].tolist(), len(ids)]
            last = 0
            for p in places:
                for x in range(last + INNER_STEP, p, INNER_STEP) if p - last > self.size // 4 else ():
                    at.append(base + x)
                    penalty.append(INNER_PENALTY)
                if p > last:
                    at.append(base + p)
                    penalty.append(SENTENCE_PENALTY)
                    last = p
            penalty[-1] = 0.0                # a document's end
            base += len(ids)
        return at, penalty

    def pack(self, rest: bool):
        """Windows as lists of pieces; unless ``rest``, the last one stays as the next start."""
        if not self.docs:
            return
        at, penalty = self._cuts()
        cuts = [at[i] for i in choose_cuts(at, penalty, self.size)]
        docs, self.docs, self.tokens = self.docs, [], 0
        k, base = 0, 0
        for w, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            keep = not rest and w == len(cuts) - 2
            window = []
            while lo < hi:
                doc_id, start, doc_tokens, ids, stops = docs[k]
                a, b = lo - base, min(hi - base, len(ids))
                if keep:
                    self.add(doc_id, start + a, doc_tokens, ids[a:b], stops[(stops > a) & (stops <= b)] - a)
                else:
                    window.append((doc_id, start + a, doc_tokens, ids[a:b]))
                lo = base + b
                if b == len(ids):
                    k, base = k + 1, base + len(ids)
            if not keep:
                yield window


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SIZE, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``sequence_id`` is unique and grows with the order inside a partition.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")

    def run(batches):
        coder, waiting = encoder(vocabulary), _Segment(size)
        sequence = TaskContext.get().partitionId() << 36
        id_type = None

        def rows(rest: bool):
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7)]
            for window in waiting.pack(rest):
                offset = 0
                for doc_id, start, doc_tokens, ids in window:
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    for c, v in zip(cols, (doc_id, start, len(ids), crc, doc_tokens, sequence, offset)):
                        c.append(v)
                    offset += len(ids)
                sequence += 1
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.ids(text.as_py() or "")
                stops = np.flatnonzero(coder.stop[ids]) + 1
                waiting.add(doc_id, 0, len(ids) + 1, np.append(ids, np.uint32(end_id)), stops)
                if waiting.tokens >= SEGMENT_TOKENS:
                    yield rows(False)
        if id_type is not None:
            yield rows(True)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
