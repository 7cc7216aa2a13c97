"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole.  Its tokens' character spans are
joined with the character spans of its sections, both in order, by binary search
inside the task: neither tokens nor documents leave it, only the counts.

A token belongs to the section that holds most of its characters (of equals, the
first).  A token that touches no section (separators) goes to the section before
it, or to the first one if there is none.  So the counts of a document's sections
add up to its tokens.

Sections are lines that are not blank, unless a column of spans is given; spans
are taken by start, a span's part that an earlier one covers is cut off, and
empty ones get no tokens of their own.  A text without a section counts as one
section.  Null or empty text: one section without tokens.  Repeated rows and null
ids are counted like any others; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import default_vocabulary, encoder

_LINE = re.compile(r"[^\n]*[^\s][^\n]*")
BATCH_ROWS = 50_000        # counts sent on at once


def line_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _LINE.finditer(text)]


def _ordered(spans, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans inside the text that do not overlap; the whole text if there is none."""
    out, at = [], 0
    for a, b in sorted((max(0, a), min(length, b)) for a, b in spans):
        a = max(a, at)
        out.append((a, max(a, b)))
        at = max(at, b)
    starts, ends = np.array(out or [(0, length)], dtype=np.int64).T
    return starts, ends


def attribute(left: np.ndarray, right: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether the token reaches beyond it."""
    first = np.searchsorted(ends, left, side="right")            # the first that ends behind the token's start
    last = np.searchsorted(starts, right, side="left")           # the first that begins behind its end
    best, most = np.maximum(first, 1) - 1, np.zeros(len(left), dtype=np.int64)
    for k in range(int(max(0, (last - first).max(initial=0)))):
        i = np.minimum(first + k, len(starts) - 1)
        shared = np.where(first + k < last, np.minimum(right, ends[i]) - np.maximum(left, starts[i]), 0)
        better = shared > most
        best, most = np.where(better, i, best), np.where(better, shared, most)
    return best, (most > 0) & (most < right - left)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   sections_col: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per section: ``id_col, section, start, end, n_tokens, n_crossing, doc_tokens``.

    ``sections_col``: an array of structs whose first two fields are start and end, in
    characters; default: lines that are not blank.  ``n_crossing`` counts the section's
    tokens that reach over its bounds.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            ids, cols = [], [[] for _ in names]

            def out():
                made = [pa.array(ids, batch.schema.field(0).type)]
                made += [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols]
                return pa.RecordBatch.from_arrays(made, [id_col, *names])

            spans = batch.column(2).to_pylist() if sections_col else None
            for r, (doc_id, cell) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text = cell.as_py() or ""
                given = [tuple(s.values())[:2] for s in spans[r] or () if s] if sections_col else line_spans(text)
                starts, ends = _ordered([g for g in given if None not in g], len(text))
                tokens = coder.ids(text)
                section, crossing = attribute(*coder.spans(text, tokens), starts, ends)
                n = len(starts)
                values = (np.arange(n), starts, ends, np.bincount(section, minlength=n),
                          np.bincount(section[crossing], minlength=n), np.full(n, len(tokens)))
                ids.extend([doc_id] * n)
                for c, v in zip(cols, values):
                    c.append(v)
                if len(ids) >= BATCH_ROWS:
                    yield out()
                    ids, cols = [], [[] for _ in names]
            yield out()

    wanted = [id_col, text_col] + ([sections_col] if sections_col else [])
    return docs.select(*wanted).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))
