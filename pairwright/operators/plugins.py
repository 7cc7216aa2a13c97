"""User plug-ins: a scorer (U2) and a proposer (U3), Arrow-batched.

A plug-in is a *factory* returning the callable, so a model is loaded once per
task, not once per row; rows travel in Arrow batches (pandas Series /
DataFrames), never one at a time.  Spark partitions the rows; the plug-in only
sees its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a proposer's texts are held for this much of a batch at a time
PART_ROWS = 500
PART_CHARS = 1 << 19

Scorer = Callable[[list[str]], list[float]]
Proposer = Callable[[list[str], int], list[list[str]]]


def score_with(df: DataFrame, text: str, make_scorer: Callable[[], Scorer],
               name: str = "reward_score") -> DataFrame:
    """Add ``name`` = scorer(text) computed batch by batch."""

    @F.pandas_udf("double")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_scorer()  # once per task
        for s in batches:
            yield pd.Series(fn(s.fillna("").tolist()), dtype="float64")

    return df.withColumn(name, _score(F.col(text)))


def _parts(b: pd.DataFrame, prompt: str) -> Iterator[pd.DataFrame]:
    """A batch in runs of rows with at most ``PART_ROWS`` rows and, but for a longer one alone, ``PART_CHARS`` characters."""
    first = chars = 0
    for i, size in enumerate(b[prompt].str.len().fillna(0)):
        if i > first and (i - first == PART_ROWS or chars + size > PART_CHARS):
            yield b.iloc[first:i]
            first, chars = i, 0
        chars += size
    if len(b) > first:
        yield b.iloc[first:]


def propose_with(df: DataFrame, key: str, prompt: str, make_proposer: Callable[[], Proposer],
                 n: int = 8) -> DataFrame:
    """``n`` generated texts per prompt -> key, text_no (1..n), text, prompt."""
    key_type = dict(df.dtypes)[key]

    def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_proposer()  # once per task
        for b in (part for whole in batches for part in _parts(whole, prompt)):
            texts = fn(b[prompt].fillna("").tolist(), n)
            out = pd.DataFrame({
                key: b[key].repeat([len(t) for t in texts]).to_numpy(),
                "text_no": [i + 1 for t in texts for i in range(len(t))],
                "text": [x for t in texts for x in t],
                prompt: b[prompt].repeat([len(t) for t in texts]).to_numpy(),
            })
            yield out

    schema = f"{key} {key_type}, text_no int, text string, {prompt} string"
    return df.select(key, prompt).mapInPandas(_run, schema)


# ---- small example plug-ins used by the registered queries -------------

def lexical_variety_scorer() -> Scorer:
    """Distinct tokens / tokens (0 for empty texts)."""
    def fn(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            toks = t.split()
            out.append(len(set(toks)) / len(toks) if toks else 0.0)
        return out
    return fn


def recent_move_proposer() -> Proposer:
    """Continues a prompt with each of its most recent distinct moves, newest first."""
    def fn(prompts: list[str], n: int) -> list[list[str]]:
        out = []
        for p in prompts:
            seen, picks = set(), []
            for tok in reversed(p.split()):
                if tok not in seen:
                    seen.add(tok)
                    picks.append(tok)
                if len(picks) == n:
                    break
            out.append([f"{p} {m}" for m in picks])
        return out
    return fn
