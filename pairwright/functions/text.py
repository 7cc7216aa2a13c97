"""Scalar column helpers on token sequences and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_space(text) -> Column:
    """Whitespace runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def tokens(text) -> Column:
    """Whitespace tokens, empties removed (B2: move = whitespace token).

    Same result as ``filter(split(text, '\\s+'), x -> x <> '')`` without a
    per-element lambda: one regex pass, a single-character split, and the
    one empty token of an empty text removed.
    """
    return F.array_remove(F.split(normalise_space(text), " "), "")


def to_sequence(moves) -> Column:
    """Moves joined by one space; empty array gives ''."""
    return F.array_join(_c(moves), " ")


def prefix(moves, k) -> Column:
    """prompt = first k moves joined by a space (k may be 0)."""
    k = _c(k) if not isinstance(k, int) else F.lit(k)
    return F.when(k <= 0, F.lit("")).otherwise(F.array_join(F.slice(_c(moves), 1, k), " "))


def rl_prompt_len(n) -> Column:
    """min(20, max(16, n div 2))."""
    return F.least(F.lit(20), F.greatest(F.lit(16), F.floor(_c(n) / 2).cast("int")))


def prompt_or_default(p, default: str = "1.") -> Column:
    """P8 (D10): empty or null prompt becomes ``1.`` in every place it is used."""
    return F.coalesce(F.nullif(_c(p), F.lit("")), F.lit(default))


def join_prompt(prompt, move) -> Column:
    """Prompt + ' ' + move.  ``concat`` keeps null prompts null."""
    return F.concat(_c(prompt), F.lit(" "), _c(move))


def strip_prompt(text, prompt, mode: str = "prefix") -> Column:
    """P11 (D9): remove the prompt from a continuation.

    ``prefix`` removes it only when the text starts with it; ``all`` removes
    every occurrence, as plain string replacement does.
    """
    t, p = _c(text), _c(prompt)
    if mode == "all":
        return F.when(p == "", t).otherwise(F.replace(t, p, F.lit("")))
    return F.when(F.startswith(t, p), F.substring(t, F.length(p) + 1, F.lit(2 ** 31 - 1))).otherwise(t)


def first_token(c, sep: str = "any") -> Column:
    """First token after trimming, by any whitespace or by one space."""
    t = F.trim(_c(c))
    parts = F.split(t, r"\s+") if sep == "any" else F.split(t, " ")
    return F.when(t == "", F.lit(None)).otherwise(F.try_element_at(parts, F.lit(1)))


def drop_move_numbers(c) -> Column:
    """P15 (D17): drop tokens that contain a dot, e.g. ``1. e4 e5`` -> ``e4 e5``."""
    toks = F.filter(F.split(F.trim(_c(c)), r"\s+"), lambda x: (x != "") & ~x.contains("."))
    return F.array_join(toks, " ")
