"""Registry of named queries and their DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables.  Output conventions shared with the oracle: integer columns are
bigint, fractional columns are double rounded to 6 places, dates are text.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.hashing import sql_hash32

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---- DuckDB snippets (oracle side) -------------------------------------

def H(seed, expr: str) -> str:
    return sql_hash32(seed, expr)


def TOKENS(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array({expr}, '\s+'), lambda x: x <> '')"


SEQS = f"""
seqs AS (
  SELECT doc_id, lang, source, {TOKENS('text')} AS moves FROM documents
),
seqs_n AS (SELECT *, len(moves) AS n_plies FROM seqs)"""


def BOUNDS(src: str, n: str = "n_plies") -> str:
    """Columns lo, hi of the position rule (null when no position)."""
    lo1 = f"(CASE WHEN {n} <= 20 THEN 6 ELSE greatest(8, {n} // 6) END)"
    hi1 = f"(CASE WHEN {n} <= 20 THEN {n} - 1 ELSE least(40, (5 * {n}) // 6) END)"
    lo2 = f"(CASE WHEN {lo1} >= {hi1} THEN greatest(3, {n} // 3) ELSE {lo1} END)"
    hi2 = f"(CASE WHEN {lo1} >= {hi1} THEN {n} - 1 ELSE {hi1} END)"
    ok = f"({n} >= 10 AND {lo2} < {hi2})"
    return (f"SELECT *, CASE WHEN {ok} THEN {lo2} END AS lo, "
            f"CASE WHEN {ok} THEN {hi2} END AS hi FROM {src}")
