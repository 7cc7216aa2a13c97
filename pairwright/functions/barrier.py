"""Compute expensive columns once per row.

Catalyst substitutes a column's defining expression wherever the column is
used: in later projections and in filters it pushes down, including the
``IS NOT NULL`` filters it infers for join keys.  A parsed move list used by
ten bound expressions is then parsed ten times per row, and the generated
code can outgrow the JVM's 64 KB method limit.  Producing the columns through
a one-element ``inline`` generator makes them plain attributes: nothing is
substituted through a Generate, so each expression runs once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str] | None = None, **cols: Column) -> DataFrame:
    """``df`` (columns ``keep``, default all) plus ``cols``, each evaluated once per row."""
    keep = df.columns if keep is None else keep
    # evaluate in an ordinary (code-generated) projection, then pass plain
    # attributes through the generator
    tmp = {k: f"__once_{k}" for k in cols}
    staged = df.select(*keep, *[c.alias(tmp[k]) for k, c in cols.items()])
    return staged.select(*keep, F.inline(F.array(F.struct(*[F.col(tmp[k]).alias(k) for k in cols]))))
