"""Driver contract: entry() runs; every query has an oracle or is a named rows-only step;
a sample of queries equals its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

# a fitted model: held to an accuracy floor in test_models instead
ROWS_ONLY = {"reward_fit_eval"}
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["source", "n_pairs", "n_rejected_moves"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_rows_only():
    own = set(E.queries()) - set(E.LLM_QUERIES)
    assert own - set(E.oracle_sql()) == ROWS_ONLY
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["doc_pairs", "game_quality_report", "sft_games", "expert_ranks",
                                  "conversation_pairs", "label_pairs", "student_pairs", "rl_prompts",
                                  "corpus_expert", "evaluation_records", "plugin_pairs", "reward_scores", "opening_cap"])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(rel.fetchall(), rel.columns)
