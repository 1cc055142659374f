"""Driver contract: entry smoke, registry shape, and oracle parity on the smallest fixture."""

import duckdb
import pytest

import __spark_entry__ as E

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and {"doc_id", "added", "deleted", "changed", "unchanged"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["blocks_from_text", "doc_status", "rebuild_new", "rebuild_old", "inline_diff",
                                  "table_diff", "snapshot_cell_diff", "text_predicates", "text_cosine",
                                  "semantic_score", "embedding_cosine", "score_bonus", "labels", "route_files", "big_table_diff", "key_collisions"])
def test_oracle_parity_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    exp = sorted(tuple(str(dict(zip(ocols, r))[c]) for c in cols) for r in res.fetchall())
    assert sorted(ocols) == cols
    assert got == exp
