"""Every registered query with SQL against DuckDB on the same tables; those without run and give rows."""

import math

import duckdb
import pytest

from loomwright.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODELS = {"lda_topics", "lda_document_topics", "keyphrase_model", "rf_upsell", "rf_upsell_auc", "spline_logit", "stacked_rf", "local_additive", "cluster_rf", "sparse_code_fit", "sparse_code_encode"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    want = sorted(tuple(map(plain, r)) for r in found.select(*(f'"{c}"' for c in columns)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_leaves_out_what_is_not_there(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["conv_id", "phrase", "weight", "rank"]
