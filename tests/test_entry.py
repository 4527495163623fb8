"""A part of the registered queries against their SQL on the smallest data; check.py runs all of them."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["b2_knn_exact", "b5_word_overlap", "c3_unique_mapping", "p5_dataset_profile", "t5_best_row", "t13_curve_auc",
         "x4_jaccard", "h3_wilcoxon", "l5_validation_split", "j1_token_blocks"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    import duckdb

    import check
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert check.canonical(df.columns, [tuple(r) for r in df.collect()]) == check.canonical(cols, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() == 1
