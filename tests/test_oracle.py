"""Every query of the engine with an oracle equals DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from tallyloom import registry


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


def compare(spark, duck, sf, fn, sql):
    got = fn(spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(normal(r[c]) for c in columns) for r in got.collect()), key=repr)
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(normal(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, sf_small, name):
    compare(spark, duck, sf_small, registry.queries()[name], registry.oracle_sql()[name])


def test_bank_rejects_blank_stems_and_repeated_tags(spark, tmp_path):
    docs = [(1, "", "short", 0), (2, " " * 60, "src1", 60), (3, "ab", "src1", 2), (4, None, "short", 2), (5, None, "src1", 2), (6, "x" * 60, "short", 60), (7, "y" * 60, "src1", 60), (8, "", "src1", 0), (9, None, None, None)]
    spark.createDataFrame([(i, text, "en", source, n) for i, text, source, n in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0), (7, 0), (8, 0), (1, 1), (9, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    compare(spark, con, str(tmp_path), registry.queries()["bank_rejects"], registry.oracle_sql()["bank_rejects"])
