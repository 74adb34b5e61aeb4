"""Entropy queries give their SQL's rows for null and empty texts, and for ids that repeat or are null."""

import duckdb
import pytest

from cairnstore.plans.queries import ORACLES, QUERIES

HALF = "abcdefghijklmnop" + "qrstuvwx" * 2  # 4.5 bits a byte exactly
ROWS = [(1, "some words"), (2, None), (3, ""), (4, "ab"), (4, "bcd"), (5, "x"), (5, None), (5, ""), (None, "no id"), (None, "none"), (6, HALF), (7, HALF + "y"), (8, "é€")]


@pytest.mark.parametrize("name", ["byte_entropy", "store_raw_classifier"])
def test_odd_rows(spark, tmp_path, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = duck.sql(ORACLES[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    assert len(want.fetchall()) == 7
