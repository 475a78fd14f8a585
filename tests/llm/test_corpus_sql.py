"""Corpus queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from loomspark.llm import queries

SF = "/root/testdata/sf0.001"
NEW = ["op11_odd_sketches", "op12_auction_repair", "op13_coordinate_pruning", "base_line_counts", "base_secret_spans"]


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(str, r)) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", NEW)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) and rows(got) == rows(con.sql(queries.ORACLE_SQL[name]).df())
