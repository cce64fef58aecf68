"""Queries with a SQL form against DuckDB."""

import duckdb
import pytest
from checks.compare import differences

from platewise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "labels", "benchmark", "embeddings"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert differences(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name]) == []


def test_license_sql_on_other_names(spark, tmp_path, rail):
    from platewise.llm import license_scan

    rows = spark.createDataFrame(list(enumerate(rail)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = license_scan.op9_license_scan(spark, str(tmp_path))
    assert differences(found, connection, queries.oracle_sql()["op9_license_scan"]) == []


def test_license_sql_on_planted_lines(spark, tmp_path, licenses):
    from platewise.llm import license_scan

    rows = [(i, t) for i, t in enumerate([*licenses, " ".join(licenses) * 2, None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = license_scan.op9_license_scan(spark, str(tmp_path))
    assert differences(found, connection, queries.oracle_sql()["op9_license_scan"]) == []
