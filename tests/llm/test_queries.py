import pytest
from textloom.llm import queries

from compare import connection, rows_in_sql, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_in_sql(connection(sf_dir), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_returns_whole_tables(spark, sf_dir, name):
    n = queries.QUERIES[name](spark, sf_dir).count()
    assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count() if name != "op7_decontamination" else n > 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_source_mixing", "op5_url_filters", "op8_license_scan", "op9_quality_rules"])
def test_native_plans_have_no_python(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
