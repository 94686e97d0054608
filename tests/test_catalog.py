import pytest

import __spark_entry__ as entry
from textloom.plans import catalog, table_catalog  # noqa: F401

from compare import connection, rows_in_sql, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got = rows_of(catalog.QUERIES[name](spark, sf_dir))
    assert got == rows_in_sql(con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.EXAMPLES))
def test_example_has_its_rows(spark, sf_dir, con, name):
    f, sql = catalog.EXAMPLES[name]
    assert rows_of(f(spark, sf_dir)) == rows_in_sql(con, sql)


def test_without_the_training_data_libraries():
    """The engine's own queries stay if a library of the optional part is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0], check=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = catalog.QUERIES["url_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = catalog.QUERIES["language_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lang" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
