import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import punctuation
from textloom.plans import catalog, table_catalog  # noqa: F401

from compare import connection, rows_in_sql, rows_of

TEXTS = ["ßheit, und so. weiter", "ᾳδης. b", "ǰa. b", "élan. x", "Öl", "", "1. x"]


def test_normalise_query_equals_its_sql_on_letters_with_long_capitals(spark, tmp_path):
    values = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(TEXTS))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) AS d(doc_id, text)) TO '{tmp_path}/documents.parquet'")
    got = rows_of(catalog.QUERIES["punct_normalise_full"](spark, str(tmp_path)))
    assert got == rows_in_sql(connection(str(tmp_path)), catalog.ORACLE_SQL["punct_normalise_full"])


def test_first_letters_have_full_or_simple_capitals(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS[:4]], "t string")
    both = df.select(*(punctuation.capitalise_sentences(F.col("t"), c).alias(c) for c in ("full", "simple"))).collect()
    assert [r["full"] for r in both] == ["SSheit, und so. Weiter", "ΑΙδης. B", "J̌a. B", "Élan. X"]
    assert [r["simple"] for r in both] == ["ẞheit, und so. Weiter", "ᾼδης. B", "ǰa. B", "Élan. X"]
    with pytest.raises(ValueError):
        punctuation.capitalise_sentences(F.col("t"), "none")


def test_the_chain_is_computed_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(punctuation.normalise(F.col("t"), with_nfkc=False, capitals="simple").alias("o"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 20  # before: 140, as each mention of the text repeated them
