import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import numbers
from textloom.plans import catalog, table_catalog  # noqa: F401

from compare import connection, rows_in_sql, rows_of


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).head()["o"]


def folds(spark, f):
    """How often the plan has the fold over a numeral; a copy inside a lambda is run once more for every mention."""
    plan = spark.createDataFrame([("x",)], "t string").select(f(F.col("t")).alias("o"))._jdf.queryExecution().analyzed().toString()
    return plan.count("aggregate(")


def test_numerals_are_folded_once(spark):
    assert folds(spark, numbers.rewrite_chapter_numerals) == 1
    assert folds(spark, numbers.cjk_to_number) == 1


def test_chapter_numerals_on_odd_lines(spark):
    cases = {
        "CHAPTER 9007199254740993: x": "CHAPTER 9007199254740993: x",  # whole numbers don't pass through a double
        "CCHAPTER 一:CHAPTER\n二: CHAPTER 三": "CCHAPTER 1:CHAPTER\n2: CHAPTER 三",
        "𝄞 CHAPTER 负三点五0: C": "𝄞 CHAPTER -3.5: C",
        "CHAPTER 二点〇: CHAPTER 点五:": "CHAPTER 2: CHAPTER 0.5:",
        "CHAPTER 3万5: CHAPTER 一2: CHAPTER 12三:": "CHAPTER 30005: CHAPTER 2: CHAPTER 3:",
        "CHAPTER -: CHAPTER 点: no": "CHAPTER 0: CHAPTER 0: no",
        "CHAPTER : x": "CHAPTER : x",
        "": "",
        None: None,
    }
    got = {t: one(spark, numbers.rewrite_chapter_numerals, t) for t in cases}
    assert got == cases


def test_spelled_numbers_are_folded_once(spark):
    assert folds(spark, numbers.words_to_number) == 1
    assert folds(spark, numbers.rewrite_chapter_words) == 2  # inside the line and at its end


def test_chapter_words_on_odd_lines(spark):
    cases = {
        "a chapter two, cCHAPTER\n Ten! Chapter five": "a chapter 2, cCHAPTER\n 10! Chapter 5",
        'Chapter "two, Chapter two" Chapter two.': 'Chapter "two, Chapter two" Chapter 2.',
        "Chapter chapter two: Chapter foo hundred, Chapter and": "Chapter chapter two: Chapter foo hundred, Chapter and",
        "Chapter xchapter two": "Chapter xchapter two",
        "Chapter hundred-thousand-and-one; 𝄞 Chapter twenty": "Chapter 100001; 𝄞 Chapter 20",
        "Chapter and six": "Chapter 6",
        "Chapter  ": "Chapter  ",
        "": "",
        None: None,
    }
    got = {t: one(spark, numbers.rewrite_chapter_words, t) for t in cases}
    assert got == cases


@pytest.mark.parametrize("name", ["chapter_words", "chapter_numerals", "words_to_number", "cjk_to_number"])
def test_part_queries_equal_their_sql_on_large_keys(spark, tmp_path, name):
    """Keys of over a million, as tables of 1 GB and more have."""
    duckdb.sql(f"COPY (SELECT 'small anvil' AS p_name, 'ECONOMY TIN' AS p_type, 7 AS p_size, k AS p_partkey FROM range(999999, 9999998, 9973) r(k)) TO '{tmp_path}/part.parquet'")
    assert rows_of(catalog.QUERIES[name](spark, str(tmp_path))) == rows_in_sql(connection(str(tmp_path)), catalog.ORACLE_SQL[name])
