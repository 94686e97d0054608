"""Aggregates and fixed-width reports over chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.html import strip_html
from textloom.operators.ranking import global_rank

NUMBER_WIDTH, NAME_WIDTH, COUNT_WIDTH = 10, 60, 20


def chapter_counts(items: DataFrame, order: str, html: str = "html", by: list[str] | None = None) -> DataFrame:
    """items with number and char_count (characters of the text without markup) in place of the markup; numbers by `by`, or over all."""
    counted = items.withColumn("char_count", F.length(strip_html(F.col(html))).cast("long")).drop(html)
    if not by:
        return global_rank(counted, [order], "number")
    return counted.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))


def totals(chapters: DataFrame, by: str) -> DataFrame:
    """by, n_chapters, total_chars; the grand total has a null key. One pass, partial sums first."""
    return chapters.rollup(by).agg(F.count(F.lit(1)).alias("n_chapters"), F.sum("char_count").alias("total_chars"))


def _line(name: str) -> Column:
    """Names cut and padded to 60, counts with thousands marks to the right."""
    count = F.lpad(F.format_number("char_count", 0), COUNT_WIDTH, " ")
    return F.concat_ws(" | ", F.rpad(F.col("number").cast("string"), NUMBER_WIDTH, " "), F.rpad(F.substring(name, 1, NAME_WIDTH), NAME_WIDTH, " "), count)


def report_rows(chapters: DataFrame, name: str) -> DataFrame:
    """number, line: the report's rows."""
    return chapters.select("number", _line(name).alias("line"))


def report(chapters: DataFrame, name: str, by: str) -> DataFrame:
    """by, text: the whole report of each book that has chapters; EMPTY_REPORT is the text of one that has none."""
    header = " | ".join(("Chapter #".ljust(NUMBER_WIDTH), "XHTML File Name".ljust(NAME_WIDTH), "Character Count".rjust(COUNT_WIDTH)))
    rule = "-" * (NUMBER_WIDTH + NAME_WIDTH + COUNT_WIDTH + 6)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", _line(name).alias("line")))), lambda s: s["line"])
    chapter_total = F.concat(F.lit("Total Chapters Analyzed: "), F.count(F.lit(1)).cast("string"))
    character_total = F.concat(F.lit("Total Characters in Book: "), F.format_number(F.sum("char_count"), 0))
    whole = F.concat_ws("\n", F.lit("--- EPUB Analysis Report ---"), F.lit(header), F.lit(rule), F.array_join(lines, "\n"), F.lit(rule), chapter_total, character_total)
    return chapters.groupBy(by).agg(whole.alias("text"))


EMPTY_REPORT = "No readable chapters found in the EPUB file."
