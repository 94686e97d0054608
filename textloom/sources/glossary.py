"""Glossaries: key=value lines, read under two sets of rules, merged by priority, and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.strings import strip
from textloom.operators.ranking import global_rank


def _pair(line: Column) -> tuple[Column, Column]:
    parts = F.split(line, "=", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def first_wins(lines: DataFrame) -> DataFrame:
    """line_no, k, v: blank, # and =-less lines skipped, both sides trimmed, empty keys dropped, the first of a key kept.

    A byte-order mark at the start of the first line is ignored.
    """
    text = strip(F.regexp_replace("line", "^﻿", ""))
    k, v = _pair(text)
    rows = lines.where((text != "") & ~F.startswith(text, F.lit("#")) & F.contains(text, F.lit("="))).select("line_no", strip(k).alias("k"), strip(v).alias("v")).where("k <> ''")
    return rows.groupBy("k").agg(F.min("line_no").alias("line_no"), F.min_by("v", "line_no").alias("v")).select("line_no", "k", "v")


def last_wins(lines: DataFrame, file_col: str | None = None) -> DataFrame:
    """[file], line_no, k, v: no comment rule, the line trimmed as a whole, empty keys allowed; the last value of a key at its first place."""
    k, v = _pair(strip(F.col("line")))
    by = [file_col] if file_col else []
    rows = lines.where(F.contains("line", F.lit("="))).select(*by, "line_no", k.alias("k"), v.alias("v"))
    return rows.groupBy(*by, "k").agg(F.min("line_no").alias("line_no"), F.max_by("v", "line_no").alias("v")).select(*by, "line_no", "k", "v")


def merge(glossaries: DataFrame) -> DataFrame:
    """k, v, file_ord, line_no: the value of the first file that has a key. Input: file_ord, line_no, k, v."""
    place = F.struct("file_ord", "line_no")
    return glossaries.groupBy("k").agg(F.min_by("v", place).alias("v"), F.min(place).alias("_p")).select("k", "v", "_p.file_ord", "_p.line_no")


def ranked(merged: DataFrame) -> DataFrame:
    """merged with rank: longer keys first, then in the order read."""
    return global_rank(merged, [F.length("k").desc(), F.col("file_ord"), F.col("line_no")], "rank")


def conflicts(glossaries: DataFrame, faithful: bool = True) -> DataFrame:
    """k, file_ord, v: every later value that differs from the winner, and the winner itself.

    In faithful mode the winner is filed under the first file even if a later one brought it.
    The winner comes from a pre-aggregated minimum joined back, not from a window over the key.
    """
    won = merge(glossaries).select("k", F.col("v").alias("_won"), F.col("file_ord").alias("_own"))
    rows = glossaries.join(won, "k").where("v <> _won")
    filed = glossaries.agg(F.min("file_ord")).scalar() if faithful else F.col("_own")
    winners = rows.select("k", "_won", "_own").distinct().select("k", filed.alias("file_ord"), F.col("_won").alias("v"))
    return rows.select("k", "file_ord", "v").unionByName(winners)


def conflict_maps(glossaries: DataFrame, faithful: bool = True) -> DataFrame:
    """k, versions: file_ord to value, in file order."""
    pairs = F.array_sort(F.collect_list(F.struct("file_ord", "v")))
    return conflicts(glossaries, faithful).groupBy("k").agg(F.map_from_entries(pairs).alias("versions"))


def as_lines(merged: DataFrame) -> DataFrame:
    """rank, line: the merged glossary in the form it is read in."""
    return ranked(merged).select("rank", F.concat_ws("=", "k", "v").alias("line"))


def conflict_report(glossaries: DataFrame) -> DataFrame:
    """k, text: one block of the conflict report a key."""
    rows = conflicts(glossaries)
    lines = F.array_sort(F.collect_list(F.struct("file_ord", F.concat(F.lit("  -- "), F.col("file_ord").cast("string"), F.lit(": "), "v").alias("l"))))
    return rows.groupBy("k").agg(F.concat(F.lit("Key: "), F.first("k"), F.lit("\n"), F.array_join(F.transform(lines, lambda s: s["l"]), "\n")).alias("text"))
