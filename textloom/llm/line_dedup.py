"""Line deduplication: windows of three lines that were seen before are cut out, wherever they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _worded(lines: Column) -> Column:
    """Position and trimmed text of the lines that hold more than ASCII white space."""
    trimmed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\r\v\f")).alias("key")))
    return F.filter(trimmed, lambda s: s["key"] != "")


def _windows(worded: Column) -> Column:
    """A struct (w, h1, h2) for every three consecutive worded lines: ordinal of the first and 128 bits of hash."""

    def one(i: Column) -> Column:
        keys = [F.get(worded, i + k)["key"] for k in range(WINDOW)]
        return F.struct(i.alias("w"), F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit("second"), *keys).alias("h2"))

    ordinals = F.when(F.size(worded) >= WINDOW, F.sequence(F.lit(0), F.size(worded) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(ordinals, one)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines, clean_text for every row.

    Lines end at \\n; a line's text is compared without ASCII white space at its ends, and lines
    of nothing else are no part of windows and always stay. A window of three consecutive
    lines that occurs more than once, in one document or in many, keeps its first occurrence:
    that of the smallest id (nulls first), then of the smallest text hash, then the first in the
    text. Every line that any later occurrence covers goes, overlaps being merged;
    removed_lines holds their 0-based numbers in order.

    Repeated windows are found by one aggregation with partial minima, written to the shared
    folder and merge-joined back to the windows; both sides of the join are plain exchanges, so
    the engine splits a window that a third of all documents share. Joins don't turn into
    broadcasts on small tables: the plan is the same at every size. Texts are never collected together: only positions are, by document.

    Null text: null clean_text, 0 lines. Texts of fewer than three worded lines stay. Rows that
    repeat both id and text count as one document and get the same result. An empty table
    gives no rows; other columns are never read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    cut = base.withColumn("_worded", _worded(_lines(F.col("_text")))).withColumn("_win", F.explode(_windows(F.col("_worded"))))
    windows = cut.select("doc_id", "_th", "_win.w", "_win.h1", "_win.h2")
    place = F.struct("doc_id", "_th", "w")
    repeated = materialize(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first"), "repeated-windows")
    later = windows.join(repeated.hint("merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = materialize(later.groupBy("doc_id", "_th").agg(F.collect_set("w").alias("_covered")), "covered-lines")
    covered = covered.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_cth"), "_covered")
    joined = base.join(covered.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_cth")), "left").drop("_id", "_cth", "_th")
    joined = joined.withColumn("_all", F.when(F.col("_covered").isNotNull(), _lines(F.col("_text")))).withColumn("_worded", F.when(F.col("_covered").isNotNull(), _worded(F.col("_all"))))
    ordinals = F.array_sort(F.array_distinct(F.flatten(F.transform("_covered", lambda w: F.sequence(w, w + WINDOW - 1)))))
    joined = joined.withColumn("removed_lines", F.coalesce(F.transform(ordinals, lambda o: F.get("_worded", o)["at"]), F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("removed_lines"))
    clean = F.when(F.col("_covered").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_all", i)), "\n"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(_lines(F.col("_text"))))
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", clean.alias("clean_text"))
