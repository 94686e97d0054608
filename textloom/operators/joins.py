"""Joins by position, by address and by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.strings import strip_fragment
from textloom.operators.ranking import global_rank


def zip_by_position(left: DataFrame, right: DataFrame, left_order: list, right_order: list, by: list[str] | None = None) -> DataFrame:
    """left and right rows of the same rank side by side, up to the shorter; ranks by `by`, or over whole tables."""
    if not by:
        return global_rank(left, left_order).join(global_rank(right, right_order), "rn")
    a = left.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)))
    return a.join(b, [*by, "rn"])


def href_lookup(links: DataFrame, items: DataFrame, href: str = "href", item_href: str = "item_href") -> DataFrame:
    """links with the item their address without fragment names, null where there is none."""
    return links.withColumn(item_href, strip_fragment(F.col(href))).join(items, item_href, "left")


def lookup_or(rows: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """value by key, with a default for misses."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def spine_items(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Items in reading order with number 1, 2, ... by book; spine entries without an item are skipped."""
    joined = spine.join(items, ["book_id", "item_id"])
    return joined.withColumn("number", F.row_number().over(Window.partitionBy("book_id").orderBy("pos")))


def merge_cleaned(original: DataFrame, cleaned: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """original with the cleaned content where there is some; empty or failed content leaves it as it was."""
    new = cleaned.select(*keys, F.col(content).alias("_new"))
    return original.join(new, keys, "left").withColumn(content, F.when(F.length("_new") > 0, F.col("_new")).otherwise(F.col(content))).drop("_new")


def natural_order(name: Column, number: Column) -> list[Column]:
    """By the last number in the name, names without one last, then by name."""
    return [number.asc_nulls_last(), name.asc()]
