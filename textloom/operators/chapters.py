"""Blocks of a document to the chapters of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import html
from textloom.functions.strings import strip
from textloom.operators.sequence import heading_1_within, titled_sections


def chapters(blocks: DataFrame, doc: str = "path", pos: str = "pos") -> DataFrame:
    """doc, chap_id (0, 1, ...), title, html, images: one row a chapter that has a block.

    A chapter starts at a paragraph whose style has "heading 1" in it. Its blocks' HTML is
    joined by line feeds; a blank paragraph is left out only while the chapter has had no image.
    """
    head = F.coalesce((F.col("kind") == "p") & heading_1_within(F.col("style")), F.lit(False))
    rows = titled_sections(blocks.withColumn("text", strip(F.col("text"))), head, "text", doc, pos)
    so_far = Window.partitionBy(doc, "section").orderBy(pos)
    rows = rows.withColumn("_seen", F.max((F.size("images") > 0).cast("int")).over(so_far) == 1)
    rows = rows.withColumn("_html", F.when(F.col("kind") == "tbl", html.table(F.col("rows"), html.spans)).otherwise(html.block(F.col("style"), html.spans(F.col("spans")), F.col("_seen"))))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_html").alias("h"))))
    images = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("images").alias("i")))), lambda s: s["i"]))
    out = rows.groupBy(doc, "section").agg(F.min_by("title", pos).alias("title"), F.array_join(F.transform(parts, lambda s: s["h"]), "\n").alias("html"), images.alias("images"))
    return out.withColumn("chap_id", F.row_number().over(Window.partitionBy(doc).orderBy("section")) - 1).drop("section")


def with_heading(title: Column, body: Column) -> Column:
    """A chapter's page body; the title stands as it is, unescaped."""
    return F.concat(F.lit("<h1>"), title, F.lit("</h1>"), body)


def book(blocks: DataFrame, properties: DataFrame, doc: str = "path") -> DataFrame:
    """doc, chap_id, title, html, images, book_title, author: what the book writer takes."""
    rows = chapters(blocks, doc).withColumn("html", with_heading(F.col("title"), F.col("html")))
    return rows.join(properties.withColumnRenamed("title", "book_title"), doc)
