"""Operators over ordered rows. Each works by document on an explicit position column.

Pure windows sort a document's rows and keep nothing in memory. The state of re-flow resets at
places that only the scan itself finds: it passes over sorted rows once, with three values
between them. Only the run operators in runs.py hold an array, that of one paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.numbers import clean_chapter_title
from textloom.functions.strings import CLOSING_QUOTES, TERMINATORS, ends_with_any, is_bracketed, line_key, sentence_ends, smart_join, strip


def _order(doc: str, pos: str):
    return Window.partitionBy(doc).orderBy(pos)


def heading_1(style: Column) -> Column:
    return style == "Heading 1"


def heading_1_any_case(style: Column) -> Column:
    return F.lower(style) == "heading 1"


def heading_1_within(style: Column) -> Column:
    return F.contains(F.lower(style), F.lit("heading 1"))


def heading_prefix(style: Column) -> Column:
    return F.startswith(style, F.lit("Heading"))


def heading_or_title(style: Column) -> Column:
    return F.rlike(style, F.lit("Heading|Title|Subtitle"))


def drop_alternate_repeats(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line", mode: str = "faithful") -> DataFrame:
    """Of a run of k lines with equal keys the 1st, 3rd, 5th ... stay; mode="fixed" keeps only the first.

    The lines stay as they were; only their keys are trimmed and stripped of end punctuation.
    Null lines count as blank.
    """
    keyed = lines.withColumn("_key", F.coalesce(line_key(F.col(line)), F.lit("")))
    keyed = keyed.withColumn("_new", F.when(F.lag("_key").over(_order(doc, pos)).eqNullSafe(F.col("_key")), 0).otherwise(1))
    # a line's place in its run is its rank less that of the run's first line: one sort for all windows
    keyed = keyed.withColumn("_rank", F.row_number().over(_order(doc, pos)))
    keyed = keyed.withColumn("_nth", F.col("_rank") - F.max(F.when(F.col("_new") == 1, F.col("_rank"))).over(_order(doc, pos)) + 1)
    kept = keyed.where("_nth % 2 = 1" if mode == "faithful" else "_nth = 1")
    return kept.drop("_key", "_new", "_rank", "_nth")


def sections(rows: DataFrame, is_heading: Column, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """rows with section (1, 2, ...); rows before the first heading go."""
    marked = rows.withColumn("section", F.sum(F.coalesce(is_heading.cast("int"), F.lit(0))).over(_order(doc, pos)))
    return marked.where("section > 0")


def titled_sections(rows: DataFrame, is_heading: Column, text: str = "text", doc: str = "doc_id", pos: str = "pos", front: str = "Front Matter") -> DataFrame:
    """Body rows with section (0 is the front) and title; headings become titles, so a section without body rows is gone."""
    marked = rows.withColumn("_head", F.coalesce(is_heading, F.lit(False))).withColumn("section", F.sum(F.col("_head").cast("int")).over(_order(doc, pos)))
    marked = marked.withColumn("title", F.coalesce(F.last(F.when(F.col("_head"), F.col(text)), ignorenulls=True).over(_order(doc, pos)), F.lit(front)))
    return marked.where("NOT _head").drop("_head")


def section_texts(rows: DataFrame, text: str = "text", doc: str = "doc_id", pos: str = "pos", separator: str = "\n") -> DataFrame:
    """doc, section, n_rows, text: the rows of each section joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(text).alias("_x"))))
    return rows.groupBy(doc, "section").agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.transform(ordered, lambda s: s["_x"]), separator).alias("text"))


def merge_repeated_headings(rows: DataFrame, is_heading: Column, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Headings without their part marks; a heading equal to the last one kept goes, its body stays.

    All headings of a run of equal ones but the first go, so comparing with the previous
    heading is comparing with the last kept.
    """
    heads = rows.where(is_heading).withColumn(text, clean_chapter_title(F.col(text)))
    heads = heads.withColumn("_last", F.lag(text).over(_order(doc, pos))).where(~F.col(text).eqNullSafe(F.col("_last"))).drop("_last")
    return rows.where(~F.coalesce(is_heading, F.lit(False))).unionByName(heads)


def merge_report(rows: DataFrame, is_heading: Column, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, removed, text: the report on merge_repeated_headings, for every document with a heading."""
    heads = rows.where(is_heading).select(doc, pos, strip(F.col(text)).alias("_old"), clean_chapter_title(F.col(text)).alias("_new"))
    heads = heads.withColumn("_gone", F.coalesce(F.lag("_new").over(_order(doc, pos)) == F.col("_new"), F.lit(False)))
    line = F.concat(F.lit("Merged: '"), "_old", F.lit("' -> into -> '"), "_new", F.lit("'\n"))
    lines = F.array_sort(F.collect_list(F.when(F.col("_gone"), F.struct(F.col(pos).alias("p"), line.alias("l")))))
    head = F.concat(F.lit("Merge Report\n" + "=" * 20 + "\nTotal redundant headers removed: "), F.count_if("_gone").cast("string"), F.lit("\n\n"))
    return heads.groupBy(doc).agg(F.count_if("_gone").alias("removed"), F.concat(head, F.array_join(F.transform(lines, lambda s: s["l"]), "")).alias("text"))


def join_until_terminator(rows: DataFrame, is_heading: Column, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, pos, is_heading, text: lines joined without a separator up to a terminator; headings stand alone, blank rows go.

    pos is the position of a joined row's first line.
    """
    some = rows.withColumn("_head", F.coalesce(is_heading, F.lit(False))).withColumn("_t", strip(F.col(text))).where("_t <> ''")
    ends = F.col("_head") | ends_with_any(F.col("_t"), TERMINATORS)
    some = some.withColumn("_starts", F.coalesce(F.lag(ends.cast("int")).over(_order(doc, pos)), F.lit(0)) + F.when(F.col("_head"), 1).otherwise(0))
    some = some.withColumn("_group", F.sum("_starts").over(_order(doc, pos)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_t").alias("t"))))
    joined = some.groupBy(doc, "_group").agg(F.min(pos).alias(pos), F.bool_or("_head").alias("is_heading"), F.array_join(F.transform(parts, lambda s: s["t"]), "").alias("text"))
    return joined.drop("_group")


def reflow_groups(rows: DataFrame, sentences: int = 4, is_heading: Column | None = None, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, pos, text, group: lines dealt to paragraphs of about so many sentences; blank lines go.

    A paragraph ends once it holds that many sentence ends, or with a closing quote. Headings
    and bracketed lines stand alone and end what precedes. The count restarts at every end, so
    a document's lines are passed over once in order: documents are dealt to partitions and
    sorted by the engine, and the pass keeps three values between lines, whatever the length.
    """
    head = F.coalesce(is_heading, F.lit(False)) if is_heading is not None else F.lit(False)
    trimmed = strip(F.col(text))
    alone = F.coalesce(head | is_bracketed(F.col(text)), F.lit(False))
    ends = F.when(head, 0).otherwise(F.coalesce(sentence_ends(F.col(text)), F.lit(0))).cast("int")
    quote = F.coalesce(ends_with_any(trimmed, CLOSING_QUOTES), F.lit(False))
    marked = rows.where((trimmed != "") | head).select(doc, pos, F.col(text).alias("text"), alone.alias("_alone"), ends.alias("_n"), quote.alias("_quote"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group, count, closed = object(), 0, 0, True
        for batch in batches:
            own, bare, n, quoted = (batch.column(k).to_pylist() for k in (0, 3, 4, 5))
            groups = []
            for d, a, k, q in zip(own, bare, n, quoted, strict=True):
                if d != here:
                    here, group, count, closed = d, 0, 0, True
                if closed or a:  # what stands alone closes what is open
                    group, count = group + 1, 0
                count += k
                closed = a or q or count >= sentences
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(groups, pa.int32())], [doc, pos, "text", "group"])

    schema = ", ".join(f"`{c}` {t}" for c, t in marked.select(doc, pos, "text").dtypes) + ", group int"
    return marked.repartition(doc).sortWithinPartitions(doc, pos).mapInArrow(run, schema)


def reflow(rows: DataFrame, sentences: int = 4, is_heading: Column | None = None, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, group, n_lines, text: the paragraphs of reflow_groups, joined with a space where one is needed."""
    groups = reflow_groups(rows, sentences, is_heading, text, doc, pos)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t"))))
    return groups.groupBy(doc, "group").agg(F.count(F.lit(1)).alias("n_lines"), F.aggregate(F.transform(ordered, lambda s: s["t"]), F.lit(""), smart_join).alias("text"))


def deal_sections(rows: DataFrame, n_files: int | None, doc: str = "doc_id", section: str = "section") -> DataFrame:
    """rows with part (1, 2, ...): sections in slices of ceil(sections / n_files), so there may be fewer parts than asked for.

    None, or as many files as sections or more: one section a part.
    """
    dense = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy(doc).orderBy(section)))
    dense = dense.withColumn("_all", F.max("_rank").over(Window.partitionBy(doc)))
    per = F.lit(1) if n_files is None else F.ceil(F.col("_all") / F.lit(n_files)).cast("int")
    return dense.withColumn("part", (F.floor((F.col("_rank") - 1) / per) + 1).cast("int")).drop("_rank", "_all")


def union_with_breaks(rows: DataFrame, file_ord: str = "file_ord", pos: str = "pos", text: str = "text") -> DataFrame:
    """file_ord, pos, kind, text: all rows, and a page break after each file but the last; order by the first two."""
    body = rows.select(file_ord, F.col(pos).cast("long").alias(pos), F.lit("row").alias("kind"), text)
    ends = rows.groupBy(file_ord).agg((F.max(pos) + 1).cast("long").alias(pos))
    breaks = ends.where(F.col(file_ord) < rows.agg(F.max(file_ord)).scalar())
    return body.unionByName(breaks.select(file_ord, pos, F.lit("break").alias("kind"), F.lit(None).cast("string").alias(text)))
