"""Numbers 1, 2, ... over a whole table in a given order, without bringing the table to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.shared import shared_path


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """df with a rank by order (which should decide ties).

    Rows are dealt by ranges of the order and written, sorted, to the shared folder; a row's
    rank is its place in its file after the sizes of the files before. Only one count a file
    meets in a window. The written table also keeps the ranks from changing if a task is
    repeated. An existing column of that name is replaced.
    """
    spark = df.sparkSession
    path = shared_path(spark, "ranked")
    rows = df.drop(name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")  # as text, part-100000 would come before part-99999
    stored = spark.read.schema(rows.schema).parquet(path).select("*", number.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = spark.read.schema(rows.schema).parquet(path).select(number.alias("_file")).groupBy("_file").count()
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return stored.join(starts, "_file").withColumn(name, F.col("_base") + F.col("_row") + 1).drop("_file", "_row", "_base")
