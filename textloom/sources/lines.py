"""Text files as ordered rows, and ordered rows as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def to_lines(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., pos, line: one row a line; a final line feed ends the last line and starts none. Null text has no lines."""
    text = F.regexp_replace(F.col(text_col), r"\r?\n\z", "")
    return df.where(F.col(text_col).isNotNull()).select(*keep, F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "line"))


def to_text(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), pos: str = "pos", line: str = "line", end: str = "\n") -> DataFrame:
    """keys..., text: the lines of each document in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(line).alias("l"))))
    return lines.groupBy(*keys).agg(F.concat(F.array_join(F.transform(ordered, lambda s: F.coalesce(s["l"], F.lit(""))), end), F.lit(end if end == "\n" else "")).alias("text"))


def write_texts(texts: DataFrame, path: str, key: str = "doc_id") -> None:
    """One folder a document, by its key; each holds the whole text, ended by a line feed."""
    texts.select(key, F.regexp_replace("text", r"\n\z", "").alias("value")).write.partitionBy(key).text(path)
