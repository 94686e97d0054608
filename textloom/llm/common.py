"""Helpers shared by the training-data operators: shared-folder tables and batch slicing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import drop_path, materialize, shared_path

__all__ = ["Tables", "by_bytes", "drop_path", "free_names", "materialize", "shared_path", "table", "tidy", "unsigned_hex"]


class Tables:
    """Materialised tables of one loop, so that superseded ones can be deleted at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        path = shared_path(self.spark, tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                drop_path(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Slices [i, j) of a binary column whose bytes stay under most, or hold one text."""
    i, held = 0, 0
    for j, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if j > i and held + n > most:
            yield i, j
            i, held = j, 0
        held += n
    if len(texts) > i:
        yield i, len(texts)


def unsigned_hex(col: Column) -> Column:
    """16 lowercase hex digits of a long read as unsigned."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of docs (Spark ignores case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back memory that it no longer uses: it lives on for other stages."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole
