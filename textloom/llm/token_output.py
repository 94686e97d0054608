"""Token-id output: Parquet files of list columns in id order, and readers that open only what they need."""

from __future__ import annotations

import itertools
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import by_bytes, tidy
from textloom.llm.word_encoder import WordEncoder

_ENCODERS: dict[str, WordEncoder] = {}


def _kept(ids: list[int]) -> bytes:
    packed = array("i", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _kept_of(ids: list[int], ends: list[int]) -> list[bytes]:
    packed = _kept(ids)
    return [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, _kept, values=_kept_of)
    return _ENCODERS[path]


def _encoded(encoder: WordEncoder, cut: list[list[bytes]], end_id: int | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each text has, with the end id, and all ids in order; about most bytes of the texts' pieces at a time."""
    pieces = list(itertools.chain.from_iterable(cut))
    parts = [encoder.packed(pieces[i:j]) for i, j in by_bytes(pa.array(pieces, pa.binary()), most)]
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate([n for n, _ in parts]))))
    sizes = np.diff(before[np.cumsum([0, *map(len, cut)])])
    ids = np.concatenate([x for _, x in parts]) if len(parts) > 1 else parts[0][1]
    if end_id is None:
        return sizes, ids
    ends = np.zeros(len(ids) + len(cut), bool)
    ends[np.cumsum(sizes + 1) - 1] = True
    out = np.empty(len(ends), np.int32)
    out[ends], out[~ends] = end_id, ids
    return sizes + 1, out


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None, batch_bytes: int = 1 << 20, piece_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, text binary) to (doc_id, n_tokens, before, ids); row order within a partition stays.

    before is the number of ids of the rows before it in its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer_path), 0
        for batch in batches:
            ids = batch.column(0)
            for i, j in by_bytes(batch.column(1), batch_bytes):
                cut = [encoder.pieces(t or b"", piece_bytes) for t in batch.column(1).slice(i, j - i).to_pylist()]
                sizes, out = _encoded(encoder, cut, end_id, batch_bytes)
                offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(out)]))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes, pa.int32()), pa.array(before + offsets[:-1]), lists], ["doc_id", "n_tokens", "before", "ids"])
                before += int(offsets[-1])

    return docs.mapInArrow(tidy(run), SCHEMA)


SCHEMA = "doc_id long, n_tokens int, before long, ids array<int>"


def write_token_ids(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    encoding: str = "dictionary",
) -> str:
    """Encode every text and write token files in ascending doc_id order; returns path.

    path/tokens has (doc_id, n_tokens, before, ids): part-00000 holds the smallest ids, rows
    ascend within a file, and before counts the ids of the rows before it in the file.
    path/starts has one row a file: its number and the ids of all files before it. ids is a
    list column, dictionary encoded (encoding="dictionary") or delta encoded ("delta", which
    is format version 2 without dictionaries). row_group_bytes and page_bytes bound what a
    reader of a few rows must open; Parquet's column and offset indexes are written, so a
    doc_id range or the metadata columns are read without touching other pages. The ranges
    come from a sample of ids and text hashes, so rows of one id can be split too; texts are
    encoded after the one shuffle, and Spark's own committer writes the files, so a lost
    executor only repeats its tasks.

    Null text: no ids but the end id. Null doc_id: first in order. Rows with equal ids are
    ordered by a hash of their text, then by the text, so repeated rows come out alike. An
    empty table writes no rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("hash"))
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    out = encode_ids(ordered, tokenizer_path, end_id).write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("maxRecordsPerFile", 0)
    if encoding == "delta":
        out = out.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    else:
        out = out.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20)
    out.parquet(f"{path}/tokens")
    totals = _stored(spark, path).groupBy("_file").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")).write.parquet(f"{path}/starts")
    return path


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The token files' rows with the number of their file as _file."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return spark.read.schema(SCHEMA).parquet(f"{path}/tokens").select("*", number.alias("_file"))


def read_token_ids(spark: SparkSession, path: str, content: str = "ids", where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens as written, and the ids (content="ids"), ids_crc32 ("crc") or neither ("none").

    start is the number of ids of all documents before the row: the row's place in its file,
    which is stored with it, and the file's, from the small table of files. Nothing else is
    shuffled, numbered or sorted, so a condition on doc_id (where, or a filter on the result
    unless content is "crc") reaches the files: only the row groups and pages that can hold
    the id are opened. "none" opens the metadata columns alone. For "crc", n_tokens and
    ids_crc32 are counted from the ids themselves; ids_crc32 is the unsigned crc32 of the ids
    as little-endian unsigned 32-bit integers.
    """
    if content not in ("ids", "crc", "none"):
        raise ValueError(f"unknown content {content!r}")
    starts = spark.read.schema("_file long, _base long").parquet(f"{path}/starts")
    stored = _stored(spark, path)
    stored = stored if where is None else stored.where(where)
    if content == "crc":
        stored = stored.select("doc_id", "before", "_file", "ids").mapInArrow(tidy(_counted), "doc_id long, before long, _file long, n_tokens long, ids_crc32 long")
    rows = stored.join(starts, "_file").withColumn("start", F.col("_base") + F.col("before"))
    return rows.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), *{"ids": ["ids"], "crc": ["ids_crc32"], "none": []}[content])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids replaced by their number and crc32."""
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "before", "_file", "n_tokens", "ids_crc32"])
