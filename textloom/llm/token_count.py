"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import by_bytes, tidy
from textloom.llm.word_encoder import WordEncoder

_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per Python worker; it lives as long as the worker, so its cache serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, len)
    return _ENCODERS[path]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    batch_bytes: int = 1 << 20,
    piece_bytes: int = 1 << 16,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, without a shuffle.

    Arrow batches are cut into slices of about batch_bytes; a text over piece_bytes is cut
    at white space and its pieces' counts are added up, so memory follows the slice, not the
    text. A null text counts as empty (0 bytes, 0 tokens); a null id stays null; a repeated
    row gives a repeated result; an empty table gives an empty result; other columns are
    never read. A vocabulary whose tokens may span white space (see word_encoder) gets its
    texts uncut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            counts, sizes = [], []
            for i, j in by_bytes(batch.column(1), batch_bytes):
                raw = [t or b"" for t in batch.column(1).slice(i, j - i).to_pylist()]
                sizes += map(len, raw)
                cut = [encoder.pieces(t, piece_bytes) for t in raw]
                if all(len(p) == 1 for p in cut):
                    counts += encoder.texts([p[0] for p in cut], sum)
                else:
                    counts += [sum(encoder.texts([p], sum)[0] for p in ps) for ps in cut]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
