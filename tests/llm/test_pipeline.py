"""The pipeline against a plain version of each stage on the stage's own input."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from textloom.llm import token_output
from tokenizers import Tokenizer

import pytest
from test_near_texts import brute
from test_operators import brute_matches, odd  # noqa: F401


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in rows})
            assert k == 3 or len(rows) == len(seen[-1])
            repeats = len(rows)
    assert set(seen[1]) <= set(seen[0]) and len(seen[1]) >= 0.98 * len(seen[0])
    assert set(seen[2]) == set(brute(seen[1]).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(seen[3]) == {i for i, t in seen[2].items() if not brute_matches(items, t)}
    assert set(seen[4]) == set(seen[3])
    t, start = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY)), 0
    rows = sorted(rows, key=lambda r: r.start)
    assert len(rows) == repeats and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    for r in rows:
        ids = [*t.encode(seen[4][r.doc_id], add_special_tokens=False).ids, corpus_pipeline.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_returns_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("k", range(4))
def test_stages_stand_odd_rows(spark, sf_dir, odd, k):  # noqa: F811
    """Nulls, empty and long texts, repeats, no rows, and columns named like those that stages add."""
    own = odd
    for c in ("_lang", "_score", "_hash", "_first", "_first_hash", "_copies", "_copy", "_source", "_keep_weight", "weight", "_flag", "_guess"):
        own = own.withColumn(c, own.n_chars.cast("string"))
    own = own.withColumn("_lang", own.text)
    stage = corpus_pipeline.STAGES[k][1]
    rows = stage(spark, own, sf_dir).collect()
    none = stage(spark, own.where("false"), sf_dir)
    assert none.columns == own.columns and none.count() == 0
    assert all(r.asDict().keys() == set(own.columns) and r._lang == r.text and r._hash == r.weight == "0" for r in rows)
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    if k == 0:
        assert {r.doc_id for r in rows} <= {None, 4, 5, 6, 7, 8, 9} and 5 in {r.doc_id for r in rows}
    if k == 1:  # one wordless text, one of the two rows with id 6 and the row without an id that is their copy
        assert [i for _, i in ids] == [1, 4, 5, 6, 7, 8, 9]
    if k == 2:
        assert len(rows) == 12
    if k == 3:
        assert {r.doc_id for r in rows} == {r.doc_id for r in own.collect()} and len(rows) >= 12


@pytest.mark.parametrize("own", [None, 3 << 20])
def test_token_files_go_to_python_in_small_batches(spark, sf_dir, monkeypatch, own):
    """Texts to encode and ids read back, some 5 MB a task each, in batches of about 1 MB or the session's own bound."""

    def write(docs, *_):
        def run(batches):
            for b in batches:
                n = b.num_rows
                ids = pa.ListArray.from_arrays(pa.array(range(0, 256 * n + 1, 256), pa.int32()), pa.array(np.full(256 * n, b.nbytes, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([256] * n, pa.int32()), pa.array([0] * n, pa.int64()), ids], ["doc_id", "n_tokens", "before", "ids"])

        return docs.mapInArrow(run, token_output.SCHEMA)

    def read(batches):
        for b in batches:
            written = [x[0] for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([b.nbytes] * b.num_rows, pa.int64()), pa.array(written, pa.int64())], ["doc_id", "before", "_file", "n_tokens", "ids_crc32"])

    monkeypatch.setattr(token_output, "encode_ids", write)
    monkeypatch.setattr(token_output, "_counted", read)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        if own:
            spark.conf.set(key, own)
        docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"))
        rows = corpus_pipeline.token_files(spark, docs, sf_dir).collect()
    finally:
        spark.conf.unset(key)
    most, bound = max(max(r.n_tokens, r.ids_crc32) for r in rows), own or 1 << 20
    assert len(rows) == 20_000 and bound / 2 < most < 1.25 * bound
