"""The corpus pipeline: language, near copies, benchmark passages, source weights, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, langid, mixing, near_texts, token_output
from textloom.llm.common import free_names, shared_path, table

#: Documents whose predicted language is less certain than this are rejected.
LEAST_SCORE = 0.5
#: Entropy of the mix, as a share of that of equal weights.
MIX_ENTROPY = 0.95
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Bytes of the Arrow batches in which rows go to Python.
BATCH_BYTES = 1 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own; no result depends on it.

    Spark's default is 10,000 rows or 64 MB, and a batch is built outside the heap. The
    setting stays: what a stage returns is computed after the stage.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; und (no text, no letter) and unsure ones go.

    The prediction reads the text alone; a null id or lang only keeps a row from being learned
    from. Repeated rows share their fate, an empty table stays empty, columns stay as they are.
    """
    small_batches(spark)
    lang, score = free_names(docs, "_lang", "_score")
    judged = langid.predict(docs, langid.train(docs), lang_out=lang, score_out=score)
    return judged.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that of the smallest id, equal ids by text hash.

    Near copies have five-word shingles of similarity 0.8 or more; null and wordless texts are
    one group. A row without an id is kept where its group has none with one. Rows that
    repeat id and text count once, whatever their other columns hold; these stay as they are.
    """
    small_batches(spark)
    groups = near_texts.near_texts(docs)
    here, first, hashed = free_names(docs, "_hash", "_first", "_first_hash")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("hash") == F.col("first_hash"))).select(F.col("doc_id").alias(first), F.col("hash").alias(hashed)).distinct()
    own = docs.withColumn(here, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(first)) & (F.col(here) == F.col(hashed))
    return own.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", here]).select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that repeat no benchmark item.

    A null or wordless text repeats none; ids are not looked at; columns stay as they are.
    """
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources have their target weights; every document is read at least once.

    A null source is a source of its own; one without a word is read once. Columns stay as they are.
    """
    return mixing.mix_rows(docs, mixing.word_count(F.col("text")), target_entropy=MIX_ENTROPY, budget="cover")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids in doc_id order; one row a document as read back from the files.

    A null text has the end id alone; null ids come first; repeated rows follow each other.
    """
    small_batches(spark)
    path = token_output.write_token_ids(docs, shared_path(spark, "token-ids"), public_tokenizers.path(VOCABULARY), END_ID)
    return token_output.read_token_ids(spark, path, content="crc")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("mixing to target weights", source_weights),
    ("token-ID output", token_files),
]

#: Support vector machines and token ids can't be expressed in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
