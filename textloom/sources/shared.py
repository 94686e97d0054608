"""Tables in the folder that all machines share, for loops whose plans would grow without end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all its tasks run in one process, as in tests.
LOCAL_FALLBACK = "file:///tmp/checkpoints"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; it goes when the driver's JVM ends.

    A session without that setting is refused unless its master is local: on a cluster a folder
    of one machine's own would lose tables.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master!r} share")
        base = LOCAL_FALLBACK
    path = f"{base.rstrip('/')}/textloom/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
