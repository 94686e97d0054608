"""The polled source: snapshots of nested records, flattened and filtered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CENTERS = "centers array<struct<name:string,address:string,sessions:array<struct<available_capacity:int,min_age_limit:int,vaccine:string>>>>"


def alerts(snapshots: DataFrame, age: int, time_col: str | None = None) -> DataFrame:
    """One row a session with free places for the age: center, address, slots, age, vaccine, time. Batch or stream."""
    now = F.col(time_col) if time_col else F.current_timestamp()
    centers = snapshots.select(now.alias("time"), F.explode("centers").alias("c"))
    sessions = centers.select("time", "c.name", "c.address", F.explode("c.sessions").alias("s"))
    fit = sessions.where((F.col("s.available_capacity") > 0) & (F.col("s.min_age_limit") <= age))
    return fit.select(F.col("name").alias("center"), "address", F.col("s.available_capacity").alias("slots"), F.col("s.min_age_limit").alias("age"), F.col("s.vaccine").alias("vaccine"), "time")


def request_date(column: str | None = None):
    """Tomorrow as dd-MM-yyyy, from a timestamp column or now."""
    return F.date_format((F.col(column) if column else F.current_timestamp()) + F.expr("INTERVAL 24 HOURS"), "dd-MM-yyyy")


def poll(
    spark: SparkSession,
    path: str,
    age: int,
    checkpoint: str,
    each: Callable[[DataFrame, int], None],
    minutes: int = 5,
    once: bool = False,
    dedup: bool = False,
) -> StreamingQuery:
    """Watch a folder of JSON snapshots; every interval the new ones' alerts go to `each`.

    No alert is held back for having been seen before, unless dedup is asked for. once: take
    what is there and end.
    """
    rows = alerts(spark.readStream.schema(CENTERS).json(path), age)
    if dedup:
        rows = rows.withWatermark("time", "1 day").dropDuplicatesWithinWatermark(["center", "address", "age", "vaccine"])
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{minutes} minutes")).start()


def filtered_stream(spark: SparkSession, source: str, condition: str, columns: list[str], out: str, checkpoint: str) -> None:
    """Run a Parquet folder through a filter and a projection as a stream, into Parquet files, until it is read."""
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rstrip("/").rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(source)
    query = rows.where(condition).select(*columns).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
