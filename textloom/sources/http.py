"""Pages and JSON snapshots fetched by address: Python data sources, one task a slice of the addresses."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _fetch(url: str, timeout: float) -> tuple[bytes | None, str | None]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.read(), None
    except (OSError, ValueError) as e:
        return None, str(e)


class _Slice(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.slices = max(1, int(options.get("slices", "8")))
        self.timeout = float(options.get("timeout", "30"))

    def partitions(self):
        return [_Slice(part) for k in range(self.slices) if (part := self.urls[k :: self.slices])] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for url in partition.urls:
            yield (url, *_fetch(url, self.timeout))


class PageSource(DataSource):
    """url, content, error of each address; a failed one has an error and no content."""

    @classmethod
    def name(cls) -> str:
        return "textloom_pages"

    def schema(self) -> str:
        return "url string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch_pages(spark: SparkSession, urls: list[str], slices: int = 8, timeout: float = 30) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format(PageSource.name()).option("urls", json.dumps(urls)).option("slices", str(slices)).option("timeout", str(timeout)).load()


def fetch_snapshots(spark: SparkSession, urls: list[str], schema: str, timeout: float = 30) -> DataFrame:
    """One row a snapshot in the given schema; an answer that can't be had or read is a row of nulls."""
    pages = fetch_pages(spark, urls, timeout=timeout)
    return pages.select(F.from_json(F.col("content").cast("string"), schema).alias("d")).select("d.*")


def read_config(spark: SparkSession, path: str, schema: str) -> dict:
    """A JSON settings file as a dict; fields it lacks are None."""
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    return row.asDict(recursive=True) if row else {}


CRAWL_CONFIG = "novel_name string, novel_cover_image string, author string, website_name string, website_root string, start_chapter_url string, use_selenium string, browser string, start_chapter_number int"
POLL_CONFIG = "pincode string, age_limit int, check_interval_minutes int"
