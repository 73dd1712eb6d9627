"""Documents at URLs as rows: a Spark data source for lists of URLs, and the same for URLs that are a table.

Fetching is dealt by host: a host is asked by PER_HOST partitions at most at a time, one request after the other, each with a
time-out. A document that cannot be had, or is no text, is a row with a fault; nothing stops the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import PayloomError
from .documents import TIMEOUT, http_fetch

PER_HOST = 4
SCHEMA = "uri string, content string, fault string"


def fetched(url: str | None, timeout: float = TIMEOUT) -> tuple[str | None, str | None, str | None]:
    try:
        if url is None or not url.startswith(("http://", "https://")):
            return url, None, f"{url} is no URL"
        return url, http_fetch(url, timeout), None
    except PayloomError as e:
        return url, None, e.message


def host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


@dataclass
class Urls(InputPartition):
    urls: list[str]

    def __post_init__(self):
        super().__init__(self.urls)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], per_host: int, timeout: float):
        self.urls, self.per_host, self.timeout = urls, per_host, timeout

    def partitions(self) -> list[Urls]:
        by_host: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            by_host.setdefault(host(url), []).append(url)
        return [Urls(mine[i :: self.per_host]) for mine in by_host.values() for i in range(min(self.per_host, len(mine)))] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetched(url, self.timeout)


class RemoteDocuments(DataSource):
    """Options: urls (a JSON list), per_host, timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "payloom_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("urls", "[]")), int(self.options.get("per_host", PER_HOST)), float(self.options.get("timeout", TIMEOUT)))


def read_remote(spark: SparkSession, urls: list[str], per_host: int = PER_HOST, timeout: float = TIMEOUT) -> DataFrame:
    """uri, content, fault of each of the URLs, as DataFrames of documents have them."""
    spark.dataSource.register(RemoteDocuments)
    return spark.read.format(RemoteDocuments.name()).option("urls", json.dumps(urls)).option("per_host", per_host).option("timeout", timeout).load()


def fetch_table(urls: DataFrame, column: str = "uri", partitions: int | None = None, per_host: int = PER_HOST, timeout: float = TIMEOUT) -> DataFrame:
    """The same for the distinct URLs of a table, however many: no list of them is held anywhere."""
    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    at = F.lower(F.regexp_extract(F.col("uri"), "^[a-zA-Z]+://([^/?#]*)", 1))
    turn = F.pmod(F.xxhash64("uri"), F.lit(per_host))

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([fetched(u, timeout) for u in part["uri"]], columns=["uri", "content", "fault"])

    every = urls.select(F.col(column).alias("uri")).where("uri is not null").distinct()
    return every.repartition(n, at, turn).mapInPandas(each, SCHEMA)
