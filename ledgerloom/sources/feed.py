"""A paginated feed as one source: history in batch and live pages as a stream, whose offsets are the feed's own page tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Client(Protocol):
    """What a feed must offer. It is sent to executors, so it holds addresses and not connections; requests that fail or are held back are its business."""

    def after(self, token: str, limit: int) -> list[str]:
        """The tokens of at most ``limit`` pages that follow a page, in order; those from the first on for an empty token."""

    def last(self) -> str:
        """The token of the newest page, or an empty one."""

    def rows(self, token: str) -> Iterator[dict]:
        """A page's events. A page does not change once another follows it."""


class FolderClient:
    """Pages as files of JSON lines in a folder, in the order of their names; any store that an address names."""

    def __init__(self, folder: str):
        self.folder = folder

    def _names(self) -> list[str]:
        store, path = fs.FileSystem.from_uri(self.folder)
        return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.endswith(".json"))

    def after(self, token: str, limit: int) -> list[str]:
        return [n for n in self._names() if n > token][:limit]

    def last(self) -> str:
        return max(self._names(), default="")

    def rows(self, token: str) -> Iterator[dict]:
        store, path = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{path}/{token}") as f:
            yield from (json.loads(line) for line in f.read().decode().split("\n") if line.strip())


class _Page(InputPartition):
    def __init__(self, token: str):
        self.token = token


def _between(client: Client, start: str, end: str, limit: int) -> list[_Page]:
    """Pages after one token up to and with another; a page is a task."""
    out = []
    while start != end:
        tokens = client.after(start, limit)
        if not tokens:
            break
        for t in tokens:
            out.append(_Page(t))
            start = t
            if t == end:
                break
    return out


class _Pages:
    def __init__(self, client: Client, schema: StructType, options: dict):
        self.client, self.names = client, schema.fieldNames()
        self.start, self.end, self.limit = options.get("after", ""), options.get("until"), int(options.get("limit", "100"))

    def read(self, page: _Page) -> Iterator[tuple]:
        for row in self.client.rows(page.token):
            yield tuple(page.token if n == "page" else row.get(n) for n in self.names)


class _History(_Pages, DataSourceReader):
    def partitions(self) -> list[_Page]:
        return _between(self.client, self.start, self.client.last() if self.end is None else self.end, self.limit)


class _Live(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": self.start}

    def latestOffset(self) -> dict:
        return {"after": max(self.client.last(), self.start) if self.end is None else self.end}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return _between(self.client, start["after"], end["after"], self.limit)


def source(client: Client, schema: str, name: str = "paged") -> type[DataSource]:
    """A data source over a feed, to be registered with ``spark.dataSource``. Columns are the events' fields; one named ``page`` is the page's token."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _History(client, schema, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Live(client, schema, self.options)

    return Paged


def history(spark: SparkSession, name: str, until: str, after: str = "") -> DataFrame:
    """All pages up to and with a token, each read by a task of its own. A run that stopped is taken up by naming the last page that was written as ``after``."""
    return spark.read.format(name).option("after", after).option("until", until).load()


def live(spark: SparkSession, name: str, after: str) -> DataFrame:
    """The pages after a token as a stream. With the same token as ``history`` there is neither gap nor repeat: both are offsets of one feed."""
    return spark.readStream.format(name).option("after", after).load()
