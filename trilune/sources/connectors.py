"""Connectors as Spark data sources of their own: a subclass says what there is to fetch, the reader does it in tasks.

A connector lists its pages; each page is a partition, fetched with a least interval between requests and with
retries that wait longer each time. Failures that are not worth another try are raised at once.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "id string, title string, content string, source string, url string, language string"


class NotNow(Exception):
    """A page that another try may get: too many requests, or a fault of the server."""


class RateLimiter:
    """At most so many requests a second: waits until the least interval since the last one is over."""

    def __init__(self, per_second: float, clock=time.monotonic, sleep=time.sleep):
        self.least, self.clock, self.sleep, self.last = 1.0 / per_second, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None:
            left = self.last + self.least - self.clock()
            if left > 0:
                self.sleep(left)
        self.last = self.clock()


def with_retries(call, tries: int = 3, backoff: float = 1.0, sleep=time.sleep):
    """call's result; after NotNow it is called again, up to `tries` times in all, with doubled waits between."""
    for n in range(tries):
        try:
            return call()
        except NotNow:
            if n + 1 == tries:
                raise
            sleep(backoff * 2**n)


@dataclass
class Page(InputPartition):
    number: int
    what: str


class Connector(DataSource):
    """A source of records. Subclasses give `name`, `pages` and `fetch`; options are those of the read."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORD

    def pages(self) -> list[str]:
        raise NotImplementedError

    def fetch(self, page: str) -> Iterator[dict]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self, [f.name for f in schema.fields])


class PageReader(DataSourceReader):
    def __init__(self, connector: Connector, names: list[str]):
        self.connector, self.names = connector, names

    def partitions(self) -> list[Page]:
        return [Page(i, what) for i, what in enumerate(self.connector.pages())]

    def read(self, partition: Page) -> Iterator[tuple]:
        options = self.connector.options
        limiter = RateLimiter(float(options.get("persecond", "10")))

        def once() -> list[dict]:
            limiter.wait()
            return list(self.connector.fetch(partition.what))

        for row in with_retries(once, int(options.get("tries", "3")), float(options.get("backoff", "1"))):
            yield tuple(row.get(n) for n in self.names)


class JsonFolder(Connector):
    """Records out of the JSON-lines files of a local folder (option `folder`), a file per page."""

    @classmethod
    def name(cls) -> str:
        return "json_folder"

    def pages(self) -> list[str]:
        from pathlib import Path

        return sorted(str(p) for p in Path(self.options["folder"]).glob("*.json"))

    def fetch(self, page: str) -> Iterator[dict]:
        import json

        with open(page, encoding="utf-8") as f:
            yield from (json.loads(line) for line in f if line.strip())
