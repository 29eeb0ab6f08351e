"""Paged services as a stream: pages that name the next one are read once each, with the link as the cursor.

An offset is (pages read, next link); Spark keeps it in the checkpoint, so a run that starts again goes on with the next
link, and a batch that failed is read again page by page. The driver follows the links; the rows of a page are fetched
where they are worked on, so a page is asked for twice and none of its rows stays in the driver.

Defined results: a service without pages gives no rows; ``max_pages`` ends the chain for good, over all runs; a page
without rows is a page; the last page is known by its missing link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[str], tuple[list[tuple], str | None]]


class _Reader(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, start: str, max_pages: int | None, batch: int) -> None:
        self.fetch, self.start, self.most, self.batch = fetch, start, max_pages, batch
        self.ahead: dict | None = None

    def initialOffset(self) -> dict:
        return {"pages": 0, "link": self.start}

    def _walk(self, offset: dict, until: int | None = None) -> tuple[list[str], dict]:
        """(links of the pages after an offset, offset behind them)."""
        links, pages, link = [], offset["pages"], offset["link"]
        stop = pages + self.batch if until is None else until
        while link and pages < stop and (self.most is None or pages < self.most):
            links.append(link)
            link, pages = self.fetch(link)[1], pages + 1
        return links, {"pages": pages, "link": link}

    def latestOffset(self) -> dict:
        self.ahead = self._walk(self.ahead or self.initialOffset())[1]
        return self.ahead

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.ahead is None or self.ahead["pages"] < end["pages"]:
            self.ahead = end
        return [InputPartition(link) for link in self._walk(start, end["pages"])[0]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value)[0]

    def commit(self, end: dict) -> None:
        if self.ahead is None or self.ahead["pages"] < end["pages"]:
            self.ahead = end


def stream_pages(spark: SparkSession, fetch: Fetch, start: str, schema: str, max_pages: int | None = None, batch: int = 10) -> DataFrame:
    """A streaming frame over a service: ``fetch(link) -> (rows, next link)``, ``batch`` pages at most in a micro-batch."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "linked_page_stream"

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Reader(fetch, start, max_pages, batch)

    spark.dataSource.register(Pages)
    return spark.readStream.format("linked_page_stream").load()
