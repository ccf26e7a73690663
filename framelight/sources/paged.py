"""A paged catalogue as a Python data source: batch reads all pages, a stream reads page after page with the cursor as its offset."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "external_id string, page int, place int"


def page_rows(page: int, size: int, total: int) -> Iterator[tuple[str, int, int]]:
    for place in range(size):
        if (n := page * size + place) < total:
            yield f"item-{n:06d}", page, place


class Page(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.total, self.size = int(options.get("total", 50)), int(options.get("size", 10))

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in range(-(-self.total // self.size))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from page_rows(partition.page, self.size, self.total)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.total, self.size = int(options.get("total", 50)), int(options.get("size", 10))

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        return {"cursor": -(-self.total // self.size)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(p) for p in range(start["cursor"], end["cursor"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from page_rows(partition.page, self.size, self.total)

    def commit(self, end: dict) -> None:
        pass


class PagedCatalogue(DataSource):
    """spark.dataSource.register(PagedCatalogue); spark.read.format("paged_catalogue").option("total", 50)."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)
