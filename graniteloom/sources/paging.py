"""A feed that comes in pages, as a data source: one partition a page, and a stream whose offset is the start index.

A page is an envelope {"startIndex", "resultsPerPage", "totalResults", <items>: [...]} and stands under its start index,
`<base>/start_index=<n>`, as a file or a folder with one. Page 0 tells how many items there are; pages are read where the
partitions run, through Arrow's file systems (local, HDFS, object stores).

    spark.dataSource.register(PagedFeed)
    spark.read.format("paged_feed").option("base", uri).load()
    spark.readStream.format("paged_feed").option("base", uri).option("pagesPerTrigger", 10).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from graniteloom.operators.curation import rank_in_order


class Page(InputPartition):
    """Items from `begin` to `end` (exclusive) of the page that starts at `start`."""

    def __init__(self, start: int, begin: int, end: int):
        self.start, self.begin, self.end = start, begin, end


class PagedFeed(DataSource):
    """Rows (index, item): an item's place in the feed and its JSON. Options: base, items (the envelope's field,
    "vulnerabilities"), pagesPerTrigger (of a stream; all there are)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "index long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Pages:
    def __init__(self, options: dict[str, str]):
        if "base" not in options:
            raise ValueError("paged_feed needs the option base")
        self.base, self.items = options["base"].rstrip("/"), options.get("items", "vulnerabilities")
        self.most = int(options.get("pagespertrigger", options.get("pagesPerTrigger", 0)))

    def page(self, start: int) -> dict:
        """The envelope at a start index; a page that is not there is empty."""
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(f"{self.base}/start_index={start}")
        info = files.get_file_info(path)
        if info.type == fs.FileType.Directory:
            inside = files.get_file_info(fs.FileSelector(path))
            info = next((f for f in sorted(inside, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))), None)
        if info is None or info.type == fs.FileType.NotFound:
            return {}
        with files.open_input_stream(info.path) as stream:
            return json.loads(stream.read())

    def size(self) -> tuple[int, int]:
        """Items in all, and items a page."""
        first = self.page(0)
        return int(first.get("totalResults", 0)), int(first.get("resultsPerPage") or len(first.get(self.items, [])) or 1)

    def pages(self, begin: int, end: int, a_page: int) -> list[Page]:
        return [Page(start, max(begin, start), min(end, start + a_page)) for start in range(begin // a_page * a_page, end, a_page)]

    def rows(self, page: Page) -> Iterator[tuple[int, str]]:
        found = self.page(page.start).get(self.items, [])
        if len(found) < page.end - page.start:
            raise ValueError(f"the page at {page.start} has {len(found)} items where {page.end - page.start} were told")
        for index in range(page.begin, page.end):
            yield index, json.dumps(found[index - page.start], ensure_ascii=False, separators=(",", ":"))


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        total, a_page = self.size()
        return self.pages(0, total, a_page) or [Page(0, 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        return self.rows(partition) if partition.end > partition.begin else iter(())


class _StreamReader(_Pages, DataSourceStreamReader):
    """Offsets are start indexes: what was read stays read after a stop, and a page that has grown goes on inside."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.told: int | None = None

    def initialOffset(self) -> dict:
        return {"startIndex": 0}

    def latestOffset(self) -> dict:
        total, a_page = self.size()
        if self.most and self.told is not None:
            total = min(total, (self.told // a_page + self.most) * a_page)
        elif self.most:
            total = min(total, self.most * a_page)
        self.told = max(total, self.told or 0)
        return {"startIndex": self.told}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.told = max(self.told or 0, end["startIndex"])
        return self.pages(start["startIndex"], end["startIndex"], self.size()[1])

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def write_pages(rows: DataFrame, item: Column, order: list[str], base: str, a_page: int = 200, items: str = "vulnerabilities") -> None:
    """rows as pages of a feed, one item (a struct) a row, in a stated order; a page gathers a_page rows."""
    laid = rank_in_order(rows.select(*order, item.alias("_item")), order, "_rank").select((F.col("_rank") - 1).alias("at"), "_item")
    total = laid.agg(F.count(F.lit(1)).alias("total"))
    start = (F.expr(f"at div {int(a_page)}") * a_page).alias("start_index")
    pages = laid.groupBy(start).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_item"))), lambda x: x["_item"]).alias("items"))
    envelope = F.struct(F.col("start_index").alias("startIndex"), F.lit(a_page).alias("resultsPerPage"), F.col("total").alias("totalResults"), F.col("items").alias(items))
    pages.join(F.broadcast(total)).select("start_index", F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value")).repartition("start_index").write.mode("overwrite").partitionBy("start_index").text(base)
