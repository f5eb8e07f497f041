"""A remote listing read page by page, as a Python data source: pages are partitions, so that tasks fetch them side by side.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").schema(...).option("fetcher", "module:function").option("page", 200).load()

The fetcher is a function (limit, offset, options) -> {"items": [...], "total": n} that
executors can import by name: a client of a service, or, in tests, of a folder. Items
become rows by the names of the schema. The total is asked for once, at planning; a
listing that does not tell it is read by one task, to its end.

Defined cases: ``cap`` bounds the rows that are read; more items than were asked for are
cut, as a server may ignore the limit; a page that comes short is asked for again from
where it ended, and a page that is empty ends; an item that is no mapping, or has no id
where the schema has one, is skipped; text of an item that is no text is given as JSON;
a failing page is tried ``tries`` times, waiting longer each time, and then fails its
task, which Spark runs again elsewhere.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

PAGE, CAP, TRIES, WAIT = 200, 100_000, 4, 0.2


class Page(InputPartition):
    def __init__(self, offset: int, size: int | None):
        super().__init__(offset)
        self.offset, self.size = offset, size  # size None: to the end of the listing


def _named(name: str) -> Callable[[int, int, dict], dict]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.page, self.cap = int(options.get("page", PAGE)), int(options.get("cap", CAP))
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", WAIT))
        if self.page < 1 or self.cap < 0 or self.tries < 1:
            raise ValueError("page and tries must be at least 1, cap at least 0")

    def _fetch(self, limit: int, offset: int) -> dict:
        for attempt in range(self.tries):
            try:
                return _named(self.options["fetcher"])(limit, offset, self.options)
            except Exception:
                if attempt == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError("unreachable")

    def partitions(self) -> list[Page]:
        if not self.cap:
            return []
        total = self._fetch(1, 0).get("total")
        if total is None:
            return [Page(0, None)]
        end = min(int(total), self.cap)
        return [Page(at, min(self.page, end - at)) for at in range(0, end, self.page)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # no pages were planned
            return
        at, end = partition.offset, self.cap if partition.size is None else partition.offset + partition.size
        while at < end:
            asked = min(self.page, end - at)
            items = (self._fetch(asked, at).get("items") or [])[:asked]
            for item in items:
                if isinstance(item, dict) and ("id" not in self.schema.names or item.get("id") is not None):
                    yield tuple(self._value(item.get(f.name), f.dataType) for f in self.schema.fields)
            if not items:
                return
            at += len(items)

    @staticmethod
    def _value(value, kind):
        if isinstance(kind, StringType) and value is not None and not isinstance(value, str):
            return json.dumps(value, sort_keys=True)
        return value


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, content string, context string, content_type string, created_by string, provenance string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)
