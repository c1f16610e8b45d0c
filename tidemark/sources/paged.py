"""A paged source behind Spark's Python data source API: pages are read in parallel, and again if an executor is lost."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAGE = 1000


class Page(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(start)
        self.start, self.end = start, end


def fetcher(options: dict) -> Callable[[int, int], Iterator[tuple]]:
    """The function that answers a page: fetch(start, end, options) gives rows (t, close) of [start, end).

    Named by the option ``fetch`` as module:function, so that executors import it themselves; it gets all options as strings.
    """
    module, _, name = options["fetch"].partition(":")
    return functools.partial(getattr(importlib.import_module(module), name), options=dict(options))


class PagedBars(DataSource):
    """Bars from ``start`` up to, without, the one that is open at ``now``, in steps of ``step`` seconds; pages from ``fetch``."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "t bigint, close double"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.now, self.step = (int(options[k]) for k in ("start", "now", "step"))
        self.fetch = fetcher(options)

    def partitions(self) -> list[Page]:
        last = self.now // self.step * self.step  # the bar that is open
        return [Page(a, min(a + PAGE * self.step, last)) for a in range(self.start, last, PAGE * self.step)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch(partition.start, partition.end)


class PagedStream(SimpleDataSourceStreamReader):
    """A page of new bars for each micro-batch, resumed from the committed offset."""

    def __init__(self, options: dict):
        self.start, self.now, self.step = (int(options[k]) for k in ("start", "now", "step"))
        self.fetch = fetcher(options)

    def initialOffset(self) -> dict:
        return {"t": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["t"] + PAGE * self.step, self.now // self.step * self.step)
        return self.readBetweenOffsets(start, {"t": end}), {"t": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        # A page as a list: Spark sends it on.
        return iter(list(self.fetch(start["t"], end["t"])) if start["t"] < end["t"] else [])

    def commit(self, end: dict) -> None:
        """Nothing to release: bars can be asked for again."""
