"""A paged HTTP source, newest rows first, for batches and streams.

The service answers {url}?before=ID&size=N with a JSON list of at most N objects whose ids are below ID, newest first. Reading is split by ranges of ids: a task asks for
pages from its range's upper end down and stops at the first id below the range, so pages don't shift when rows arrive meanwhile. Requests are made on the executors and
tried again there (429 and 5xx, and broken connections; Retry-After is kept to); a task that gives up fails and is Spark's to repeat. A stream's offset is the newest id it has
seen, found by one request for one row, so a restart goes on behind the last committed one and neither loses nor repeats rows.

Options: url; schema (DDL, by .schema()); id (the id's field, whole numbers, default "id"); size (of a page, 100); span (ids of a task, 1000); tries (3); wait (seconds before the
second try, doubled after each, 1); first (the smallest id that counts, 0). Rows without an id are left out, fields that a row lacks are null; rows that arrive later under an id
that was passed already are not seen.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructType


def requested(url: str, tries: int = 3, wait: float = 1.0, sleep=time.sleep) -> list:
    """The JSON list behind a url."""
    for left in range(tries - 1, -1, -1):
        pause = wait
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if not left or not (e.code == 429 or e.code >= 500):
                raise
            given = e.headers.get("Retry-After", "")
            pause = float(given) if given.replace(".", "", 1).isdecimal() else wait
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if not left:
                raise
        sleep(pause)
        wait *= 2
    raise ValueError("tries must be 1 or more")


class Ids(InputPartition):
    """Ids from low to high, both included."""

    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Pages:
    """What both readers share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.url, self.key = schema, options["url"], options.get("id", "id")
        self.size, self.span = int(options.get("size", 100)), int(options.get("span", 1000))
        self.tries, self.wait, self.first = int(options.get("tries", 3)), float(options.get("wait", 1)), int(options.get("first", 0))

    def page(self, before: int | None, size: int) -> list[dict]:
        mark = "&" if "?" in self.url else "?"
        return requested(f"{self.url}{mark}size={size}" + (f"&before={before}" if before is not None else ""), self.tries, self.wait)

    def newest(self) -> int | None:
        ids = [r[self.key] for r in self.page(None, 1) if r.get(self.key) is not None]
        return max(ids, default=None)

    def ranges(self, low: int, high: int) -> list[Ids]:
        return [Ids(a, min(a + self.span - 1, high)) for a in range(low, high + 1, self.span)] or [Ids(0, -1)]

    def rows(self, part: Ids) -> Iterator[tuple]:
        before = part.high + 1
        while before > part.low:
            page = self.page(before, self.size)
            ids = [r[self.key] for r in page if r.get(self.key) is not None]
            for r in page:
                if r.get(self.key) is not None and part.low <= r[self.key] <= part.high:
                    yield tuple(self.value(r.get(f.name), f.dataType) for f in self.schema)
            if len(page) < self.size or not ids or min(ids) <= part.low:
                return  # the range is passed
            before = min(ids)

    @staticmethod
    def value(x, kind):
        """Nested values of text fields stay JSON."""
        return json.dumps(x) if isinstance(kind, StringType) and isinstance(x, (dict, list)) else x


class Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Ids]:
        newest = self.newest()
        return self.ranges(self.first, newest) if newest is not None else [Ids(0, -1)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        return self.rows(partition)


class Stream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seen": self.first - 1}

    def latestOffset(self) -> dict:
        newest = self.newest()
        return {"seen": self.first - 1 if newest is None else max(newest, self.first - 1)}

    def partitions(self, start: dict, end: dict) -> list[Ids]:
        return self.ranges(start["seen"] + 1, end["seen"])

    def read(self, partition: Ids) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """The service keeps its rows, so there is nothing to let go."""


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource), then format("quern_pages") with a schema."""

    @classmethod
    def name(cls) -> str:
        return "quern_pages"

    def schema(self) -> str:
        raise ValueError("a schema is needed")

    def reader(self, schema: StructType) -> Batch:
        return Batch(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> Stream:
        return Stream(schema, dict(self.options))
