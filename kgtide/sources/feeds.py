"""Planned fetches as a Spark data source, for batches and streams.

A plan is a folder of batches, ``batch=N`` with a JSON line for each fetch, that
``append_plan`` adds to.  The reader makes a partition for each fetch; tasks
fetch, try again, and give a row with the body or with the error, so that no
fetch fails another.  As a stream, a batch of the plan is an offset: what a
checkpoint has seen is not fetched again, and an unfinished batch is.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[str, float], str]

#: Fetches that a task waits for at once.
AT_ONCE = 64

#: What a fetch gives: the planned item, and either the body or an error.
SCHEMA = "batch long, source string, item string, url string, body string, error string"


def fetch_url(url: str, seconds: float) -> str:
    """The body at an http or https address; else the file, or the files of a
    folder in turn, at an address of a file system that Arrow knows."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(url, timeout=seconds) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(url)
    paths = [path]
    if where.get_file_info(path).type == fs.FileType.Directory:
        found = where.get_file_info(fs.FileSelector(path))
        paths = sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", ".")))
    bodies = []
    for path in paths:
        with where.open_input_stream(path) as f:
            bodies.append(f.read().decode("utf-8", "replace"))
    return "".join(bodies)


def append_plan(plan: DataFrame, root: str, batch: int) -> None:
    """Adds a batch of fetches (source, item, url); one that is there is replaced."""
    plan.select("source", "item", "url").coalesce(1).write.mode("overwrite").json(f"{root}/batch={batch:010d}")


class Planned(InputPartition):
    """Fetches of one partition."""

    def __init__(self, fetches: list[dict]):
        self.fetches = fetches


class _Plans:
    """The plan folder as the driver sees it, and how tasks fetch from it."""

    def __init__(self, options: dict[str, str], fetch: Fetch):
        if "path" not in options:
            raise ValueError("the feeds source needs the folder of its plan: load(path)")
        self.path, self.fetch = options["path"], fetch
        self.each, self.tries = int(options.get("each", 1)), int(options.get("tries", 2))
        self.pause, self.timeout = float(options.get("pause", 1.0)), float(options.get("timeout", 10.0))

    def batches(self) -> list[int]:
        """Batches that are written in full."""
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        whole = [x.path for x in found if x.base_name.startswith("batch=") and where.get_file_info(f"{x.path}/_SUCCESS").is_file]
        return sorted(int(x.rpartition("=")[2]) for x in whole)

    def partitions_of(self, batches: list[int]) -> list[Planned]:
        fetches = []
        for k in batches:
            lines = fetch_url(f"{self.path if '://' in self.path else 'file://' + self.path.removeprefix('file:')}/batch={k:010d}", self.timeout).splitlines()
            fetches += [json.loads(x) | {"batch": k} for x in lines if x.strip()]
        return [Planned(fetches[at : at + self.each]) for at in range(0, len(fetches), self.each)]

    def row(self, x: dict) -> tuple:
        planned = (x["batch"], x.get("source"), x.get("item"), x.get("url"))
        for left in range(self.tries - 1, -1, -1):
            try:
                if not x.get("url"):
                    raise LookupError("no address is planned")
                row = (*planned, self.fetch(x["url"], self.timeout), None)
            except Exception as problem:  # noqa: BLE001  a fetch's failure is its own
                row = (*planned, None, f"{type(problem).__name__}: {problem}")
                if left and x.get("url"):
                    time.sleep(self.pause)
                    continue
            break
        return row

    def rows(self, part: Planned) -> Iterator[tuple]:
        """In the plan's order; waits for answers and pauses overlap."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for at in range(0, len(part.fetches), AT_ONCE):
                yield from pool.map(self.row, part.fetches[at : at + AT_ONCE])


class FeedReader(DataSourceReader):
    def __init__(self, plans: _Plans):
        self.plans = plans

    def partitions(self) -> list[Planned]:
        return self.plans.partitions_of(self.plans.batches()) or [Planned([])]

    def read(self, partition: Planned) -> Iterator[tuple]:
        return self.plans.rows(partition)


class FeedStream(DataSourceStreamReader):
    def __init__(self, plans: _Plans):
        self.plans = plans

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(self.plans.batches(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Planned]:
        return self.plans.partitions_of([k for k in self.plans.batches() if start["batch"] < k <= end["batch"]]) or [Planned([])]

    def read(self, partition: Planned) -> Iterator[tuple]:
        return self.plans.rows(partition)

    def commit(self, end: dict) -> None:
        """The plan stays: another stream may read it."""


def register(spark: SparkSession, fetch: Fetch = fetch_url, name: str = "feeds") -> str:
    """Makes ``spark.read.format(name)`` and ``readStream`` read plans with ``fetch``.

    Options: path (the plan), each (fetches of a partition), tries, pause and
    timeout (seconds).
    """
    named = name

    class FeedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> FeedReader:
            return FeedReader(_Plans(dict(self.options), fetch))

        def streamReader(self, schema: StructType) -> FeedStream:
            return FeedStream(_Plans(dict(self.options), fetch))

    spark.dataSource.register(FeedSource)
    return name
