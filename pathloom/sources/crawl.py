"""A data source that crawls a folder: ``spark.read.format("crawl").load(path)``.

The driver only looks for directories, as deep as it takes to find enough to
share out, and keeps nothing but their names; executors report what lies in the
shallow ones and walk the others. Symbolic links are left out,
entries that can't be read become rows with an error, and a missing root is
empty. Size and time come from the same call and are null where it fails.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "full_path string, is_dir boolean, size_bytes long, mtime timestamp_ntz, error string"


class Share(InputPartition):
    """Directories of which only the entries are reported, and directories to walk."""

    def __init__(self, flat: list[str], folders: list[str]):
        self.flat, self.folders = flat, folders


def entries(folder: str) -> Iterator[tuple]:
    """What lies directly in a folder."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.is_symlink():
                    continue
                try:
                    s = e.stat(follow_symlinks=False)
                    is_dir = e.is_dir(follow_symlinks=False)
                    time = datetime.fromtimestamp(s.st_mtime, timezone.utc).replace(tzinfo=None)
                    yield e.path, is_dir, 0 if is_dir else s.st_size, time, None
                except OSError as err:
                    yield e.path, False, None, None, err.strerror
    except FileNotFoundError:
        return
    except OSError as err:
        yield folder, True, None, None, err.strerror


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.shares = int(options.get("shares", 16))

    def partitions(self) -> list[Share]:
        flat, open_ = [], [self.root]
        while open_ and len(open_) < self.shares:
            flat += open_
            open_ = [e[0] for f in open_ for e in entries(f) if e[1] and e[4] is None]
        return [Share(flat[i :: self.shares], open_[i :: self.shares]) for i in range(min(self.shares, max(len(flat), len(open_))))]

    def read(self, partition: Share) -> Iterator[tuple]:
        for folder in partition.flat:
            yield from entries(folder)
        todo = list(partition.folders)
        while todo:
            for e in entries(todo.pop()):
                yield e
                if e[1] and e[4] is None:
                    todo.append(e[0])


class Crawl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(self.options)


def crawl(spark: SparkSession, root: str, shares: int = 16) -> DataFrame:
    """Everything below a folder, from the executors that can see it."""
    spark.dataSource.register(Crawl)
    return spark.read.format("crawl").option("shares", str(shares)).load(root)


def crawl_catalog(spark: SparkSession, root: str, shares: int = 16) -> DataFrame:
    """A catalog of what a crawl finds, with sizes and times."""
    from ..operators.catalog import set_attributes
    from ..functions.paths import path_key
    from .lists import catalog_from_paths

    found = crawl(spark, root, shares).where("error is null")
    catalog = catalog_from_paths(found.select("full_path", "is_dir"))
    attributes = found.where("not is_dir").select(path_key("full_path").alias("_key"), "size_bytes", "mtime")
    ids = catalog.select("id", path_key("full_path").alias("_key")).join(attributes, "_key").select("id", F.col("size_bytes"), F.col("mtime"))
    return set_attributes(catalog, ids)


def recrawl(spark: SparkSession, root: str, path: str, checkpoint: str, minutes: float = 3, shares: int = 16) -> StreamingQuery:
    """Crawl again every so many minutes (1 to 60), writing the catalog at ``path`` anew as ``v=N``; a clock stream is
    the trigger, so a restart goes on where it stopped."""
    from ..functions.formats import clamped
    from ..operators.catalog import finalize_crawl

    def batch(_: DataFrame, n: int) -> None:
        finalize_crawl(crawl_catalog(spark, root, shares)).write.mode("overwrite").parquet(f"{path}/v={n}")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(batch).trigger(processingTime=f"{int(clamped(minutes, 1, 60) * 60)} seconds").option("checkpointLocation", checkpoint).start()
