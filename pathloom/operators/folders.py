"""Recursive folder statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestor_keys, path_key
from .filters import live


def folder_totals(catalog: DataFrame) -> DataFrame:
    """(folder, total_size, file_count) of every folder above a live file, from all files below it.

    Each file counts once for each of its ancestors; partial sums keep the shuffle at one row per folder and task,
    however many files a folder holds. A root (``/``) is the folder ''."""
    files = catalog.where(live() & ~F.col("is_dir"))
    each = files.select(F.explode(ancestor_keys("full_path")).alias("folder"), F.coalesce("size_bytes", F.lit(0)).alias("n"))
    return each.groupBy("folder").agg(F.sum("n").alias("total_size"), F.count("*").alias("file_count"))


def folder_stats(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """``folders`` with total_size and file_count; (0, 0) for those without files."""
    totals = folder_totals(catalog).withColumnRenamed("folder", "_key")
    return folders.withColumn("_key", path_key("full_path")).join(totals, "_key", "left").drop("_key").na.fill(0, ["total_size", "file_count"])


class FolderStats:
    """Folder statistics asked for again and again: all totals of a catalog are computed by the first request and kept;
    ``reset`` begins a new generation with another catalog, whose first request computes them anew."""

    def __init__(self, catalog: DataFrame):
        self.generation, self.catalog, self._totals = 0, catalog, None

    def reset(self, catalog: DataFrame) -> None:
        if self._totals is not None:
            self._totals.unpersist()
        self.generation, self.catalog, self._totals = self.generation + 1, catalog, None

    def request(self, folders: DataFrame) -> DataFrame:
        """(full_path, total_size, file_count) of distinct folders; repeated requests of one are one row."""
        if self._totals is None:
            self._totals = folder_totals(self.catalog).withColumnRenamed("folder", "_key").persist()
        distinct = folders.withColumn("_key", path_key("full_path")).groupBy("_key").agg(F.min("full_path").alias("full_path"))
        return distinct.join(self._totals, "_key", "left").drop("_key").na.fill(0, ["total_size", "file_count"])
