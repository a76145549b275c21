"""Catalogs from path lists and from volume snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ROOT_RECORD, is_system_name, record_no
from ..operators.catalog import insert_paths, recompute_paths, subtree_ids
from ..schema import CATALOG, as_catalog


def resolve_list_path(name: str, base: str, levels: int = 8) -> str | None:
    """An existing file of this name: as it is, or in ``base`` or one of the folders above it, ``levels`` in all."""
    if os.path.isfile(name):
        return name
    for _ in range(levels if not os.path.isabs(name) else 0):
        if os.path.isfile(found := os.path.join(base, name)):
            return found
        base, last = os.path.dirname(base), base
        if base == last:
            break
    return None


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """(full_path, is_dir) of a text file: a path per line, empty lines skipped, nothing trimmed; a trailing
    separator marks a directory."""
    lines = spark.read.text(path).where("value != ''")
    return lines.select(F.col("value").alias("full_path"), F.col("value").rlike(r"[/\\]\z").alias("is_dir"))


def catalog_from_paths(paths: DataFrame) -> DataFrame:
    """A new catalog of these paths and all directories above them."""
    return insert_paths(paths.sparkSession.createDataFrame([], CATALOG), paths)


def catalog_from_records(records: DataFrame, metadata: DataFrame | None = None, volume_root: str = "") -> DataFrame:
    """A catalog from a snapshot of records (file_ref, parent_ref, name, is_dir): nameless ones and names that begin
    with ``$`` go, with all below them; size and time come from ``metadata`` (file_ref, size_bytes, mtime)."""
    rows = records.select(F.col("file_ref").alias("id"), F.col("parent_ref").alias("parent_id"), "name", "is_dir", F.lit("").alias("full_path"))
    named = rows.where("name != ''")
    system = is_system_name("name") & (record_no("id") != ROOT_RECORD)
    named = named.join(subtree_ids(named, named.where(system)), "id", "left_anti")
    if metadata is not None:
        m = metadata.select(record_no("file_ref").alias("_record"), F.col("size_bytes"), F.col("mtime").cast("timestamp_ntz").alias("mtime"))
        named = named.withColumn("_record", record_no("id")).join(m, "_record", "left").drop("_record")
    return recompute_paths(as_catalog(named), volume_root)


def read_catalog(spark: SparkSession, path: str, live_only: bool = True) -> DataFrame:
    """A stored catalog (Parquet), without tombstones unless asked for."""
    df = as_catalog(spark.read.parquet(path))
    return df.where("not deleted") if live_only else df


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Stored in ranges of paths and sorted within, so prefix predicates skip row groups by their statistics."""
    catalog.repartitionByRange("full_path").sortWithinPartitions("full_path").write.mode("overwrite").parquet(path)
