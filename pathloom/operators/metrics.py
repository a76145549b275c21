"""Counters and statistics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def storage_stats(catalog: DataFrame) -> DataFrame:
    """rows, deleted, directories, path_bytes, and whether compaction is due."""
    n, dead = F.count("*"), F.count_if(F.coalesce(F.col("deleted"), F.lit(False)))
    return catalog.agg(
        n.alias("n_rows"), dead.alias("n_deleted"), F.count_if(F.col("is_dir")).alias("n_dirs"),
        F.coalesce(F.sum(F.octet_length("full_path").cast("long")), F.lit(0)).alias("path_bytes"), ((dead > 1000) | (dead * 10 > n)).alias("compaction_due"),
    )


def crawl_counts(entries: DataFrame) -> DataFrame:
    """files, directories and errors of a crawl (``error`` is null for sound entries)."""
    return entries.agg(F.count_if(F.col("error").isNull() & ~F.col("is_dir")).alias("files"), F.count_if(F.col("error").isNull() & F.col("is_dir")).alias("directories"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def task_balance(tasks: DataFrame) -> DataFrame:
    """Of rows (ms, bytes): least, most and mean of both, and the imbalance most / least."""
    return tasks.agg(
        *(f(c).alias(f"{n}_{c}") for c in ("ms", "bytes") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))),
        F.when(F.min("ms") > 0, F.max("ms") / F.min("ms")).alias("imbalance"),
    )


def search_metrics(log: DataFrame) -> DataFrame:
    """Of a query log (seq, ms, results): running count, sums, maxima and the last entry."""
    return log.agg(F.count("*").alias("searches"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"), F.max_by("ms", "seq").alias("last_ms"), F.sum("results").alias("total_results"), F.max_by("results", "seq").alias("last_results"))


def timing(runs: DataFrame, key: str = "query", ms: str = "ms") -> DataFrame:
    return runs.groupBy(key).agg(F.min(ms).alias("min_ms"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"))
