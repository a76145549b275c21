"""Change journals, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CHANGES, struct

#: Reasons that change a catalog; records that only close a file carry none of them.
ACTIONS = ("FILE_CREATE", "FILE_DELETE", "RENAME_NEW_NAME", "RENAME_OLD_NAME", "DATA_EXTEND", "DATA_TRUNCATION", "DATA_OVERWRITE")
MAX_NAME = 255


def is_action() -> Column:
    return F.arrays_overlap("reasons", F.array(*map(F.lit, ACTIONS)))


def is_valid() -> Column:
    """Records that can be applied; the others go to ``quarantine``."""
    return F.col("seq").isNotNull() & F.col("file_ref").isNotNull() & F.col("reasons").isNotNull() & F.coalesce(F.length("name") <= MAX_NAME, F.lit(False))


def actions(changes: DataFrame) -> DataFrame:
    return changes.where(is_valid() & is_action())


def quarantine(changes: DataFrame) -> DataFrame:
    return changes.where(~is_valid())


def gaps(changes: DataFrame) -> DataFrame:
    """One row: whether sequence numbers are missing, so the catalog must be rebuilt from a snapshot."""
    return changes.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), (F.count_distinct("seq") < F.max("seq") - F.min("seq") + 1).alias("compromised"))


def read_stream(spark: SparkSession, path: str, max_files: int = 100, fmt: str = "json") -> DataFrame:
    """Journal files as a stream; ``max_files`` a trigger is the back-pressure, and lost files end it."""
    return spark.readStream.schema(struct(CHANGES)).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def read_status(log: DataFrame, most_errors: int = 100) -> DataFrame:
    """Of a log of reads (seq, error; null if it went well), one row: the read after which reading stops, the last of
    ``most_errors`` in a row (null if there are none), and whether the catalog is no longer to be trusted: once a
    ``wrap`` or ``gap`` was met before that, it stays so. Runs of errors are told by the number of good reads before
    them; a log is small, so one task numbers it."""
    order = Window.orderBy("seq")
    good = F.sum(F.col("error").isNull().cast("long")).over(order)
    run = log.select("seq", "error", good.alias("run"))
    place = F.sum(F.col("error").isNotNull().cast("long")).over(Window.partitionBy("run").orderBy("seq"))
    whole = Window.partitionBy(F.lit(1))
    stop = F.min(F.when((F.col("place") == most_errors) & F.col("error").isNotNull(), F.col("seq"))).over(whole)
    read = run.withColumn("place", place).withColumn("stop_seq", stop).where("stop_seq is null or seq <= stop_seq")
    return read.agg(F.max("stop_seq").alias("stop_seq"), F.coalesce(F.bool_or(F.col("error").isin("wrap", "gap")), F.lit(False)).alias("compromised"))
