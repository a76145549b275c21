"""What happens to found rows: sorting, totals, display columns, marks and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import size_display, time_display
from ..functions.paths import extension, filename, stem
from ..plans.lineage import cut
from .filters import in_folder

SORTS = ("Filename", "Size", "LastModified", "FullPath", "Extension", "FolderFiles")


def sort_keys(column: str, ascending: bool = True) -> list[Column]:
    """Keys of a one-column sort; the full path breaks ties in the same direction, the id makes it total."""
    if column not in SORTS:
        raise ValueError(f"no column {column!r}")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))  # noqa: E731 - unknown counts as 0
    keys = {
        "Filename": [filename("full_path")],
        "Size": [number("size_bytes")],
        # times that failed come before, those not loaded after all others
        "LastModified": [F.when(F.col("mtime_state") == "failed", 0).when(F.col("mtime").isNull(), 2).otherwise(1), F.col("mtime")],
        "FullPath": [],
        "Extension": [extension("full_path")],
        "FolderFiles": [number("file_count") if column == "FolderFiles" else F.lit(0)],
    }[column] + [F.col("full_path"), F.col("id")]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]


def sort_results(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(*sort_keys(column, ascending))


def top_results(df: DataFrame, column: str, n: int, ascending: bool = True) -> DataFrame:
    """The first rows of a sort, without sorting the rest."""
    return df.orderBy(*sort_keys(column, ascending)).limit(n)


def total_bytes(df: DataFrame) -> DataFrame:
    """One row: count of rows, and bytes of files whose size is known."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size_bytes"))), F.lit(0)).alias("total_bytes"))


def display(df: DataFrame, *more: Column) -> DataFrame:
    """Rows as a table shows them, and ``more`` columns of theirs."""
    return df.select(
        "id", stem("full_path").alias("filename"), size_display(F.col("is_dir"), F.col("size_bytes"), F.col("size_state")).alias("size"),
        time_display(F.col("mtime"), F.col("mtime_state")).alias("last_modified"), "full_path", extension("full_path").alias("extension"), *more,
    )


def with_attributes(results: DataFrame, attributes: DataFrame) -> DataFrame:
    """Results with size and time from a table (id, size_bytes, mtime[, failed]); what it lacks stays not loaded."""
    extra = attributes.select("id", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there") & F.col("_size").isNotNull(), "loaded").when(F.col("_there"), "failed").otherwise("not_loaded")
    joined = results.drop("size_bytes", "mtime", "size_state", "mtime_state").join(extra, "id", "left")
    return joined.select("*", F.col("_size").alias("size_bytes"), F.col("_mtime").alias("mtime"), state.alias("size_state"), state.alias("mtime_state")).drop("_size", "_mtime", "_there")


# ---- marks: one-column frames of ids


def mark_folder(marks: DataFrame, catalog: DataFrame, folder: str) -> DataFrame:
    return marks.select("id").union(catalog.where(in_folder(folder)).select("id")).distinct()


def unmark_folder(marks: DataFrame, catalog: DataFrame, folder: str) -> DataFrame:
    return marks.select("id").join(catalog.where(in_folder(folder)).select("id"), "id", "left_anti")


def invert_marks(marks: DataFrame, shown: DataFrame) -> DataFrame:
    """Marks of the shown rows turn over; others stay."""
    a, b = marks.select("id"), shown.select("id")
    return a.join(b, "id", "left_anti").union(b.join(a, "id", "left_anti"))


def marked(results: DataFrame, marks: DataFrame) -> DataFrame:
    return results.join(marks.select("id"), "id", "left_semi")


# ---- positions


def positions(df: DataFrame, keys: list[Column], name: str = "row_index") -> DataFrame:
    """``df`` with each row's place (from 0) in an order. Places count within range partitions, and the partitions'
    sizes (a row each on the driver) are added up, so no task holds all rows."""
    at = df.orderBy(*keys).withColumn("_m", F.monotonically_increasing_id())
    placed = cut(at.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}))
    before, rows = 0, []
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    return placed.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_m", "_part", "_at", "_before")


def numbered(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows with their place (from 0) in a sort."""
    return positions(df, sort_keys(column, ascending))


def remap_selection(selected: DataFrame, new_results: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Places, in the new order, of rows whose path was selected before."""
    return numbered(new_results, column, ascending).join(selected.select("full_path").distinct(), "full_path", "left_semi")


def neighbours(matches: DataFrame) -> DataFrame:
    """Per match (row_index) the next and the previous one, around the ends."""
    at = cut(positions(matches, [F.col("row_index")], "_i"))
    n = at.count()
    other = at.select(F.col("_i").alias("_j"), F.col("row_index").alias("_row"))
    for name, step in (("next_row", 1), ("previous_row", n - 1)):
        at = at.withColumn("_j", (F.col("_i") + step) % max(1, n)).join(other, "_j").drop("_j").withColumnRenamed("_row", name)
    return at.drop("_i")
