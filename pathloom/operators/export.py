"""Sinks: CSV with display values, and path dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import csv_cell
from ..functions.paths import extension, filename
from .results import display

HEADER = "Filename,Size,Last Modified,Full Path,Extension,# Files"
VISIBLE = ("Name", "Size", "Last Modified", "Full Path", "Extension", "# Files")


def _files(df: DataFrame) -> Column:
    return F.coalesce(F.col("file_count").cast("string"), F.lit("...")) if "file_count" in df.columns else F.lit("...")


def csv_lines(results: DataFrame) -> DataFrame:
    """(value): a guarded CSV line per row; files have no number of files."""
    shown = display(results, F.col("is_dir"), _files(results).alias("files"))
    cells = ["filename", "size", "last_modified", "full_path", "extension"]
    return shown.select(F.concat_ws(",", *(csv_cell(c) for c in cells), F.when(F.col("is_dir"), F.col("files")).otherwise(F.lit("-"))).alias("value"))


def export_csv(results: DataFrame, path: str) -> None:
    """Text files of CSV lines, each headed; Spark's own writer would trim blanks and knows no guard."""
    lines = csv_lines(results)

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([HEADER])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], ["value"])

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def clipboard_csv(results: DataFrame, columns: tuple[str, ...] = VISIBLE) -> DataFrame:
    """(value): lines of the chosen columns, without the guard; ``Name`` has its extension."""
    shown = display(results, F.col("is_dir"), _files(results).alias("files"))
    cells = {
        "Name": filename("full_path"), "Size": F.col("size"), "Last Modified": F.col("last_modified"), "Full Path": F.col("full_path"),
        "Extension": extension("full_path"), "# Files": F.when(F.col("is_dir"), F.col("files")).otherwise(F.lit("-")),
    }
    return shown.select(F.concat_ws(",", *(csv_cell(cells[c], guard=False) for c in columns)).alias("value"))


def dump_paths(catalog: DataFrame, path: str) -> None:
    """Every path, one a line."""
    catalog.select("full_path").write.mode("overwrite").text(path)
