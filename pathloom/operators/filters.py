"""Predicates besides patterns: live rows, folders, extensions, buckets of size and time, folder scopes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import ascii_lower, directory, extension, filename, is_cloud

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30
#: Bucket -> [from, to) in bytes.
SIZES: dict[str, tuple[int, int | None]] = {
    "Empty": (0, 1), "Tiny": (1, KB), "Small": (KB, 100 * KB), "Medium": (100 * KB, 10 * MB),
    "Large": (10 * MB, 100 * MB), "Huge": (100 * MB, GB), "Massive": (GB, None),
}
# The buckets' labels.
SIZE_LABELS = {
    "Empty": "Empty (0 bytes)", "Tiny": "Tiny (< 1 KB)", "Small": "Small (1-100 KB)", "Medium": "Medium (100 KB - 10 MB)",
    "Large": "Large (10-100 MB)", "Huge": "Huge (100 MB - 1 GB)", "Massive": "Massive (> 1 GB)",
}
TIMES = {"Today": "DAY", "ThisWeek": "WEEK", "ThisMonth": "MONTH", "ThisYear": "YEAR", "Older": None}
MAX_EXTENSION = 255


def live() -> Column:
    return ~F.coalesce(F.col("deleted"), F.lit(False))


def size_bucket(name: str, size: str = "size_bytes") -> Column:
    """Files of a known size in the bucket; plain comparisons, so they reach the scan's statistics."""
    low, high = SIZES[name]
    test = F.col(size).isNotNull() & ~F.col("is_dir") & (F.col(size) >= low)
    return test if high is None else test & (F.col(size) < high)


def time_bucket(name: str, as_of: datetime, mtime: str = "mtime") -> Column:
    """Rows of a known time since the start of the day, week (Monday), month or year of ``as_of``, or older than
    365 days. The limit is a literal, so the comparison reaches the scan."""
    now = as_of.replace(tzinfo=None)
    if TIMES[name] is None:
        return F.col(mtime) < F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL '365' DAY")
    return F.col(mtime) >= F.date_trunc(TIMES[name], F.lit(now)).cast("timestamp_ntz")


def extension_set(extensions: list[str], case_sensitive: bool = False) -> list[str]:
    """Without a leading dot or ``*.``, folded unless case counts, sorted, each once."""
    out = set()
    for e in extensions:
        e = e[2:] if e.startswith("*.") else e[1:] if e.startswith(".") else e
        out.add(e if case_sensitive else e.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return sorted(out)


def has_extension(extensions: list[str], path: str = "full_path", case_sensitive: bool = False) -> Column:
    """Whether the row's extension is in the set; '' stands for none."""
    ext = extension(path)
    if case_sensitive:
        return ext.isin(extension_set(extensions, True))
    return (F.octet_length(ext) <= MAX_EXTENSION) & ascii_lower(ext).isin(extension_set(extensions))


def within_results(text: str, path: str = "full_path") -> Column:
    """Search in results: the text in the filename or the directory, in any case."""
    needle = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return ascii_lower(filename(path)).contains(needle) | ascii_lower(directory(path)).contains(needle)


def in_folder(folder: str, path: str = "full_path") -> Column:
    """The folder itself and all below it."""
    base = folder.rstrip("/\\")
    p = F.col(path)
    return (p == folder) | p.startswith(base + "/") | p.startswith(base + "\\")


def size_label(size: str = "size_bytes") -> Column:
    """The label of a file's size bucket; ``None`` for folders and unknown sizes."""
    return F.coalesce(*(F.when(size_bucket(name, size), label) for name, label in SIZE_LABELS.items()), F.lit("None"))


def time_bucket_or_deferred(name: str, as_of: datetime, path: str = "full_path") -> Column:
    """``time_bucket``, or a file in a cloud folder whose time isn't loaded: it stays among the results until it is."""
    return F.coalesce(time_bucket(name, as_of), F.lit(False)) | (is_cloud(path) & (F.col("mtime_state") == "not_loaded"))
