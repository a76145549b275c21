"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: id 0 is reserved; a row whose parent is 0 or itself is a root. Attributes are null unless their state is
#: ``loaded``; the other states are ``not_loaded`` and ``failed``.
CATALOG = "id long, parent_id long, name string, full_path string, is_dir boolean, size_bytes long, size_state string, mtime timestamp_ntz, mtime_state string, deleted boolean"
CHANGES = "seq long, ts timestamp_ntz, file_ref long, parent_ref long, name string, is_dir boolean, reasons array<string>"
HISTORY = "id string, params struct<filename: string, path: string, extensions: string, folders_only: boolean, case_sensitive: boolean, time_filter: int, size_filter: long, ai_search_description: string>, custom_name string, is_pinned boolean, created_at long, last_used_at long, pinned_at long"
DEFAULTS = {"size_bytes": "long", "mtime": "timestamp_ntz"}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def as_catalog(df: DataFrame) -> DataFrame:
    """``df`` with all catalog columns; those it lacks get their defaults. Extra columns stay, last."""
    have = set(df.columns)
    defaults = {
        "parent_id": F.lit(0).cast("long"), "is_dir": F.lit(False), "size_bytes": F.lit(None).cast("long"), "mtime": F.lit(None).cast("timestamp_ntz"), "deleted": F.lit(False),
    }
    df = df.withColumns({c: v for c, v in defaults.items() if c not in have})
    states = {f"{a}_state": F.when(F.col(c).isNull(), "not_loaded").otherwise("loaded") for a, c in (("size", "size_bytes"), ("mtime", "mtime")) if f"{a}_state" not in have}
    if "name" not in have:
        from .functions.paths import filename

        states["name"] = filename("full_path")
    if "full_path" not in have:
        states["full_path"] = F.lit(None).cast("string")
    df = df.withColumns(states)
    names = struct(CATALOG).names
    return df.select(*names, *(c for c in df.columns if c not in names))
