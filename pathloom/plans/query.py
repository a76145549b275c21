"""Queries: what the user asks for, and the one predicate it becomes."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, filename
from ..operators.filters import SIZES, TIMES, has_extension, live, size_bucket, time_bucket
from .patterns import detect, to_column


@dataclass(frozen=True)
class SearchQuery:
    """A conjunction; what is empty asks for nothing."""

    filename: str = ""
    path: str = ""
    extensions: list[str] = field(default_factory=list)
    folders_only: bool = False
    case_sensitive: bool = False
    time_filter: str = "None"
    size_filter: str = "None"

    @staticmethod
    def show_all() -> SearchQuery:
        return SearchQuery(path="pp:**")

    @staticmethod
    def typed(filename: str = "", path: str = "", extensions: str = "", **more) -> SearchQuery:
        """From text fields: blanks trimmed, extensions separated by ``;`` or ``,``."""
        parts = [e.strip(" \t") for e in re.split("[;,]", extensions)]
        return SearchQuery(filename.strip(" \t"), path.strip(" \t"), [e for e in parts if e], **more)


def conjuncts(query: SearchQuery, as_of: datetime | None = None) -> list[Column]:
    """Cheap tests first: generated code evaluates them in this order and stops at the first that fails."""
    out = [live()]
    if query.folders_only:
        out.append(F.col("is_dir"))
    if query.size_filter in SIZES:
        out.append(size_bucket(query.size_filter))
    if query.time_filter in TIMES:
        if as_of is None:
            raise ValueError("a time filter needs as_of")
        out.append(time_bucket(query.time_filter, as_of))
    if query.extensions:
        out.append(has_extension(query.extensions, case_sensitive=query.case_sensitive))
    for pattern, column in ((query.filename, filename("full_path")), (query.path, F.col("full_path"))):
        if pattern:
            if detect(pattern) == "path" and not pattern.startswith("pp:") and re.match(r"[A-Za-z]:\\", pattern):
                warnings.warn(f"{pattern!r} is read as a path pattern; \\d and \\w are shorthands there", stacklevel=3)
            test = to_column(pattern, column, query.case_sensitive)
            if test is not None:
                out.append(test)
    return out


def predicate(query: SearchQuery, as_of: datetime | None = None) -> Column:
    tests = conjuncts(query, as_of)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def search(catalog: DataFrame, query: SearchQuery, as_of: datetime | None = None) -> DataFrame:
    """The rows of the catalog that the query asks for: one scan, one filter, no shuffle."""
    return catalog.where(predicate(query, as_of))


def search_rows(catalog: DataFrame, query: SearchQuery, as_of: datetime | None = None) -> DataFrame:
    """id, full_path, is_dir, filename and extension of what is found."""
    return search(catalog, query, as_of).select("id", "full_path", "is_dir", filename("full_path").alias("filename"), extension("full_path").alias("extension"))


def search_ids(catalog: DataFrame, query: SearchQuery, as_of: datetime | None = None) -> DataFrame:
    return search(catalog, query, as_of).select("id")


# ---- JSON


class ConfigError(ValueError):
    """Text that holds no search config."""


def _unwrapped(text: str) -> dict:
    """The config object of a text: a byte order mark and code fences stripped, an API response opened."""

    def load(s: str) -> dict:
        s = s.lstrip("﻿").strip()
        if m := re.fullmatch(r"```[A-Za-z]*\s*(.*?)\s*```", s, re.DOTALL):
            s = m.group(1)
        try:
            out = json.loads(s)
        except ValueError as e:
            raise ConfigError(f"not JSON: {e}") from e
        if not isinstance(out, dict):
            raise ConfigError("no JSON object")
        return out

    found = load(text)
    if "candidates" in found:
        try:
            return load(found["candidates"][0]["content"]["parts"][0]["text"])
        except (LookupError, TypeError, AttributeError) as e:
            raise ConfigError("a response without text") from e
    return found


def parse_config(text: str) -> SearchQuery:
    """A query from JSON; every field is optional, wrongly typed ones count as absent, an empty config asks for all."""
    found = _unwrapped(text)
    if "version" not in found or "search_config" not in found:
        raise ConfigError("version or search_config is missing")
    raw = found["search_config"]
    raw = raw if isinstance(raw, dict) else {"": None}
    strings = {k: raw[k] for k in ("filename", "path", "time_filter", "size_filter") if isinstance(raw.get(k), str)}
    bools = {k: raw[k] for k in ("folders_only", "case_sensitive") if isinstance(raw.get(k), bool)}
    given = raw.get("extensions")
    given = given.split(",") if isinstance(given, str) else given if isinstance(given, list) else []
    extensions = [e for e in (x.strip().lstrip(".") for x in given if isinstance(x, str)) if e]
    query = SearchQuery(extensions=extensions, **strings, **bools)
    if raw == {}:
        query = replace(query, path="pp:")
    return replace(query, path=without_extension(query.path, query.extensions))


def without_extension(path: str, extensions: list[str]) -> str:
    """A path pattern beside an extension list names a folder: an extension at its end goes, ``**`` stands around."""
    if not extensions or not path.startswith("pp:"):
        return path
    inner = path[3:]
    for tail in (t for e in extensions for t in (f"/*.{e}", f".{e}")):
        if inner.endswith(tail):
            inner = inner[: -len(tail)].rstrip("/*")
            break
    if not inner:
        return path if path == "pp:" else "pp:"
    return "pp:" + (inner if inner.startswith("**") else "**/" + inner).rstrip("*/") + "**"


def applied(query: SearchQuery, config: SearchQuery) -> SearchQuery:
    """A config on top of a query: flags always, texts only where given, unknown filters as none."""
    texts = {k: getattr(config, k) for k in ("filename", "path", "extensions") if getattr(config, k)}
    return replace(
        query, **texts, folders_only=config.folders_only, case_sensitive=config.case_sensitive,
        time_filter=config.time_filter if config.time_filter in TIMES else "None", size_filter=config.size_filter if config.size_filter in SIZES else "None",
    )


def valid_path_pattern(path: str) -> bool:
    """Whether a config's path is empty or a path pattern with its prefix."""
    return path == "" or path.startswith("pp:")
