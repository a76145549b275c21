"""Column functions over paths. Both ``/`` and ``\\`` separate; all folding is ASCII only.

Everything is a composition of built-ins, so it stays inside whole-stage
codegen; regular expressions are used only where plain string functions can't
express a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RECORD_MASK = 0x0000FFFFFFFFFFFF
ROOT_RECORD = 5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z, nothing else (``lower`` would fold all of Unicode)."""
    return F.translate(_col(c), UPPER, LOWER)


def forward(c: Column | str) -> Column:
    """Backslashes as slashes."""
    return F.translate(_col(c), "\\", "/")


def filename(path: Column | str) -> Column:
    """What follows the last separator."""
    return F.substring_index(forward(path), "/", -1)


def _after_dot(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def extension(path: Column | str) -> Column:
    """After the last dot of the filename, unless that dot is its first or last character; else ''."""
    name = filename(path)
    last = _after_dot(name)
    return F.when((F.length(name) - F.length(last) >= 2) & (last != ""), last).otherwise(F.lit(""))


def utility_extension(path: Column | str) -> Column:
    """The laxer rule of path helpers: ``.gitignore`` has the extension ``gitignore``."""
    name = filename(path)
    return F.when(F.instr(name, ".") > 0, _after_dot(name)).otherwise(F.lit(""))


def stem(path: Column | str) -> Column:
    """The filename without its extension."""
    name, ext = filename(path), extension(path)
    return F.when(ext != "", F.substr(name, F.lit(1), F.length(name) - F.length(ext) - 1)).otherwise(name)


def directory(path: Column | str) -> Column:
    """What stands before the last separator; a root keeps its own (``/f`` -> ``/``, ``C:\\f`` -> ``C:\\``)."""
    p = _col(path)
    n = F.length(p) - F.length(filename(p))
    before, root = F.substr(p, F.lit(1), n - 1), F.substr(p, F.lit(1), n)
    return F.when(n == 0, F.lit("")).when((n == 1) | ((n == 3) & (F.substr(p, F.lit(2), F.lit(1)) == ":")), root).otherwise(before)


def trim_separators(path: Column | str) -> Column:
    return F.rtrim(_col(path), F.lit("/\\"))


def path_key(path: Column | str) -> Column:
    """Equal for paths that differ in kind of separators or trailing ones only."""
    return F.rtrim(forward(path), F.lit("/"))


def ancestors(path: Column | str) -> Column:
    """All proper prefixes that end before a separator, shortest first; no empty one."""
    p = _col(path)
    at = F.sequence(F.lit(2), F.greatest(F.length(p), F.lit(2)))
    cut = F.transform(at, lambda i: F.when(F.substr(p, i, F.lit(1)).isin("/", "\\"), F.substr(p, F.lit(1), i - 1)))
    return F.when(F.length(p) >= 2, F.filter(cut, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def ancestor_keys(path: Column | str) -> Column:
    """The path keys of all ancestors, a step per component; the root of ``/x`` is ''."""
    parts = F.split(path_key(path), "/")
    n = F.size(parts)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(n >= 2, cut).otherwise(F.array().cast("array<string>"))


def components(path: Column | str) -> Column:
    """struct(full_path, filename, extension, directory, has_extension)."""
    ext = extension(path)
    return F.struct(_col(path).alias("full_path"), filename(path).alias("filename"), ext.alias("extension"), directory(path).alias("directory"), (ext != "").alias("has_extension"))


def join_path(base: Column | str, part: Column | str, separator: str = "/") -> Column:
    """One separator between two non-empty parts."""
    b, c = _col(base), _col(part)
    left, right = F.right(b, F.lit(1)).isin("/", "\\"), F.left(c, F.lit(1)).isin("/", "\\")
    return (
        F.when(b == "", c).when(c == "", b)
        .when(left & right, F.concat(b, F.substr(c, F.lit(2))))
        .when(left | right, F.concat(b, c))
        .otherwise(F.concat(b, F.lit(separator), c))
    )


def is_volume_root(path: Column | str) -> Column:
    return _col(path).rlike(r"\A(?:[/\\]|(?s:.):[/\\])\z")


def is_drive_key(path: Column | str) -> Column:
    return _col(path).rlike(r"\A[A-Za-z]:\z")


def is_volume_root_child(path: Column | str) -> Column:
    """One component directly below a volume root."""
    return _col(path).rlike(r"\A(?:(?s:.):)?[/\\][^/\\]+\z")


def is_absolute(path: Column | str) -> Column:
    return _col(path).rlike(r"\A(?:[/\\]|[A-Za-z]:[/\\])")


def is_cloud(path: Column | str) -> Column:
    """Below a OneDrive folder."""
    return ascii_lower(path).rlike(r"[/\\]onedrive[^/\\]*[/\\]")


def is_safe(path: Column | str) -> Column:
    """No parent steps and no NUL."""
    p = _col(path)
    return ~p.contains("..") & (F.instr(p, "\0") == 0)


def is_system_name(name: Column | str) -> Column:
    return _col(name).startswith("$")


def record_no(id_: Column | str) -> Column:
    """The record bits of a file reference."""
    return _col(id_).bitwiseAND(F.lit(RECORD_MASK))


def until_nul(c: Column | str) -> Column:
    return F.substring_index(_col(c), "\0", 1)


def with_parts(df: DataFrame, path: str = "full_path") -> DataFrame:
    """``df`` with filename, stem, extension and directory."""
    return df.withColumns({"filename": filename(path), "stem": stem(path), "extension": extension(path), "directory": directory(path)})
