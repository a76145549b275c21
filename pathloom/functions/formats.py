"""Display formats as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _col

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30
TICKS_TO_EPOCH_US = 11_644_473_600_000_000


def _tenths(x: Column, digits: int) -> Column:
    # half-even on the exact double, as C's printf; format_string would round half up
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def file_size(n: Column | str) -> Column:
    """``0 B``, ``512 B``, ``1.5 KB``, ``2.0 MB``, ``1.25 GB``; null stays null."""
    n = _col(n)
    return (
        F.when(n < KB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MB, F.concat(_tenths(n / F.lit(float(KB)), 1), F.lit(" KB")))
        .when(n < GB, F.concat(_tenths(n / F.lit(float(MB)), 1), F.lit(" MB")))
        .when(n.isNotNull(), F.concat(_tenths(n / F.lit(float(GB)), 2), F.lit(" GB")))
    )


def size_display(is_dir: Column, n: Column, state: Column) -> Column:
    """Sizes as shown in a results table: folders whose size isn't known yet are ``...``, failures ``N/A``."""
    return F.when(state == "failed", "N/A").when(n.isNull(), "...").otherwise(file_size(n))


def rounded_memory(n: Column | str) -> Column:
    """Whole units, rounded half up."""
    n = _col(n)
    unit = lambda u, name: F.concat(F.floor((n + u // 2) / u).cast("string"), F.lit(" " + name))
    return F.when(n >= GB, unit(GB, "GB")).when(n >= MB, unit(MB, "MB")).when(n >= KB, unit(KB, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def memory_or_na(n: Column | str) -> Column:
    return F.when(_col(n) == 0, "N/A").otherwise(rounded_memory(n))


def floored_bytes(n: Column | str) -> Column:
    """Whole units, rounded down; MB is the largest."""
    n = _col(n)
    down = lambda u, name: F.concat(F.floor(n / u).cast("string"), F.lit(name))
    return F.when(n < KB, F.concat(n.cast("string"), F.lit(" B"))).when(n < MB, down(KB, " KB")).otherwise(down(MB, " MB"))


def thousands(n: Column | str) -> Column:
    return F.format_number(_col(n), 0)


def file_time(t: Column | str) -> Column:
    return F.date_format(_col(t), "yyyy-MM-dd HH:mm")


def time_display(t: Column, state: Column) -> Column:
    return F.when(state == "failed", "N/A").when(t.isNull(), "...").otherwise(file_time(t))


def relative_time(ms: Column | str, now_ms: Column) -> Column:
    """How long ago, in the largest whole unit up to days."""
    ms = _col(ms)
    minutes = F.floor((now_ms - ms) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(ms <= 0, "Never").when(now_ms < ms, "Future").when(minutes < 1, "Just now")
        .when(minutes < 60, ago(minutes, "m ago")).when(hours < 24, ago(hours, "h ago"))
        .when(days == 1, "Yesterday").otherwise(ago(days, " days ago"))
    )


def ticks_to_timestamp(ticks: Column | str) -> Column:
    """100 ns ticks since 1601 as a timestamp (the last digit is lost)."""
    t = _col(ticks).cast("long")
    return F.timestamp_micros(F.call_function("div", t - F.pmod(t, F.lit(10)), F.lit(10)) - TICKS_TO_EPOCH_US)


def timestamp_to_ticks(t: Column | str) -> Column:
    return (F.unix_micros(_col(t)) + TICKS_TO_EPOCH_US) * 10


def csv_cell(c: Column | str, guard: bool = True) -> Column:
    """A CSV cell: quoted if it must be; with ``guard``, text that a spreadsheet would run gets a leading quote mark."""
    c = _col(c)
    doubled = F.replace(c, F.lit('"'), F.lit('""'))
    formula = F.left(c, F.lit(1)).isin("=", "+", "-", "@") if guard else F.lit(False)
    return F.when(formula, F.concat(F.lit("\"'"), doubled, F.lit('"'))).when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(c)


def abbreviated(parts: Column, shown: int = 2) -> Column:
    """The first entries of a list, and how many more there are."""
    more = F.size(parts) - shown
    return F.concat(F.array_join(F.slice(parts, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))


def parse_extensions(text: Column | str, separator: str = ";") -> Column:
    """A typed list: blanks trimmed, empty ones dropped, one leading dot (or ``*.``) stripped, ASCII lower case."""
    from .paths import ascii_lower

    trimmed = F.transform(F.split(_col(text), separator), lambda x: F.btrim(x, F.lit(" \t")))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: ascii_lower(F.regexp_replace(x, r"^\*?\.", "")))


#: Ticks that stand for no time: not loaded (greatest) and failed.
NOT_LOADED_TICKS, FAILED_TICKS = (1 << 64) - 1, 1


def ticks_state(ticks: Column | str) -> Column:
    """What a tick count means: ``not_loaded``, ``failed``, or ``loaded``. Decimal input keeps all 64 bits."""
    t = _col(ticks).cast("decimal(20,0)")
    return F.when(t == F.lit(str(NOT_LOADED_TICKS)).cast("decimal(20,0)"), "not_loaded").when(t == FAILED_TICKS, "failed").otherwise("loaded")


def is_epoch_time(ticks: Column | str) -> Column:
    """Times in the year 1601, which stand for none."""
    return (_col(ticks) >= 0) & (_col(ticks) < 366 * 86_400 * 10_000_000)


def clamped(value: int, low: int, high: int) -> int:
    """A setting brought into its range."""
    return max(low, min(high, value))


def truncated_start(path: Column | str, most: int) -> Column:
    """A path in ``most`` characters: its root stays, and dots stand for what is left out after it."""
    p = _col(path)
    root = F.regexp_extract(p, r"^([A-Za-z]:[/\\]|[/\\]+)", 1)
    left = F.lit(most - 3) - F.length(root)
    if most <= 3:
        return F.when(F.length(p) <= most, p).otherwise(F.lit("..."))
    short = F.when(left > 0, F.concat(root, F.lit("..."), F.right(p, left))).otherwise(F.concat(F.lit("..."), F.right(p, F.lit(most - 3))))
    return F.when(F.length(p) <= most, p).otherwise(short)
