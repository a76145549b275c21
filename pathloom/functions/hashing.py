"""64-bit FNV-1a ids. Spark has no wrapping 64-bit multiply in ANSI mode, so this is an Arrow-batched UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import path_key

# The public FNV-1a parameters.
OFFSET, PRIME = 14695981039346656037, 1099511628211


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & (1 << 64) - 1
    return h


def fnv_hex(c: Column) -> Column:
    """The hash of a string's UTF-8 as 16 hex digits."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f"{fnv1a(x.encode()):016x}")

    return run(c)


def path_hash(path: Column | str) -> Column:
    """The hash of a path whose separators are all ``/``, without trailing ones: equal for paths of one key."""
    return fnv_hex(path_key(path))
