"""What the training-data operators share: row keys, shared tables, batches.

Nothing here depends on a machine-local folder on a cluster: tables that cut
lineage go to the folder named by ``spark.checkpoint.dir``; only where that
is unset (tests) a temporary one is made and set.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every contract here.
WHITE = b" \t\n\x0b\x0c\r"
#: Rows of one Arrow batch handed to Python; texts can be long, so far fewer than Spark's default.
BATCH_ROWS = 1000
#: Folders of the tables that this process has written and not removed.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut there, and lost
    executors cost no recomputation of what stands before it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    # shuffles that only fed this table are unreachable now; their files go once the driver's heap is swept
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing reads them any more: what was derived from them is a
    written table itself."""
    for t in tables:
        delete(t.sparkSession, t.shared_path)


def sweep(spark: SparkSession) -> None:
    """Remove all tables that this process has written and not discarded. Results that were returned as frames
    read some of them, so call this when those results are stored."""
    for path in list(WRITTEN):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this module wrote."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch unless the user has chosen a bound already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10000:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Plan nodes above a file scan that neither repeat nor merge its rows.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "Sample", "ResolvedHint", "LogicalRelation", "RelationV2", "DataSourceV2Relation"}


def _is_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one physical row of a file: only projections and filters above one scan. Above
    joins and explodes a physical key resolves, too, but repeats."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _ROWWISE and node.children().size() == 1:
        node = node.children().head()
    if node.getClass().getSimpleName() not in _ROWWISE or node.children().size():
        return False
    try:
        docs.select("_metadata.row_index")
        return True
    except AnalysisException:
        return False


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have physical keys, else a written copy of it."""
    return docs if _is_scan(docs) else written(docs, "rows")


def with_row_key(docs: DataFrame, file: str, row: str) -> DataFrame:
    """Add a key of each physical row: hash of its file's path and its index in that file.

    Unlike an id column it is unique even where rows repeat, and unlike
    ``monotonically_increasing_id`` it is the same in every scan, however the
    files are split. A frame that is no file scan is written to the shared
    folder first."""
    return scanned(docs).withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index").cast("long")})


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, null as empty."""
    column = batch.column(name).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def trim() -> None:
    """Give memory that the worker has freed back to the system; a worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(it: Iterator[pa.RecordBatch], most: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` text bytes; one longer text stands alone."""
    trim()
    for batch in it:
        column = batch.column(name)
        sizes = [x or 0 for x in pa.compute.binary_length(column).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
