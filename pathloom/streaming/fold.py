"""Folding change records into a catalog, in batches or as a stream.

Per file, records apply in the order of ``seq``: a delete (or any record but a
rename that bears a system name) ends what was before, creates and renames set
parent and name, data changes make the size unknown, a rename to a system name
deletes the whole subtree. All of that is told by the last records of each
kind, so a fold is one aggregation with partial maxima: no window, no sort, and
a file with very many records is a few rows by the time it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import is_system_name, record_no
from ..operators.catalog import invalidate_sizes, remove, remove_subtrees, upsert
from ..sources.journal import actions

DATA = ("DATA_EXTEND", "DATA_TRUNCATION", "DATA_OVERWRITE")


def _has(*reasons: str) -> Column:
    return F.arrays_overlap("reasons", F.array(*map(F.lit, reasons)))


def fold(changes: DataFrame) -> DataFrame:
    """Per file: what to do with it (op: upsert, delete, subtree_delete, invalidate), and the last seq of its kind.

    Columns: id, op, parent_id, name, is_dir, seq, fresh (it was deleted before it was created again),
    data_changed."""
    c = actions(changes)
    renamed = _has("RENAME_NEW_NAME")
    dead, system = _has("FILE_DELETE"), is_system_name("name")
    kills = dead | system
    sets = (_has("FILE_CREATE") | renamed) & ~kills
    of = lambda test, value="seq": F.max(F.when(test, F.col(value)))
    last = F.max_by(F.struct("file_ref", "parent_ref", "name", "is_dir"), F.when(sets, F.col("seq")))
    g = c.groupBy(record_no("file_ref").alias("record")).agg(
        of(kills).alias("killed"), of(system & renamed & ~dead).alias("subtree"), of(sets).alias("set"), last.alias("row"), of(_has(*DATA) & ~kills).alias("data"), F.max_by("file_ref", "seq").alias("ref"),
    )
    never = F.lit(-1)
    killed, set_, data = F.coalesce("killed", never), F.coalesce("set", never), F.coalesce("data", never)
    op = (
        F.when(set_ > killed, "upsert")
        .when((killed >= 0) & (F.col("subtree") == killed), "subtree_delete")
        .when(killed >= 0, "delete")
        .when(data >= 0, "invalidate")
    )
    live = F.col("op") == "upsert"
    return g.withColumn("op", op).where("op is not null").select(
        F.when(live, F.col("row.file_ref")).otherwise(F.col("ref")).alias("id"), "op", F.when(live, F.col("row.parent_ref")).alias("parent_id"), F.when(live, F.col("row.name")).alias("name"),
        F.when(live, F.col("row.is_dir")).alias("is_dir"), F.greatest("killed", "set", "data").alias("seq"), (live & (killed >= 0)).alias("fresh"), (data > killed).alias("data_changed"),
    )


def apply_changes(catalog: DataFrame, changes: DataFrame, volume_root: str = "") -> DataFrame:
    """The catalog after all changes. Changes mean the row of their record number, whatever its sequence bits; a record
    that was used anew, with other sequence bits, replaces the row that had it."""
    from ..plans.lineage import cut

    done = cut(fold(changes).withColumn("_record", record_no("id")))
    told = done.select("_record", F.col("id").alias("_id"), "op", "fresh", "data_changed")
    met = cut(catalog.select("id", record_no("id").alias("_record")).join(told, "_record"))
    reused = (F.col("op") == "upsert") & (F.col("id") != F.col("_id"))
    out = remove_subtrees(catalog, met.where("op = 'subtree_delete'"))
    out = remove(out, met.where((F.col("op") == "delete") | F.col("fresh") | reused))
    out = upsert(out, done.where("op = 'upsert'"), volume_root)
    # of the rows that were there before; new ones have no size yet
    return invalidate_sizes(out, met.where("data_changed"))


def stream_into(changes: DataFrame, path: str, checkpoint: str, volume_root: str = "", then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Apply a stream of changes to the catalog at ``path``, a new version (``v=N``) per batch; ``then`` gets each
    (standing queries run there). A batch that is replayed writes the same version again, from the one before."""
    spark = changes.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{path}/v={n}")
        new = apply_changes(old, df, volume_root)
        new.write.mode("overwrite").parquet(f"{path}/v={n + 1}")
        if then is not None:
            then(spark.read.parquet(f"{path}/v={n + 1}"), n)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def start_catalog(catalog: DataFrame, path: str) -> None:
    """The version that a stream's first batch reads."""
    catalog.write.mode("overwrite").parquet(f"{path}/v=0")


STATE = "parent_id long, name string, is_dir boolean, alive boolean"
OUTPUT = "id long, op string, parent_id long, name string, is_dir boolean, seq long"


def stateful_ops(changes: DataFrame) -> DataFrame:
    """The stream of operations with the state of every file kept between batches: creates, renames and moves are
    told apart, and deletes of unknown files dropped. For state stores that hold a catalog (RocksDB)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parent, name, is_dir, alive = state.get if state.exists else (0, "", False, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            reasons = set(r.reasons)
            if "FILE_DELETE" in reasons or r.name_.startswith("$"):
                if alive:
                    op = "subtree_delete" if "RENAME_NEW_NAME" in reasons and "FILE_DELETE" not in reasons else "delete"
                    out.append((r.file_ref, op, parent, name, is_dir, r.seq))
                alive = False
            elif reasons & {"FILE_CREATE", "RENAME_NEW_NAME"}:
                op = "create" if not alive else "move" if r.parent_ref != parent else "rename" if r.name_ != name else "update"
                parent, name, is_dir, alive = int(r.parent_ref), r.name_, bool(r.is_dir), True
                out.append((r.file_ref, op, parent, name, is_dir, r.seq))
            elif reasons & set(DATA) and alive:
                out.append((r.file_ref, "invalidate", parent, name, is_dir, r.seq))
        state.update((parent, name, is_dir, alive))
        yield pd.DataFrame(out, columns=["id", "op", "parent_id", "name", "is_dir", "seq"])

    keyed = actions(changes).withColumnRenamed("name", "name_").withColumn("record", record_no("file_ref"))
    return keyed.groupBy("record").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
