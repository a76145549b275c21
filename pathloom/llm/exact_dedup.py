"""Exact deduplication by a tree merge of sorted digest runs.

Texts are equal when identical without ASCII white space. Each input partition
sorts its digests into one run per digest range, folding copies; in each round
the runs of ``fan_in`` neighbouring partitions meet and are merged in one pass
(a binomial tree for 2, of higher radix else), again folding equal digests to
the row that stays and the group's size, until one run per range is left. So a
digest occurs once per run, however many copies there are. Ranges keep every run
bounded; no task sees more than one range.

Rows meet their group's answer by digest. The largest groups' answers are
broadcast (groups over a hundred thousandth of all rows, so never more than a
hundred thousand of them), and their copies stay where they are; what is
shuffled has small groups only.

Identifiers are verified where runs meet: rows fold only if SHA-256, an
independent 64-bit hash and the length of the normalised text all agree;
otherwise they stay separate groups. The texts themselves aren't compared again.

Defined results: null text is empty; of equal texts the one with the most code
points, then the smallest doc_id stays, a null doc_id after all others; of
rows repeated with the same id and text exactly one (the first in its file)
stays. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, scanned, small_batches, with_row_key, written

#: SHA-256, check hash, bytes, minus code points, id is null, id, file key, row in file, group size.
RECORD = struct.Struct(">32sqqqqqqqq")
RUN_ROWS = 100_000  # rows that a leaf sorts at a time
RANGE_ROWS = 100_000  # rows of a digest range, about
HOT_GROUPS = 100_000  # answers that are broadcast, at most; some 100 bytes each
HOT_ROWS = 1000  # rows of a group whose answer is broadcast, at least


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, file, row, sha, chk, n_bytes, n_chars. Native expressions over one scan."""
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "file", "row")
    bare = F.translate("text", " \t\n\x0b\x0c\r", "")
    return keyed.select("doc_id", "file", "row", F.unhex(F.sha2(bare, 256)).alias("sha"), F.xxhash64(bare).alias("chk"), F.octet_length(bare).cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"))


def fold(records: Iterator[tuple]) -> Iterator[tuple]:
    """Of sorted records, the first of each group of equal digests, with the group's size."""
    best = None
    for r in records:
        if best is None or r[:3] != best[:3]:
            if best is not None:
                yield (*best[:8], size)
            best, size = r, 0
        size += r[8]
    if best is not None:
        yield (*best[:8], size)


def pack(records: Iterator[tuple]) -> bytes:
    return b"".join(RECORD.pack(*r) for r in records)


def merge_runs(runs: list[bytes]) -> bytes:
    """One sorted run of several, by a multiway merge."""
    return pack(fold(heapq.merge(*map(RECORD.iter_unpack, runs))))


def _leaves(ranges: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, rows = TaskContext.get().partitionId(), []

        def flush():
            rows.sort()
            by: dict[int, list[tuple]] = {}
            for r in fold(iter(rows)):
                by.setdefault(int.from_bytes(r[0][:4], "big") * ranges >> 32, []).append(r)
            rows.clear()
            if by:
                yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([leaf] * len(by), pa.int32()), pa.array([pack(iter(x)) for x in by.values()], pa.binary())], ["part", "node", "run"])

        for batch in it:
            c = batch.to_pydict()
            rows += [(s, k, b, -n, int(d is None), d or 0, f, r, 1) for s, k, b, n, d, f, r in zip(c["sha"], c["chk"], c["n_bytes"], c["n_chars"], c["doc_id"], c["file"], c["row"])]
            if len(rows) >= RUN_ROWS:
                yield from flush()
        yield from flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    return pa.table({"part": table.column("part")[:1], "node": table.column("node")[:1], "run": pa.array([merge_runs(table.column("run").to_pylist())], pa.binary())})


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for run in batch.column("run").to_pylist():
            c = list(zip(*RECORD.iter_unpack(run)))
            null = [None if z else d for z, d in zip(c[4], c[5])]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), *(pa.array(x, pa.int64()) for x in (c[1], c[2], null, c[6], c[7], c[8]))], ["sha", "chk", "n_bytes", "keep_id", "keep_file", "keep_row", "group_size"])


def groups(base: DataFrame, fan_in: int = 4) -> DataFrame:
    """One row per distinct text: its digest, the row that stays, the group's size."""
    n_leaves, n_rows = base.rdd.getNumPartitions(), base.count()  # the number of partitions is known without a job
    runs = base.mapInArrow(_leaves(max(16, -(-n_rows // RANGE_ROWS))), "part int, node int, run binary")
    width = 1
    while True:
        node = F.floor(F.col("node") / fan_in).cast("int")
        runs = runs.withColumn("node", node).groupBy("part", "node").applyInArrow(_meet, "part int, node int, run binary")
        width *= fan_in
        if width >= n_leaves:
            return runs.mapInArrow(_rows, "sha binary, chk long, n_bytes long, keep_id long, keep_file long, keep_row long, group_size long")


def label(docs: DataFrame, fan_in: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the row's key (file, row)."""
    small_batches(docs.sparkSession)
    base = written(digests(scanned(docs)), "digests")
    found, key = written(groups(base, fan_in), "groups"), ["sha", "chk", "n_bytes"]
    large = F.col("group_size") > max(HOT_ROWS, base.count() // HOT_GROUPS)
    hot = F.broadcast(found.where(large))
    both = base.join(hot, key).unionByName(base.join(hot.select(*key), key, "left_anti").join(found.where(~large), key))
    return both.select(
        "doc_id", "keep_id", "group_size", ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "file", "row"
    )


def keep(docs: DataFrame, fan_in: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = scanned(docs)
    file, row = fresh_name(docs, "file_key"), fresh_name(docs, "row_key")
    stay = label(docs, fan_in).where("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    return with_row_key(docs, file, row).join(stay, [file, row], "left_semi").drop(file, row)
