"""Mixing sources to target weights.

Words (the tokens here) of a source, in doc_id order, are one stream, packed
into blocks of ``length`` words. The mix has as many words as all sources
together; a source's target is its weight's share, capped at ``most`` times its
size with the excess shared again. An output shard has ``shard_slots`` slots.
How many of them each source gets is drawn: along a binary tree of shards, the
slots of one half are a multinomial draw from what the sources have left, drawn
again where a source would give more than that. So every shard computes its own
counts without a table of all shards, counts add up to the exact totals, and
reruns agree. The ``j``-th slot of a source takes block ``perm(j mod blocks)``,
where every pass over the source has its own pseudorandom permutation of block
indices (a Feistel network); slots of a shard are shuffled. The last slot is
trimmed, so a source's total is its target to the word. Blocks and slots meet in
one shuffled join on (source, block); ``blocks`` assembles the shards' blocks,
``apply`` gives their pieces as documents, shard by shard.

Another seed gives every shard other blocks and other counts; what a source
gives in all differs only in its last, partial pass.

Prefix sums of words run over a range partitioning by (source, doc_id): sums
within partitions, plus one row per partition and source on the driver; ranges
begin with the source, so these are at most partitions and sources together. A
source with a third of all rows is many partitions like any other. Sources with
their totals and weights are on the driver and in every task.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, last in the order of weights; a null doc_id sorts first in
its source; repeated rows are each a document; an empty table gives an empty
result. Bytes that are no UTF-8 stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, fresh_name, scanned, small_batches, text_bytes, with_row_key, written

U = np.uint64
CONTINUATION = bytes(range(0x80, 0xC0))
TASK_SHARDS = 8  # shards that one task writes, about
KNOWN_ROWS = 200_000  # of partitions and their sources, that are broadcast


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def permuted(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) puts ``x``; four Feistel rounds, walking cycles back into the range."""
    half = U(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = U((1 << int(half)) - 1)
    keys = mixed64(np.arange(1, 5, dtype=U) + U(key & (2**64 - 1)))
    out = np.asarray(x, dtype=U).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mixed64(left + k) & mask), left
            else:
                left, right = right, left ^ (mixed64(right + k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def targets(sizes: dict[str | None, int], most: float = 3.0, weights: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Words per source: weights repeat over the sources by code point, null last; capped, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / share for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass(frozen=True)
class Share:
    """One source's part of the mix: its blocks, the slots it fills, the words of its last slot."""

    key: int
    size: int
    blocks: int
    slots: int
    last: int


def share_of(index: int, size: int, target: float, length: int, seed: int, most: float = 3.0) -> Share:
    key = int(mixed64(np.array([seed * 1_000_003 + index], dtype=U))[0])
    words, blocks = min(int(target + 0.5), int(most * size + 1e-9)), -(-size // length)
    if not size or not words:
        return Share(key, size, blocks, 0, 0)
    passes, rest = divmod(words, size)
    if not rest:
        passes, rest = passes - 1, size
    short = length - (size - (blocks - 1) * length)
    at = int(permuted(np.array([blocks - 1]), blocks, key + passes, inverse=True)[0])
    before = lambda j: j * length - short * (at < j)
    k = -(-rest // length)
    k += before(k) < rest
    return Share(key, size, blocks, passes * blocks + k, rest - before(k - 1))


def drawn(k: int, left: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of ``k`` draws from what is left of each source, never more than is left."""
    out = np.zeros_like(left)
    while (need := k - int(out.sum())) > 0:
        rest = left - out
        out = np.minimum(out + rng.multinomial(need, rest / rest.sum()), left)
    return out


def shard_counts(shard: int, shards: int, slots: np.ndarray, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source before this shard, and in it."""
    lo, hi, before, here = 0, shards, np.zeros_like(slots), slots
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = drawn((mid - lo) * shard_slots, here, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            hi, here = mid, left
        else:
            lo, before, here = mid, before + left, here - left
    return before, here


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, file, row, size of each row, written to the shared folder."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            n = pa.array([len(t.split()) for t in text_bytes(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "file", "row")), n], ["doc_id", "source", "file", "row", "size"])

    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), "file", "row")
    return written(keyed.mapInArrow(run, "doc_id long, source string, file long, row long, size long"), "sizes")


@dataclass
class Mix:
    """``pieces``: one row per document and slot that takes words of it (shard, slot, place in its source's stream,
    first and end word); ``measured``: one row per document with its source's size and target."""

    pieces: DataFrame
    measured: DataFrame
    shards: int = 0


def mix(docs: DataFrame, length: int = 1024, shard_slots: int = 1024, seed: int = 7, most: float = 3.0, weights: tuple[float, ...] = (1, 2, 3)) -> Mix:
    spark = docs.sparkSession
    order = ["doc_id", "file", "row"]
    ranged = sizes(scanned(docs)).repartitionByRange("source", *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    # one row per partition and source
    sums = ranged.groupBy("part", "source").agg(F.sum("size").alias("n")).collect()
    total: dict[str | None, int] = {}
    begins = []
    for r in sorted(sums, key=lambda r: r["part"]):
        begins.append((r["part"], r["source"], total.get(r["source"], 0)))
        total[r["source"]] = total.get(r["source"], 0) + r["n"]
    goal = targets(total, most, weights)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    shares = [share_of(i, total[s], goal[s], length, seed, most) for i, s in enumerate(names)]
    known = spark.createDataFrame([(p, s, b, index[s], total[s], goal[s]) for p, s, b in begins], "part int, source string, before long, source_no int, source_size long, target double")
    known = F.broadcast(known) if len(begins) <= KNOWN_ROWS else known

    running = Window.partitionBy("part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0)))
    placed = placed.join(known.withColumnRenamed("source", "s"), (placed["part"] == known["part"]) & placed["source"].eqNullSafe(F.col("s"))).drop("part", "s")
    placed = placed.select(*order, "source", "size", "source_no", "source_size", "target", (F.col("before") + F.col("inside")).alias("begin"))

    counts = np.array([s.slots for s in shares], dtype=np.int64)
    n_shards = -(-int(counts.sum()) // shard_slots) if len(counts) else 0

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for shard in batch.column(0).to_pylist():
                before, here = shard_counts(shard, n_shards, counts, shard_slots, seed)
                place = np.random.default_rng([seed, shard, n_shards, 1]).permutation(int(here.sum()))
                done = 0
                for no, (b, n) in enumerate(zip(before.tolist(), here.tolist())):
                    if not n:
                        continue
                    s, j = shares[no], np.arange(b, b + n)
                    block = np.empty(n, np.int64)
                    for e in range(b // s.blocks, (b + n - 1) // s.blocks + 1):
                        of = j // s.blocks == e
                        block[of] = permuted(j[of] % s.blocks, s.blocks, s.key + e)
                    take = np.where(j == s.slots - 1, s.last, length)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(place[done : done + n]), pa.array(np.full(n, no, np.int32)), pa.array(block), pa.array(take)], ["shard", "slot", "source_no", "block", "take"])
                    done += n

    # Spark takes slots for as few rows as shards, so the join is told to shuffle them
    slots = spark.range(0, n_shards, 1, max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(fill, "shard long, slot long, source_no int, block long, take long")
    end = F.col("begin") + F.col("size")
    per_block = placed.where("size > 0").select(*order, "source_no", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {length}"), F.expr(f"(begin + size - 1) div {length}"))).alias("block"))
    origin = F.col("block") * length
    per_block = per_block.withColumns({"lo": F.greatest(F.col("begin") - origin, F.lit(0)), "hi": F.least(end - origin, F.lit(length)), "shift": origin - F.col("begin")})
    met = per_block.join(slots.hint("merge"), ["source_no", "block"]).withColumn("hi", F.least("hi", "take")).where("hi > lo")
    pieces = met.select(*order, "shard", "slot", "begin", (F.col("shift") + F.col("lo")).alias("first_word"), (F.col("shift") + F.col("hi")).alias("end_word"))
    return Mix(pieces, placed, n_shards)


def taken(mixed: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the output shards that take words of it (in order)."""
    keys = ["file", "row"]
    words = mixed.pieces.groupBy(*keys).agg(F.sum(F.col("end_word") - F.col("first_word")).alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    return mixed.measured.join(words, keys, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<long>")).alias("shards"))


def counts(mixed: Mix) -> DataFrame:
    """Slots and words of each source in each output shard: shard, source, slots, words."""
    source = mixed.measured.select("file", "row", "source")
    pieces = mixed.pieces.join(source, ["file", "row"])
    return pieces.groupBy("shard", "source").agg(F.count_distinct("slot").alias("slots"), F.sum(F.col("end_word") - F.col("first_word")).alias("words"))


def _pieces(docs: DataFrame, mixed: Mix, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """One row per piece, with columns of ``docs``, ``text`` cut to its words; and the names under which the piece's
    shard, slot and begin follow."""
    file, row, cut, *rest = (fresh_name(docs, n) for n in ("file_key", "row_key", "cuts", "shard", "slot", "begin"))
    names = dict(zip(("shard", "slot", "begin"), rest))
    cuts = mixed.pieces.groupBy("file", "row").agg(F.collect_list(F.struct("first_word", "end_word", *names)).alias(cut)).withColumnsRenamed({"file": file, "row": row})
    joined = with_row_key(docs, file, row).join(cuts, [file, row]).select(*columns, cut)
    kinds = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(n, T.LongType()) for n in rest)])
    n_chars = next((c for c in columns if c == "n_chars"), None)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            of, texts = [], []
            for i, (text, parts) in enumerate(zip(text_bytes(batch), batch.column(cut).to_pylist())):
                spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
                for p in parts:
                    of.append(i)
                    texts.append(text[spans[p["first_word"]][0] : spans[p["end_word"] - 1][1]])
            flat = pa.compute.list_flatten(batch.column(cut))
            out = batch.drop_columns([cut]).take(pa.array(of, pa.int64()))
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).view(pa.string()))
            if n_chars:
                at = out.schema.get_field_index(n_chars)
                out = out.set_column(at, n_chars, pa.array([len(t.translate(None, CONTINUATION)) for t in texts], out.schema.field(at).type))
            for name, own in names.items():
                out = out.append_column(own, pa.compute.struct_field(flat, name))
            yield out

    return joined.mapInArrow(run, kinds), names


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per piece, ``text`` cut to its words (and the white
    space between them), ``n_chars`` (if there) its length. A shard's pieces follow each other in one partition, slot
    after slot, in the order of their source's stream. Documents taken twice appear twice."""
    docs = scanned(docs)
    mixed = mix(docs, **options)
    rows, names = _pieces(docs, mixed, docs.columns)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mixed.shards // TASK_SHARDS))
    return rows.repartition(tasks, names["shard"]).sortWithinPartitions(*names.values()).select(*docs.columns)


def blocks(docs: DataFrame, **options) -> DataFrame:
    """The assembled output shards: shard, slot, n_words, text, one row per slot; texts of a slot's pieces are joined
    by line feeds. All slots have ``length`` words but for the last block of a source and the last slot it fills."""
    docs = scanned(docs)
    rows, names = _pieces(docs, mix(docs, **options), ["text"])
    piece = F.struct(F.col(names["begin"]).alias("begin"), F.col("text").alias("text"))
    slots = rows.groupBy(F.col(names["shard"]).alias("shard"), F.col(names["slot"]).alias("slot")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "\n").alias("text"))
    return slots.select("shard", "slot", F.size(F.regexp_extract_all("text", F.lit("([^ \t\n\x0b\f\r]+)"), F.lit(1))).cast("long").alias("n_words"), "text")
