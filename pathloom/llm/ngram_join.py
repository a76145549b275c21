"""Jaccard similarity join over word n-grams, as links, components or kept documents.

A document's set are the hashes of its distinct n-grams; equal sets are one
node from the start, whatever their number. Two nodes link when
``100 * overlap >= percent * union``.

1. One pass counts n-grams over all documents in a hashed array of fixed size;
   its logarithms, a few MB however large the input, fix a global rare-first
   order. (Any fixed order gives the same links; the counts only keep frequent
   n-grams out of prefixes.)
2. Prefix filter: nodes that link share one of their rarest
   ``n - ceil(percent * n / 100) + 1`` n-grams. Prefix rows are dealt out by
   n-gram, those of n-grams that a sample shows to be frequent by a salt, too;
   n-grams that only one node has fall away as they stream by.
3. Candidates pass the length filter, the positional filter and a suffix
   filter: set sizes in 256 hash ranges bound the distance from below.
4. Every distinct candidate pair that is left is verified once against the
   texts: those of the second step below only if the first hadn't verified them.

Groups of copies would make quadratically many pairs, and components don't need
them: first each block of an n-gram's rows gives a spanning forest of its most
similar pairs (by the suffix bound), then, with the components so found, all
candidate pairs *between* components are verified, in blocks, so a frequent
n-gram's rows are many tasks. Its blocks are cut by zones of set size: sets that
link are in the same zone or in neighbouring ones, so other blocks never meet.
No link between components is lost, and no cap applies anywhere.

Defined results: null or blank texts have an empty set and link with nothing;
texts of fewer words than ``n`` are one shingle; repeated rows link with each
other; a null doc_id is never the least of a component unless all are null;
empty tables give empty results; columns besides doc_id and text are ignored,
or passed on by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, fresh_name, scanned, small_batches, text_bytes, with_row_key, written
from .components import components
from .packing import units
from .shingles import sets

U = np.uint64
SKETCH_BITS = 22
PARTS = 64  # rows in which a fixed-size array is merged
BLOOM_BITS = 26
BLOOM_HASHES = 4
ZONE = 1 << 20  # numbers of blocks in a zone
FREQUENT_ROWS = 512  # prefix rows of an n-gram that is dealt out with salts, at least
BROADCAST_TOKENS = 100_000  # n-grams whose lists of blocks are broadcast
SALTS = 32
SLICE = 1 << 20  # text bytes that are hashed at a time, at 40 or so bytes of memory each


@dataclass(frozen=True)
class Rule:
    words: int = 5
    percent: int = 80
    block: int = 512  # rows of an n-gram that meet in one unit of work

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def zone(self, n: Column) -> Column:
        """The zone of set size; sets that link are at most one zone apart (a zone is a trifle wider than the ratio)."""
        return F.floor(F.log(n.cast("double")) / (math.log(100 / self.percent) * (1 + 1e-9))).cast("long") if self.percent < 100 else n

    def needed(self, total: np.ndarray) -> np.ndarray:
        """The least overlap of two sets with ``total`` members together."""
        return -(-self.percent * total // (100 + self.percent))


# ---- arrays of fixed size, merged over partitions


def _emit_parts(array: np.ndarray) -> pa.RecordBatch:
    zstd = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([zstd.compress(x.tobytes()) for x in np.split(array, PARTS)], pa.binary())], ["part", "body"])


def _merged(parts: DataFrame, kind: str, op: np.ufunc, then=lambda x: x) -> bytes:
    """The arrays of all partitions folded by ``op``, part by part on the executors; ``then`` shrinks each part."""

    def fold(table: pa.Table) -> pa.Table:
        un = zstandard.ZstdDecompressor()
        out = None
        for body in table.column("body").to_pylist():
            x = np.frombuffer(un.decompress(body), kind)
            out = x if out is None else op(out, x)
        return pa.table({"part": table.column("part")[:1], "body": pa.array([then(out).tobytes()], pa.binary())})

    rows = parts.groupBy("part").applyInArrow(fold, "part int, body binary").collect()
    return b"".join(r["body"] for r in sorted(rows, key=lambda r: r["part"]))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def ranks(docs: DataFrame, rule: Rule) -> np.ndarray:
    """The logarithmic frequency of n-grams by hash, over all documents; one byte each of 2^22."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.zeros(1 << SKETCH_BITS, np.uint32)
        held, size = [], 0
        for batch in batches(it, SLICE):
            for s in sets(text_bytes(batch), rule.words):
                held.append((s & U((1 << SKETCH_BITS) - 1)).astype(np.int32))
                size += len(s)
            if size > 2_000_000:
                array += np.bincount(np.concatenate(held), minlength=len(array)).astype(np.uint32)
                held, size = [], 0
        if size:
            array += np.bincount(np.concatenate(held), minlength=len(array)).astype(np.uint32)
        if array.any():
            yield _emit_parts(array)

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part int, body binary")
    body = _merged(parts, "u4", lambda a, b: np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32), lambda x: np.minimum(np.log2(x.astype(float) + 1) * 8, 255).astype(np.uint8))
    return np.frombuffer(body, np.uint8) if body else np.zeros(1 << SKETCH_BITS, np.uint8)


# ---- prefixes


def sketch(s: np.ndarray) -> bytes:
    """A set's sizes in 256 hash ranges, modulo 4, as two planes of bits (see ``distance``)."""
    sizes = np.bincount((s >> U(56)).astype(np.int64), minlength=256)
    return np.packbits(np.concatenate([sizes & 1, sizes >> 1 & 1]).astype(bool), bitorder="little").tobytes()


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the number of members that only one of two sets has, for sketches as rows of eight words:
    sizes that differ by d modulo 4 differ by 0, 1, 2 or 1 at least. Sets that nearly link differ by 0 or 1 in
    almost every range, where the bound is exact."""
    x = a ^ b
    odd = x[..., :4]
    return (np.bitwise_count(odd) + 2 * np.bitwise_count(x[..., 4:] & ~odd)).sum(axis=-1, dtype=np.int64)


PREFIXES = "file long, row long, doc_id long, d binary, n long, sketch binary, token long, d1 long, d2 long, size_place long"


def _prefix_rows(rule: Rule, shared):
    """Rows of two kinds: each document's, and (token, d1, d2, size_place) of each prefix n-gram; the latter are
    narrow, since they are many: a digest as two numbers, set size and place as one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(shared.value, np.uint8)
        seen: set[bytes] = set()
        names = [x.split()[0] for x in PREFIXES.split(", ")]
        kinds = [pa.binary() if "binary" in x else pa.int64() for x in PREFIXES.split(", ")]
        for batch in batches(it, SLICE):
            found = sets(text_bytes(batch), rule.words)
            nodes = [digest(s) for s in found]
            tokens, owner, places = [], [], []
            for i, (s, d) in enumerate(zip(found, nodes)):
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                order = np.argsort(rank[(s & U((1 << SKETCH_BITS) - 1)).astype(np.int64)], kind="stable")[: rule.prefix(len(s))]
                tokens.append(s[order])
                owner.append(np.full(len(order), i))
                places.append(np.arange(len(order)) | len(s) << 32)
            values = [*(batch.column(c) for c in ("file", "row", "doc_id")), pa.array(nodes, pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array([sketch(s) if len(s) else None for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*values, *(pa.nulls(len(found), k) for k in kinds[6:])], names)
            if tokens:
                d = np.frombuffer(b"".join(nodes), "<i8").reshape(-1, 2)[np.concatenate(owner)]
                token = np.concatenate(tokens).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(c)) for c in (token, d[:, 0], d[:, 1], np.concatenate(places))]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(token), k) for k in kinds[:6]), *columns], names)
            if len(seen) > 500_000:
                seen.clear()

    return run


def _frequent(tokens: DataFrame) -> DataFrame:
    """(token, salts) of frequent n-grams, told by a sample of rows; results don't depend on it. Those have more rows
    than an eighth of an even partition, so they are at most 32 times as many as partitions."""
    rows, parts = tokens.count(), int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = max(FREQUENT_ROWS, rows // (8 * parts))
    share = min(1.0, 128 / many)
    counted = tokens.sample(share, seed=3).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= many * share / 2)
    return written(counted.select("token", F.ceil(F.col("c") / (many * share) * 2).cast("long").alias("salts")), "frequent")


def _shared_tokens(rule: Rule):
    """Of rows sorted by (token, size_place, d1, d2), those whose token another node of a fitting size has too (a
    neighbour in this order, if any), and all of salted tokens, each node once per token. One row is held back
    between batches."""
    names = ["token", "d1", "d2", "size_place", "salted"]

    def numbered(rows, shared):
        keep = np.flatnonzero(shared)
        token, d1, d2, sp, _ = (c[keep] for c in rows)
        raw = np.ascontiguousarray(np.stack([d1, d2], axis=1).astype("<i8")).tobytes()
        d = pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(token), d, pa.array(sp >> 32), pa.array(sp & 0xFFFFFFFF)], ["token", "d", "n", "pos"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, fits = None, False  # the last distinct row, and whether its token is shared
        for batch in it:
            rows = [batch.column(c).to_numpy() for c in names]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows)]
            if not len(rows[0]):
                continue
            first, fresh = np.ones(len(rows[0]), bool), np.ones(len(rows[0]), bool)
            first[1:] = rows[0][1:] != rows[0][:-1]
            fresh[1:] = first[1:] | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            rows, first = [c[fresh] for c in rows], first[fresh]
            n = rows[3] >> 32
            pair = ~first[1:] & (100 * n[:-1] >= rule.percent * n[1:])
            shared = np.append(pair, False) | (rows[4] > 0)
            shared[1:] |= pair
            shared[0] |= fits
            yield numbered([c[:-1] for c in rows], shared[:-1])
            carry, fits = [c[-1:] for c in rows], bool(shared[-1])
        if carry is not None:
            yield numbered(carry, np.array([fits]))

    return run


def _with_tokens(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined by n-gram with a written table of one row each for frequent ones, which never deals rows out by the
    n-gram alone: the table is broadcast, or else rows meet it by a salt of their node."""
    if small.count() <= BROADCAST_TOKENS:
        return rows.join(F.broadcast(small), "token", how)
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(spread, ["token", "salt"], how).drop("salt")


# ---- candidates


def _bloom(nodes: DataFrame) -> bytes:
    """Bits of all nodes in a filter of fixed size; false positives only cost bandwidth."""

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in it:
            bits[_bloom_places(batch.column(0).to_pylist()).ravel()] = True
        if bits.any():
            yield _emit_parts(np.packbits(bits, bitorder="little"))

    return _merged(nodes.mapInArrow(mark, "part int, body binary"), "u1", np.bitwise_or)


def _bloom_places(names: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(names), "<u8").reshape(-1, 2)
    return np.stack([(x[:, 0] + U(i) * (x[:, 1] | U(1))) & U((1 << BLOOM_BITS) - 1) for i in range(BLOOM_HASHES)]).astype(np.int64)


def _candidate_texts(docs: DataFrame, rule: Rule, bloom) -> DataFrame:
    """(d, body): per candidate node its words, compressed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bloom.value, np.uint8)
        zstd = zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        for batch in batches(it, SLICE):
            texts = text_bytes(batch)
            found = sets(texts, rule.words)
            names = [digest(s) for s in found]
            p = _bloom_places(names)
            hit = (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).all(axis=0) if len(bits) else np.zeros(len(names), bool)
            rows = []
            for i in np.flatnonzero(hit).tolist():
                if len(found[i]) and names[i] not in seen:
                    seen.add(names[i])
                    rows.append((names[i], zstd.compress(b" ".join(texts[i].lower().split()))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["d", "body"])
            if len(seen) > 500_000:
                seen.clear()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "d binary, body binary")


def _pairs(n1, p1, s1, n2, p2, s2, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Which of rows 1 x rows 2 pass all filters, and the bounds of their distance."""
    total = n1[:, None] + n2[None, :]
    need = rule.needed(total)
    small, large = np.minimum(n1[:, None], n2[None, :]), np.maximum(n1[:, None], n2[None, :])
    ok = 100 * small >= rule.percent * large
    rest = np.minimum((n1 - p1)[:, None], (n2 - p2)[None, :])  # the n-gram itself and what follows
    ok &= np.minimum(p1[:, None], p2[None, :]) + rest >= need
    far = np.full(ok.shape, FAR, np.int64)
    i, j = np.nonzero(ok)
    for a in range(0, len(i), 1 << 16):
        x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        far[x, y] = distance(s1[x], s2[y])
    return ok & (far <= total - 2 * need), far


def _columns(t: pa.Table):
    sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(-1, 8)
    return t.column("d").to_pylist(), t.column("n").to_numpy(), t.column("pos").to_numpy(), sketches


def _emit(pairs: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


EMIT = 50_000


FAR = 2**30


def _spanning(far: np.ndarray, some: np.ndarray) -> Iterator[tuple[int, int]]:
    """A minimum spanning forest of the pairs that pass (the others are FAR apart): pairs with the least bounds are
    the likeliest to link, and no more are needed while they do."""
    left = some.copy()
    best, by = np.full(len(far), FAR, np.int64), np.zeros(len(far), np.int64)
    while left.any():
        u = int(np.argmin(np.where(left, best, FAR + 1)))
        left[u] = False
        if best[u] < FAR:
            yield u, int(by[u])
        nearer = far[u] < best
        best[nearer], by[nearer] = far[u][nearer], u


OPEN = "a binary, b binary, token long, block long, n long, pos long"


def _nearest(rule: Rule):
    """Per unit, the pairs (a, b) of a forest over the nearest pairs; and the rows (a, null, token, ...) that may
    have partners: those that pass with one in their unit, and all of n-grams with more units."""

    def rows(t: pa.Table, keep: np.ndarray) -> pa.RecordBatch:
        t = t.take(pa.array(np.flatnonzero(keep))).combine_chunks()
        columns = [t.column(c).combine_chunks() for c in ("d", "token", "block", "n", "pos")]
        return pa.RecordBatch.from_arrays([columns[0], pa.nulls(t.num_rows, pa.binary()), *columns[1:]], [x.split()[0] for x in OPEN.split(", ")])

    def pairs(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
        b = _emit(found)
        nulls = [pa.nulls(len(found), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*b.columns, *nulls], [x.split()[0] for x in OPEN.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[bytes, bytes]] = set()
        held: list[pa.RecordBatch] = []
        for t in units(it, ["token", "block"]):
            many = t.column("many")[0].as_py()
            if t.num_rows < 2 and not many:
                continue
            d, n, p, s = _columns(t)
            ok, far = _pairs(n, p, s, n, p, s, rule)
            np.fill_diagonal(ok, False)
            far[~ok] = FAR
            some = ok.any(axis=1)
            for i, j in _spanning(far, some):
                out.add((d[i], d[j]) if d[i] < d[j] else (d[j], d[i]))
            if many or some.any():
                held.append(rows(t, some | many))
            if len(held) > 500:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
            if len(out) > EMIT:
                yield pairs(out)
                out = set()
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
        yield pairs(out)

    return run


def _between(rule: Rule):
    """Per unit of two blocks of an n-gram, all pairs between different components."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[bytes, bytes]] = set()
        for t in units(it, ["token", "i", "j"]):
            block = t.column("block").to_numpy()
            left, right = np.flatnonzero(block == t.column("i")[0].as_py()), np.flatnonzero(block == t.column("j")[0].as_py())
            d, n, p, s = _columns(t)
            root = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)[1]
            ok, _ = _pairs(n[left], p[left], s[left], n[right], p[right], s[right], rule)
            ok &= root[left][:, None] != root[right][None, :]
            for i, j in zip(*np.nonzero(ok)):
                x, y = d[left[i]], d[right[j]]
                out.add((x, y) if x < y else (y, x))
                if len(out) > EMIT:
                    yield _emit(out)
                    out = set()
        yield _emit(out)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link, each verified once; both texts come to the pair."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un = zstandard.ZstdDecompressor()
        known: dict[bytes, np.ndarray] = {}
        for batch in batches(it, SLICE // 4, "y"):
            new: dict[bytes, bytes] = {}
            for k, v in (("a", "x"), ("b", "y")):
                new |= {d: body for d, body in zip(batch.column(k).to_pylist(), batch.column(v).to_pylist()) if d not in known}
            found = sets([un.decompress(b) for b in new.values()], rule.words)
            here = known | dict(zip(new, found))
            out = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = here[a], here[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= rule.percent * (len(x) + len(y) - both):
                    out.append((a, b))
            known = {a: here[a] for a in batch.column("a").to_pylist()[-1:]}
            yield _emit(set(out))

    t = texts.select("d", "body")
    both = pairs.join(t.withColumnsRenamed({"d": "a", "body": "x"}), "a").join(t.withColumnsRenamed({"d": "b", "body": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


@dataclass
class Joined:
    """``links``: verified pairs of nodes, enough of them for every component; ``documents``: file, row, doc_id,
    node (d) and set size (n) of every document; ``roots``: (node, root) of all nodes with a link."""

    links: DataFrame
    documents: DataFrame
    roots: DataFrame


def join(docs: DataFrame, rule: Rule = Rule()) -> Joined:
    spark = docs.sparkSession
    small_batches(spark)
    docs = scanned(docs)
    # units of work are few bytes and much time, so their partitions are numbered, which adaptive execution leaves alone
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = spark.sparkContext.broadcast(ranks(docs, rule).tobytes())
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "file", "row")
    found = written(keyed.mapInArrow(_prefix_rows(rule, rank), PREFIXES), "prefixes")
    documents = found.where("file is not null").select("file", "row", "doc_id", "d", "n")
    tokens = found.where("file is null").select("token", "d1", "d2", "size_place")
    frequent = _frequent(tokens)
    salted = tokens.join(F.broadcast(frequent), "token", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("d1", "d2"), "salts"), F.lit(0)))
    dealt = salted.select("token", "d1", "d2", "size_place", F.col("salts").isNotNull().cast("long").alias("salted"), "salt").repartition("token", "salt").sortWithinPartitions("token", "size_place", "d1", "d2")
    shared = written(dealt.mapInArrow(_shared_tokens(rule), "token long, d binary, n long, pos long"), "shared")
    sketches = found.where("file is not null and n > 0").select("d", "sketch").groupBy("d").agg(F.first("sketch").alias("sketch"))
    # an n-gram with more rows than a block has blocks by zone; within a zone rows are dealt out by hash: nodes fall
    # into other blocks for each n-gram they share, so the forests of blocks grow together
    zone = rule.zone(F.col("n"))
    zones = shared.groupBy("token", zone.alias("zone")).agg(F.count("*").alias("c"))
    zones = zones.groupBy("token").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("zone", F.ceil(F.col("c") / rule.block).cast("long").alias("many")))).alias("zones"))
    blocks = written(zones.where(F.col("c") > rule.block).select("token", "zones"), "blocks")
    own = zone * ZONE + F.pmod(F.xxhash64("token", "d"), F.col("zones")[zone])
    mixed = _with_tokens(shared, blocks, "left").withColumn("block", F.coalesce(own, F.lit(0)))
    dealt = mixed.join(sketches, "d").select("token", "block", "d", "n", "pos", "sketch", F.col("zones").isNotNull().alias("many")).repartition(parts, "token", "block").sortWithinPartitions("token", "block")
    near = written(dealt.mapInArrow(_nearest(rule), OPEN), "near")
    discard(frequent, shared)

    first = near.where("token is null").select("a", "b").distinct()
    drawn = near.where("token is not null").select("token", "block", F.col("a").alias("d"), "n", "pos")
    nodes = drawn.select("d").distinct()  # every node of a pair has a row that passed
    bloom = spark.sparkContext.broadcast(_bloom(nodes))
    texts = _candidate_texts(docs, rule, bloom).join(nodes, "d", "left_semi").groupBy("d").agg(F.first("body").alias("body"))
    texts = written(texts, "texts")
    links = written(_verified(first, texts, rule), "links")
    roots = written(components(links), "roots")

    labelled = drawn.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    labelled = written(labelled, "labelled")
    columns = ["token", "i", "j", "block", "d", "n", "pos", "root"]
    # n-grams of one block, at most rule.block rows: those in several components
    few = _with_tokens(labelled, blocks.select("token"), "left_anti")
    several = few.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    few = few.join(several, "token").withColumns({"i": F.col("block"), "j": F.col("block")}).select(*columns)
    # n-grams of many blocks: rows outside the largest component meet all others of fitting zones
    many = _with_tokens(labelled, blocks)
    counted = many.groupBy("token", "root").agg(F.count("*").alias("c"))
    mains = counted.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("token", "main")
    mains = written(mains, "mains")
    outside = _with_tokens(many, mains).where("root != main").groupBy("token").agg(F.collect_set("block").alias("outside"))
    outside = written(outside, "outside")
    open_ = _with_tokens(many, outside)
    at = F.floor(F.col("block") / ZONE)
    fitting = F.flatten(F.transform(F.array(at - 1, at, at + 1), lambda z: F.coalesce(F.transform(F.sequence(F.lit(0).cast("long"), F.col("zones")[z] - 1), lambda x: z * ZONE + x), F.array().cast("array<bigint>"))))
    partner = F.explode(F.when(F.array_contains("outside", F.col("block")), fitting).otherwise(F.array_intersect(fitting, "outside")))
    open_ = open_.withColumn("with", partner).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).select(*columns)
    pairs = few.union(open_).join(sketches, "d").select(*columns, "sketch").repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    more = pairs.mapInArrow(_between(rule), "a binary, b binary").distinct().join(first, ["a", "b"], "left_anti")
    more = written(_verified(more, texts, rule), "links")
    discard(near, labelled, blocks, mains, outside, texts)
    links = links.union(more)
    roots = written(components(links), "roots")
    return Joined(links, documents, roots)


def label(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    joined = join(docs, rule)
    nodes = joined.documents.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(joined.roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("d", "component_id")
    out = joined.documents.join(named, "d", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` without those of which another row of their component has a smaller doc_id (of equal
    ids: an earlier row); all rows without words stay."""
    docs = scanned(docs)
    joined = join(docs, rule)
    file, row = fresh_name(docs, "file_key"), fresh_name(docs, "row_key")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "file", "row")
    nodes = joined.documents.where("n > 0").groupBy("d").agg(F.min(rank).alias("r"))
    nodes = nodes.join(joined.roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    first = nodes.groupBy("root").agg(F.min("r").alias("r")).select("r.file", "r.row")
    stay = first.union(joined.documents.where("n = 0").select("file", "row")).withColumnsRenamed({"file": file, "row": row})
    return with_row_key(docs, file, row).join(stay, [file, row], "left_semi").drop(file, row)
