"""Removal of long repeated byte strings with a sparse, distributed suffix array.

A byte goes if it lies in a ``length``-byte string (a window) that also starts
anywhere else. Sorting every suffix would move hundreds of times the input, so
only suffixes at anchors are sorted. The anchor of a window is the position in
it whose ``lead``-byte string has the least hash (the last of equals): equal
windows have equal anchors at equal offsets, and neighbouring windows mostly
share theirs. The windows of one anchor form a stretch, some 1.5 times
``length`` bytes.

1. Suffixes at anchors are keyed by their leading tokens and the digest of
   their stretch. Sampled splitters of these keys cut the key space into ranges;
   each bucket sorts its suffixes by multikey quicksort. Splitters may fall
   inside a group of equal keys, so a passage that a third of all documents
   share is spread over buckets; each bucket reports its first and last key, and
   groups cut by a boundary are judged with what stands across it.
2. Stretches that occur twice repeat in all their windows. A suffix whose
   leading tokens repeat while its stretch doesn't is contested: some windows
   may repeat. Contested stretches, and one of each repeated stretch with the
   same leading tokens, meet and are compared window by window; if there are
   many (the edges of a shared passage), or a boundary cuts the group, by
   digests of windows, dealt out evenly and packed, what repeats within a task
   being folded first. Both ways give the same windows. Each bucket judges and
   counts its own groups, so no step deals rows out by a passage.
3. The windows found are merged into spans per document.

What is compared are texts, or codes of CODE bytes for their words: passages of
51 words that start anywhere else are found in the same way, whatever their
bytes. Windows at other places than a code's beginning say nothing more: they
hold 50 words and as many bytes as a code, cut from two others.

The number of buckets follows the number of suffixes, which the sample
estimates, and the sample grows with the number of buckets.

Defined results: a null text has no bytes; texts under ``length`` bytes have no
window; repeated rows repeat each other's windows; empty tables give empty
results; other columns pass through ``remove``, whose texts lose the bytes of
characters that a span cut through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, batches, discard, fresh_name, scanned, small_batches, text_bytes, with_row_key, written
from .mixing import mixed64
from .packing import narrow, pack, runs, units, unpack
from .shingles import _power, word_hashes

U = np.uint64
PLACE = U((1 << 24) - 1)
SLICE = 1 << 20  # bytes whose hashes are in memory at a time
SAMPLE_DOCS = 3000  # documents, about, that splitters are drawn from, if there are few buckets
SAMPLE = 65536  # keys of theirs, at most, or SAMPLE_KEYS for each bucket if these are more
SAMPLE_KEYS = 16
BUCKET_ROWS = 1_000_000  # suffixes of a bucket, about, at 60 bytes each
CROWD = 256  # stretches with the same leading tokens that are compared in one place
BROADCAST_CUTS = 100_000  # groups that boundaries cut, at 16 to 32 bytes each, that are broadcast
CODE = 4  # bytes of a word's code
BLANK = re.compile(b"[" + WHITE + b"]")


@dataclass(frozen=True)
class Rule:
    """Bytes of a window and of its leading strings, in texts or in the codes of their words."""

    length: int = 400
    lead: int = 64
    words: bool = False

    def read(self, batch: pa.RecordBatch) -> list[bytes]:
        """What is compared."""
        texts = text_bytes(batch)
        return word_codes(texts) if self.words else texts


PASSAGES = Rule(51 * CODE, 16 * CODE, True)


def word_codes(texts: list[bytes]) -> list[bytes]:
    """Per text the codes of its words (A-Z as a-z), one after another; SLICE bytes, about, are hashed at a time."""
    out = [b""] * len(texts)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        h, counts = word_hashes([t for _, t in held])
        raw, at = (h >> U(32)).astype("<u4").tobytes(), 0
        for (i, _), n in zip(held, (counts * CODE).tolist()):
            out[i] += raw[at : at + n]
            at += n
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        begin = 0
        while begin < len(t):
            cut = BLANK.search(t, begin + SLICE) if len(t) > begin + SLICE else None
            end = cut.start() if cut else len(t)
            if size and size + end - begin > SLICE:
                flush()
                size = 0
            held.append((i, t[begin:end]))
            size += end - begin
            begin = end
    flush()
    return out


def anchors(buf: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of ``buf`` (by its start), and the hash of every position's leading bytes."""
    n, up_down = len(buf), _power(len(buf) + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up_down[0][:n], out=sums[1:])
    h = mixed64((sums[rule.lead :] - sums[: -rule.lead]) * up_down[1][: n - rule.lead + 1])
    key = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=U))
    w = rule.length - rule.lead + 1
    padded = np.full(-(-len(key) // w) * w, 2**64 - 1, U)
    padded[: len(key)] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - rule.length + 1
    return (PLACE - (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & PLACE)).astype(np.int64), h


def stretches(texts: list[bytes], rule: Rule) -> tuple[np.ndarray, ...]:
    """Of all windows with one anchor: text number, first window, number of windows, first 8 bytes of the suffix,
    hash of its leading bytes, two halves of the stretch's digest."""
    out = []
    for group in _sliced(texts, rule):
        raw = b"".join(t for _, _, t in group)
        buf = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for _, _, t in group])
        begins = np.cumsum(sizes) - sizes
        at, h = anchors(buf, rule)
        valid = np.zeros(len(at) + 1, bool)
        for b, n in zip(begins.tolist(), sizes.tolist()):
            valid[b : b + n - rule.length + 1] = True
        valid = valid[:-1]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        closing = valid.copy()
        closing[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        last = np.flatnonzero(closing)
        which = np.searchsorted(begins, first, side="right") - 1
        a = at[first]
        tokens = np.ascontiguousarray(buf[a[:, None] + np.arange(8)]).view(">u8").ravel().astype(U)
        x = xxhash.xxh3_128_digest
        digests = np.frombuffer(b"".join([x(raw[i:j]) for i, j in zip(first.tolist(), (last + rule.length).tolist())]), ">u8").astype(U).reshape(-1, 2)
        text = np.array([i for i, _, _ in group])[which]
        shift = np.array([s for _, s, _ in group])[which] - begins[which]
        out.append((text, first + shift, last - first + 1, tokens, h[a], digests[:, 0], digests[:, 1]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 4
    return tuple(np.concatenate(c) for c in zip(*out))


def _sliced(texts: list[bytes], rule: Rule) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset, bytes) in groups of about SLICE bytes; longer texts in pieces that share the bytes
    of windows across their ends. Texts without a window are left out."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - rule.length + 1), SLICE):
            part = t[s : s + SLICE + rule.length - 1] if len(t) > SLICE else t
            if len(part) < rule.length:
                continue
            if size and size + len(part) > SLICE:
                yield group
                group, size = [], 0
            group.append((i, s, part))
            size += len(part)
    if group:
        yield group


def multikey_sort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns of tokens: three-way partitioning all groups at once, token after token; rows
    told apart by the tokens so far take no further part."""
    n = len(columns[0])
    order, group, todo = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for c in columns:
        rows = order[todo]
        by = np.lexsort((c[rows], group[todo]))
        rows = rows[by]
        order[todo] = rows
        new = np.ones(len(todo), bool)
        new[1:] = (group[todo][1:] != group[todo][:-1]) | (c[rows][1:] != c[rows][:-1])
        group[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        alone = new.copy()
        alone[:-1] &= new[1:]
        todo = todo[~alone]
        if not len(todo):
            break
    return order


NAMES = ["t0", "lead", "d1", "d2", "file", "row", "first", "windows"]
KEYED = "t0 long, lead long, d1 long, d2 long, file long, row long, first long, windows int"


def _keys(t0: np.ndarray, lead: np.ndarray, d1: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Comparable keys, as byte strings."""
    return np.ascontiguousarray(np.stack([t0, lead, d1, tie], axis=1).astype(">u8")).view("S32").ravel()


def _tie(file: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed64(mixed64(file.view(U) + row.view(U)) + first.view(U))


def _suffixes(rule: Rule, splitters):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            text, first, windows, t0, lead, d1, d2 = stretches(rule.read(batch), rule)
            file, row = (batch.column(c).to_numpy()[text] for c in ("file", "row"))
            cuts = splitters.value if splitters is not None else None
            bucket = np.searchsorted(cuts, _keys(t0, lead, d1, _tie(file, row, first))) if cuts is not None and len(cuts) else np.zeros(len(first), np.int64)
            columns = [*(x.view(np.int64) for x in (t0, lead, d1, d2)), file, row, first.astype(np.int64), windows.astype(np.int32), bucket.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*NAMES, "bucket"])

    return run


ALONE, CONTESTED, REPEATED = 0, 1, 2
JUDGED = KEYED + ", bucket int, status int, meets boolean, crowd boolean"


def _judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's suffixes that repeat, are contested, or may be so across its boundaries (its first or last leading
    tokens); and its first and last key (windows 0). ``meets``: the suffix is compared window by window if
    contested, or if it is the first of a repeated stretch; ``crowd``: so are many with its leading tokens."""
    for t in units(it, ["bucket"]):
        order = multikey_sort([t.column(c).to_numpy().view(U) for c in NAMES[:4]])
        t = t.take(pa.array(order))
        t0, lead, d1, d2 = (t.column(c).to_numpy() for c in NAMES[:4])
        new_lead = np.ones(len(t0), bool)
        new_lead[1:] = (t0[1:] != t0[:-1]) | (lead[1:] != lead[:-1])
        new = new_lead.copy()
        new[1:] |= (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        g, of = np.cumsum(new_lead) - 1, np.cumsum(new) - 1
        copies = np.bincount(of)[of]
        kinds = np.bincount(g, weights=new)[g]  # different stretches with these leading tokens
        contested = (kinds > 1) & (copies == 1)
        status = np.where(copies > 1, REPEATED, np.where(contested, CONTESTED, ALONE))
        edge = (g == 0) | (g == g[-1])
        meets = contested | new & (np.bincount(g, weights=contested)[g] > 0)
        crowd = kinds > CROWD
        for name, c in (("status", status.astype(np.int32)), ("meets", meets | new & edge), ("crowd", crowd)):
            t = t.append_column(name, pa.array(c))
        kept = t.filter(pa.array((status != ALONE) | edge))
        ends = t.take(pa.array([0, len(t0) - 1])).set_column(7, "windows", pa.array([0, 0], pa.int32())).set_column(9, "status", pa.array([0, 1], pa.int32()))
        yield from pa.concat_tables([kept, ends]).combine_chunks().to_batches()


def _splitters(keyed: DataFrame, rule: Rule, least: int) -> tuple[np.ndarray, int]:
    """Keys that cut the suffixes of a sample of documents evenly, and the number of buckets that they make:
    ``least``, or as many as hold BUCKET_ROWS each."""
    def drawn(share: float) -> tuple[DataFrame, int]:
        sample = keyed.sample(share, seed=11).mapInArrow(_suffixes(rule, None), KEYED + ", bucket int").select("t0", "lead", "d1", "file", "row", "first")
        return (kept := written(sample, "sample")), kept.count()

    share = min(1.0, SAMPLE_DOCS / max(1, keyed.count()))
    sample, found = drawn(share)
    n = max(least, int(found / share / BUCKET_ROWS))
    if share < 1 and found < SAMPLE_KEYS * n:  # too few keys for so many buckets
        discard(sample)
        sample, found = drawn(min(1.0, share * 1.5 * SAMPLE_KEYS * n / max(1, found)))
    rows = sample.orderBy(F.xxhash64("file", "row", "first")).limit(max(SAMPLE, SAMPLE_KEYS * n)).toPandas()
    discard(sample)
    if not len(rows):
        return np.zeros(0, "S32"), n
    t0, lead, d1, file, row, first = (rows[c].to_numpy(np.int64) for c in rows.columns)
    keys = np.sort(_keys(t0.view(U), lead.view(U), d1.view(U), _tie(file, row, first)))
    return keys[np.linspace(0, len(keys), n + 1).astype(int)[1:-1]], n


def _compared(rule: Rule):
    """Of stretches with the same leading tokens, the windows that two have, as spans."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = xxhash.xxh3_128_digest
        for t in units(it, ["t0", "lead"]):
            seen: dict[bytes, tuple[int, int]] = {}
            bodies, counts = t.column("body").to_pylist(), t.column("windows").to_pylist()
            hit = [np.zeros(n, bool) for n in counts]
            for i, (body, n) in enumerate(zip(bodies, counts)):
                for j in range(n):
                    k, w = seen.setdefault(x(body[j : j + rule.length]), (i, j))
                    if (k, w) != (i, j):
                        hit[k][w] = hit[i][j] = True
            if any(h.any() for h in hit):
                yield _spans(t, hit, rule)

    return run


def _spans(t: pa.Table, hit: list[np.ndarray], rule: Rule) -> pa.RecordBatch:
    rows = []
    for file, row, first, h in zip(t.column("file").to_pylist(), t.column("row").to_pylist(), t.column("first").to_pylist(), hit):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], h, [False]])))
        rows += [(file, row, first + a, first + b - 1 + rule.length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["file", "row", "begin", "end"])


PACKED = "kind int, bucket int, body binary"
FIRST, MARKED = 0, 1


def _dealt(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of numbers as one packed row per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, starts = bucket[order], runs(bucket[order])
    rows = [(kind, int(bucket[a]), pack(*(narrow(c[order[a:b]]) if c.dtype.kind in "ib" and c.min() >= 0 else c[order[a:b]] for c in columns))) for a, b in zip(starts, np.append(starts[1:], len(order)))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["kind", "bucket", "body"])


def _of_row(file: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return (mixed64(file.view(U) + row.view(U)) % U(n)).astype(np.int64)


def _windows(rule: Rule, n: int):
    """Windows of crowded stretches by digest, packed. What repeats within a task is marked at once, and only the
    first of each digest goes on, so a window that very many documents have is one row per task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = xxhash.xxh3_128_digest
        held, size = [], 0

        def flush():
            d1, d2, file, row, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((d2, d1))
            new = np.ones(len(order), bool)
            new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(order))) > 1
            marked = order[np.repeat(many, np.diff(np.append(first, len(order))))]
            if len(marked):
                yield from _dealt(MARKED, _of_row(file[marked], row[marked], n), [file[marked], row[marked], place[marked]])
            one = order[first]
            yield from _dealt(FIRST, (d1[one].view(U) % U(n)).astype(np.int64), [d1[one], d2[one], file[one], row[one], place[one], many])

        for batch in batches(it, 1 << 18, "body"):
            counts = np.array(batch.column("windows").to_pylist(), np.int64)
            d = np.frombuffer(b"".join(x(b[j : j + rule.length]) for b, n_ in zip(batch.column("body").to_pylist(), counts.tolist()) for j in range(n_)), "<i8").reshape(-1, 2)
            of = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + batch.column("first").to_numpy()[of]
            held.append((np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), *(batch.column(c).to_numpy()[of] for c in ("file", "row")), place))
            size += len(of)
            if size > 400_000:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _repeated(n: int):
    """Of the firsts of all tasks, those that another task has too."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(it, ["bucket"]):
            d1, d2, file, row, place, many = (np.concatenate(c) for c in zip(*map(unpack, t.column("body").to_pylist())))
            order = np.lexsort((d2, d1))
            new = np.ones(len(order), bool)
            new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            hit = order[np.repeat(size > 1, size) & (many[order] == 0)]
            if len(hit):
                file, row = file[hit].astype(np.int64), row[hit].astype(np.int64)
                yield from _dealt(MARKED, _of_row(file, row, n), [file, row, place[hit].astype(np.int64)])

    return run


def _joined_windows(rule: Rule):
    """Marked windows of a bucket of documents, as spans of neighbouring ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(it, ["bucket"]):
            file, row, place = (np.concatenate(c).astype(np.int64) for c in zip(*map(unpack, t.column("body").to_pylist())))
            order = np.lexsort((place, row, file))
            file, row, place = file[order], row[order], place[order]
            new = np.ones(len(order), bool)
            new[1:] = (file[1:] != file[:-1]) | (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(order)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (file[first], row[first], place[first], place[last] + rule.length)], ["file", "row", "begin", "end"])

    return run


def _cut_stretches(rule: Rule):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            of, parts, bodies = [], [], []
            for i, (text, wanted) in enumerate(zip(rule.read(batch), batch.column("wanted").to_pylist())):
                for p in wanted:
                    of.append(i)
                    parts.append(p)
                    bodies.append(text[p["first"] : p["first"] + p["windows"] - 1 + rule.length])
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("file", "row")), *(pa.array([p[k] for p in parts], kind) for k, kind in (("t0", pa.int64()), ("lead", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("crowd", pa.bool_()))), pa.array(bodies, pa.binary())], ["file", "row", "t0", "lead", "first", "windows", "crowd", "body"])

    return run


def spans(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(file, row, begin, end): byte ranges (of codes, if the rule compares words) that hold repeated windows; they may
    overlap. ``docs`` is a scan."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = with_row_key(docs.select(F.col("text").cast("string").alias("text")), "file", "row")
    cuts, n = _splitters(keyed, rule, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = spark.sparkContext.broadcast(cuts)
    suffixes = keyed.mapInArrow(_suffixes(rule, splitters), KEYED + ", bucket int")
    judged = written(suffixes.repartitionById(n, F.col("bucket")).mapInArrow(_judged, JUDGED), "judged")

    # the ends of the buckets, two rows each, tell which groups a boundary cuts
    ends = judged.where("windows = 0").orderBy("bucket", "status").select("bucket", "t0", "lead", "d1", "d2").collect()
    cut_leads, cut_digests = set(), set()
    for a, b in zip(ends[1:-1:2], ends[2::2]):
        if a[1:3] == b[1:3]:
            cut_leads.add(tuple(a[1:3]))
            if a[3:] == b[3:]:
                cut_digests.add(tuple(a[1:]))
    small = F.broadcast if len(cut_leads) <= BROADCAST_CUTS else lambda x: x
    leads = small(spark.createDataFrame([(*x, True) for x in cut_leads], "t0 long, lead long, over boolean"))
    digests = small(spark.createDataFrame([(*x, True) for x in cut_digests], "t0 long, lead long, d1 long, d2 long, same boolean"))
    # one row of these, at most, for each; other leading tokens than those at the edges of buckets aren't among them
    found = judged.where("windows > 0").join(leads, ["t0", "lead"], "left").join(digests, ["t0", "lead", "d1", "d2"], "left")
    status = F.when(F.col("same"), REPEATED).otherwise(F.when(F.col("over"), F.greatest("status", F.lit(CONTESTED))).otherwise(F.col("status")))
    found = found.select(*NAMES, status.alias("status"), "meets", (F.col("crowd") | F.coalesce("over", F.lit(False))).alias("crowd")).where(F.col("status") != ALONE)

    whole = found.where(F.col("status") == REPEATED).select("file", "row", F.col("first").alias("begin"), (F.col("first") + F.col("windows") - 1 + rule.length).alias("end"))
    # contested stretches, and one of each repeated stretch (and bucket) beside them
    both = found.where((F.col("status") == CONTESTED) | F.col("meets"))
    wanted = both.groupBy("file", "row").agg(F.collect_list(F.struct("t0", "lead", "first", "windows", "crowd")).alias("wanted"))
    bodies = written(keyed.join(wanted, ["file", "row"]).mapInArrow(_cut_stretches(rule), "file long, row long, t0 long, lead long, first long, windows int, crowd boolean, body binary"), "stretches")
    few = bodies.where("not crowd").drop("crowd").repartition("t0", "lead").sortWithinPartitions("t0", "lead").mapInArrow(_compared(rule), "file long, row long, begin long, end long")
    packed = written(bodies.where("crowd").mapInArrow(_windows(rule, n), PACKED), "windows")
    elsewhere = packed.where(F.col("kind") == FIRST).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_repeated(n), PACKED)
    marks = packed.where(F.col("kind") == MARKED).union(elsewhere)
    many = marks.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_joined_windows(rule), "file long, row long, begin long, end long")
    return whole.union(few).union(many)


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Disjoint, maximal ranges in order; touching ones are one."""
    out: list[list[int]] = []
    for b, e in sorted((r["begin"], r["end"]) for r in ranges or ()):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _kept(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in cut for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_ranges(docs: DataFrame, rules: dict[str, Rule], file: str, row: str) -> DataFrame:
    """``docs`` with the ranges of each rule in the column that it is named for."""
    found = reduce(DataFrame.union, (spans(docs, rule).withColumn("by", F.lit(name)) for name, rule in rules.items()))
    per_row = found.groupBy("file", "row").agg(*(F.collect_list(F.when(F.col("by") == name, F.struct("begin", "end"))).alias(name) for name in rules)).withColumnsRenamed({"file": file, "row": row})
    return with_row_key(docs, file, row).join(per_row, [file, row], "left").drop(file, row)


def _words(ranges: list[dict]) -> int:
    """Words whose codes lie in ranges; codes that a range cuts through are not in it."""
    return sum(e - b for b, e in merged([{"begin": -(-r["begin"] // CODE), "end": r["end"] // CODE} for r in ranges or ()]))


def summary(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans, and n_passage_words: its words
    in strings of 51 words that also start anywhere else, removed or not."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>, n_passage_words long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = []
            for text, r, p in zip(text_bytes(batch), batch.column("ranges").to_pylist(), batch.column("passages").to_pylist()):
                cut = merged(r)
                rows.append((len(text), sum(e - b for b, e in cut), len(cut), hashlib.sha256(_kept(text, cut)).hexdigest(), [{"begin": b, "end": e} for b, e in cut], _words(p)))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_words"])

    slim = scanned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_ranges(slim, {"ranges": rule, "passages": PASSAGES}, "file", "row").mapInArrow(run, schema)


def remove(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with repeated windows cut from ``text``; the rule compares texts."""
    if rule.words:
        raise ValueError("ranges of words' codes can't be cut from texts")
    docs = scanned(docs)
    file, row, ranges = (fresh_name(docs, x) for x in ("file_key", "row_key", "ranges"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            texts = [_kept(t, merged(r)).decode("utf-8", "ignore") for t, r in zip(text_bytes(batch), batch.column(ranges).to_pylist())]
            none = batch.column("text").is_null().to_pylist()
            batch = batch.drop_columns([ranges])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([None if z else t for z, t in zip(none, texts)], pa.string()))

    return _with_ranges(docs, {ranges: rule}, file, row).mapInArrow(run, docs.schema)
