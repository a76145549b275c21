"""Token ids as binary shards with a minimal perfect hash index.

A store is a folder of shards in ascending doc_id order. ``shard-N.bin`` holds
raw ids, little-endian, 2 bytes each if the vocabulary allows, else 4. Its
``shard-N.idx`` holds, little-endian: the 8-byte magic, then n_docs, n_keys,
n_tokens, id width, n_null (documents without an id, at the end), n_levels, and
per level its number of 64-bit words, as int64; the hash levels' words; per
level word the keys before it (int64); fingerprints (uint32), first document
and number of documents (uint32 each) per key; n_docs + 1 offsets in ids
(int64). ``shard-N.key`` lists the documents' ids in order (int64), for going
through a whole shard; lookups don't read it.

The index is a minimal perfect hash of the shard's keys: at each level keys hash
to bits, a key alone on its bit is settled, others go on to the next level; the
rank of its bit numbers the key. A lookup hashes, tests bits, counts one rank
and compares the stored fingerprint, reading a few numbers at computed places of
the file: constant time (two levels on average), no search, and no keys. An id
that isn't there is found with a chance of 2^-32, the fingerprint's.

Documents are encoded where they are, and their ids, a fraction of the text, go
to ranges of doc_id; each sorts its own and writes its shards under a name of
the attempt and moves them; a retried task just writes them again. A sample of
documents (the rows of SAMPLE_ROWS, or SAMPLE_KEYS for each range) cuts the
ranges; nothing else depends on it. Paths go through Arrow's file systems, so a
store can lie wherever those reach.

Defined results: null text is empty (its ids are the end id alone); documents
without an id come last; rows with one id repeated follow each other (ordered by
text hash) and are all found under it; bytes that are no UTF-8 are encoded as
replacement characters; empty tables give a store without shards.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh_path, small_batches, text_bytes, written
from .mixing import mixed64

MAGIC = b"PLIDX01\0"
U = np.uint64
CACHE_WORDS = 600_000
SHARD_BYTES = 64 << 20
READ_BYTES = 4 << 20
RANGE_BYTES = 16 << 20  # text of a range of documents
SAMPLE_ROWS = 20_000  # documents that the ranges are cut by, or SAMPLE_KEYS for each range if these are more
SAMPLE_KEYS = 20


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


# ---- encoding


def separable(config: dict) -> bool:
    """Whether a tokenizer encodes white-space separated words independently of each other, so that their ids
    can be joined: no normaliser looks across blanks, no added token holds or eats them, and the pattern that
    picks pre-tokens drops white space."""
    steps = config.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    ok = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"].get("Regex") == r"\s+" and s["content"] == " ") for s in steps)
    ok &= not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"] != "".join(a["content"].split()) for a in config.get("added_tokens", []))
    pre = config.get("pre_tokenizer") or {}
    pre = pre["pretokenizers"][0] if pre.get("type") == "Sequence" else pre
    picks = pre.get("type") == "Split" and pre["behavior"] == "Removed" and pre["invert"]
    parts = pre["pattern"].get("Regex", " ").split("|") if picks else [" "]
    return ok and all(p.startswith("'") or p in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") for p in parts) and config.get("post_processor") is None


#: Words of these letters, and what may follow them: normalisation only lower-cases them, and they and the run
#: of marks are one pre-token each.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#|$()]*)")


def byte_level(config: dict) -> bool:
    """Whether pre-tokens go to a merge model as bytes written as characters, nothing added."""
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return len(steps) == 2 and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": steps[1].get("trim_offsets"), "use_regex": False} and config["model"]["type"] == "BPE" and any(n["type"] == "Lowercase" for n in config["normalizer"]["normalizers"])


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else 256 and up."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in kept else next(rest) for b in range(256)}


class Encoder:
    """Texts to packed ids; distinct words are encoded once where the tokenizer allows, and plain ones go
    straight to its merge model."""

    def __init__(self, path: str, width: int | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.by_word = separable(config)
        self.direct = self.by_word and byte_level(config)
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.width = width or (2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4)
        self.kind, self.form = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.cache: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def word(self, core: str, marks: str) -> bytes:
        """Packed ids of a plain word."""
        if marks not in self.marks:
            self.marks[marks] = self.packed([marks.encode()])[0]
        text = core.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.characters)
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}{self.form}", *ids) + self.marks[marks]

    def new(self, words: list[bytes]) -> dict[bytes, bytes]:
        if not self.direct:
            return dict(zip(words, self.packed(words)))
        out, rest = {}, []
        for w in words:
            text = w.decode("utf-8", "replace")
            if m := PLAIN.fullmatch(text):
                out[w] = self.word(*m.groups())
            else:
                rest.append(w)
        out.update(zip(rest, self.packed(rest)))
        return out

    def packed(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self.packed(texts)
        words = [t.split() for t in texts]
        new, here = [], {}
        for w in set(chain.from_iterable(words)):
            if (found := self.cache.get(w)) is None:
                new.append(w)
            else:
                here[w] = found
        more = self.new(new)
        if len(self.cache) + len(new) > CACHE_WORDS:  # frequent words are in this batch, too
            self.cache = dict(here)
        self.cache |= more
        here |= more  # small, so that the many look-ups stay in the processor's cache
        return [b"".join(map(here.__getitem__, ws)) for ws in words]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process; its words stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- index


def _bits(keys: np.ndarray, level: int, n: int) -> np.ndarray:
    return (mixed64(keys + U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U(n)).astype(np.int64)


@dataclass
class Index:
    levels: list[np.ndarray]
    ranks: list[np.ndarray]
    prints: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where its fingerprint isn't there."""
        keys = keys.astype(U)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            bit = _bits(keys[todo], level, 64 * len(words))
            word, at = words[bit >> 6], (bit & 63).astype(U)
            hit = (word >> at & U(1)) == 1
            out[todo[hit]] = (ranks[bit >> 6] + np.bitwise_count(word & ((U(1) << at) - U(1))))[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        known = out >= 0
        out[known] = np.where(self.prints[out[known]] == _prints(keys[known]), out[known], -1)
        return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mixed64(keys ^ U(0xD6E8FEB86659FD93)) >> U(32)).astype(np.uint32)


def build_index(keys: np.ndarray, first: np.ndarray, count: np.ndarray, gamma: float = 2.0) -> Index:
    """Of distinct keys; every level settles most of what is left, so there are a dozen or two."""
    keys = keys.astype(U)
    levels, ranks, left, before = [], [], keys, 0
    while len(left):
        n = 64 * max(1, -(-int(gamma * len(left)) // 64))
        bit = _bits(left, len(levels), n)
        alone = np.bincount(bit, minlength=n) == 1
        words = np.packbits(alone, bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        levels.append(words)
        ranks.append(before + np.cumsum(ones) - ones)
        before += int(ones.sum())
        left = left[~alone[bit]]
    index = Index(levels, ranks, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
    at = _numbers(index, keys)
    index.prints[at], index.first[at], index.count[at] = _prints(keys), first, count
    return index


def _numbers(index: Index, keys: np.ndarray) -> np.ndarray:
    out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, (words, ranks) in enumerate(zip(index.levels, index.ranks)):
        bit = _bits(keys[todo], level, 64 * len(words))
        at = (bit & 63).astype(U)
        hit = (words[bit >> 6] >> at & U(1)) == 1
        out[todo[hit]] = (ranks[bit >> 6] + np.bitwise_count(words[bit >> 6] & ((U(1) << at) - U(1))))[hit]
        todo = todo[~hit]
    return out


# ---- shards


def write_shard(folder: str, name: str, ids: list[bytes], doc_ids: list[int | None], width: int) -> dict:
    """Write one shard's two files; ``doc_ids`` ascend, nulls last. Returns its line of the manifest."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    keys, first, count = np.unique(known, return_index=True, return_counts=True)
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) // width for x in ids], out=offsets[1:])
    index = build_index(keys, first, count)
    head = np.array([len(ids), len(keys), offsets[-1], width, len(ids) - len(known), len(index.levels), *map(len, index.levels)], "<i8")
    parts = [MAGIC, head.tobytes(), *(x.astype("<u8").tobytes() for x in index.levels), *(x.astype("<i8").tobytes() for x in index.ranks)]
    parts += [x.astype("<u4").tobytes() for x in (index.prints, index.first, index.count)] + [offsets.astype("<i8").tobytes()]
    all_ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    for kind, content in (("bin", ids), ("idx", parts), ("key", [all_ids])):
        with fs.open_output_stream(f"{root}/.{name}.{kind}.{attempt}") as out:
            for x in content:
                out.write(x)
        fs.move(f"{root}/.{name}.{kind}.{attempt}", f"{root}/{name}.{kind}")
    return {"name": name, "n_docs": len(ids), "n_tokens": int(offsets[-1]), "least": int(known[0]) if len(known) else None, "most": int(known[-1]) if len(known) else None, "n_null": len(ids) - len(known)}


class Shard:
    """One shard, opened for reading; its head is read, all else as it is asked for."""

    HEAD = 8 + 6 * 8

    def __init__(self, folder: str, name: str):
        self.fs, self.root = file_system(folder)
        self.name = name
        self.idx, self.bin = (self.fs.open_input_file(f"{self.root}/{name}.{kind}") for kind in ("idx", "bin"))
        raw = self._read(0, self.HEAD)
        if raw[:8] != MAGIC:
            raise ValueError(f"{name}.idx is no index")
        self.n_docs, self.n_keys, self.n_tokens, self.width, self.n_null, n_levels = np.frombuffer(raw, "<i8", 6, 8).tolist()
        self.words = self._numbers(self.HEAD, n_levels, "<i8").tolist()
        at = self.HEAD + 8 * n_levels
        self.levels = [at + 8 * sum(self.words[:i]) for i in range(n_levels)]
        self.ranks = [x + 8 * sum(self.words) for x in self.levels]
        self.prints = at + 16 * sum(self.words)
        self.first, self.count, self.offsets = (self.prints + 4 * i * self.n_keys for i in (1, 2, 3))

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.idx.close()
        self.bin.close()

    def _read(self, at: int, n: int) -> bytes:
        self.idx.seek(at)
        return self.idx.read(n)

    def _numbers(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._read(at, n * np.dtype(kind).itemsize), kind)

    def number(self, doc_id: int) -> int:
        """The number of a key, -1 if its fingerprint isn't there; a few reads of 4 or 8 bytes."""
        key = np.array([doc_id]).astype(U)
        for level, (n, words, ranks) in enumerate(zip(self.words, self.levels, self.ranks)):
            bit = int(_bits(key, level, 64 * n)[0])
            word = int(self._numbers(words + 8 * (bit >> 6), 1, "<u8")[0])
            if word >> (bit & 63) & 1:
                out = int(self._numbers(ranks + 8 * (bit >> 6), 1, "<i8")[0]) + (word & ((1 << (bit & 63)) - 1)).bit_count()
                return out if self._numbers(self.prints + 4 * out, 1, "<u4")[0] == _prints(key)[0] else -1
        return -1

    def ids(self, document: int, n: int = 1) -> list[np.ndarray]:
        """The ids of ``n`` documents from this one in the shard on, read at once."""
        ends = self._numbers(self.offsets + 8 * document, n + 1, "<i8")
        self.bin.seek(int(ends[0]) * self.width)
        flat = np.frombuffer(self.bin.read(int(ends[-1] - ends[0]) * self.width), f"<u{self.width}")
        return np.split(flat, ends[1:-1] - ends[0])

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this id; none if there is none."""
        if doc_id is None:
            return self.ids(self.n_docs - self.n_null, self.n_null) if self.n_null else []
        n = self.number(doc_id)
        if n < 0:
            return []
        first, count = (int(self._numbers(at + 4 * n, 1, "<u4")[0]) for at in (self.first, self.count))
        return self.ids(first, count)

    def index(self) -> Index:
        """The whole index, for many lookups at once."""
        levels = [self._numbers(at, n, "<u8") for at, n in zip(self.levels, self.words)]
        ranks = [self._numbers(at, n, "<i8") for at, n in zip(self.ranks, self.words)]
        return Index(levels, ranks, *(self._numbers(at, self.n_keys, "<u4") for at in (self.prints, self.first, self.count)))

    def doc_ids(self) -> np.ndarray:
        """All documents' ids in order; those of the last ``n_null`` mean nothing."""
        with self.fs.open_input_stream(f"{self.root}/{self.name}.key") as f:
            return np.frombuffer(f.read(), "<i8")


def _sort_keys(rows: pa.RecordBatch | pa.Table, salt: np.ndarray) -> np.ndarray:
    """Byte strings that sort as (doc_id, nulls last, tie, salt) do; the salt tells repeated rows apart, so that ranges
    can cut between them."""
    doc_id, sign = rows.column("doc_id"), U(1 << 63)
    known = doc_id.fill_null(0).to_numpy().astype(U) ^ sign
    null = np.asarray(doc_id.is_null(), bool).astype(U)
    return np.ascontiguousarray(np.stack([null, known, rows.column("tie").to_numpy().astype(U) ^ sign, salt], axis=1).astype(">u8")).view("S32").ravel()


def _cuts(slim: DataFrame) -> np.ndarray:
    """Keys that cut the documents into ranges of about RANGE_BYTES of text, by a sample of some SAMPLE_KEYS a range."""
    n = max(1, slim.count())
    keyed = slim.select("doc_id", F.xxhash64("text").alias("tie"), F.octet_length("text").cast("long").alias("size"))
    share = min(1.0, SAMPLE_ROWS / n)
    rows = keyed.sample(share, seed=17).toArrow()
    parts = int(sum(x or 0 for x in rows.column("size").to_pylist()) / share / RANGE_BYTES) + 1
    if share < 1 and rows.num_rows < SAMPLE_KEYS * parts:
        rows = keyed.sample(min(1.0, 1.2 * SAMPLE_KEYS * parts / n), seed=17).toArrow()
    keys = np.sort(_sort_keys(rows, mixed64(np.arange(1, rows.num_rows + 1, dtype=U))))
    return np.unique(keys[np.linspace(0, len(keys), parts + 1).astype(int)[1:-1]]) if len(keys) else keys


def write_store(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 1) -> tuple[str, list[dict]]:
    """Encode all documents into a store; returns its folder and manifest (a row per shard, in order)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "tokens")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = _cuts(slim)

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
        row = TaskContext.get().partitionId() << 40  # the same in every attempt
        for batch in batches(it, 1 << 20):
            salt = mixed64(np.arange(row + 1, row + 1 + batch.num_rows, dtype=U))
            row += batch.num_rows
            part = np.searchsorted(cuts, _sort_keys(batch, salt)).astype(np.int32)
            ids = pa.array([x + end for x in encoder.encode(text_bytes(batch))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), ids, pa.array(part)], ["doc_id", "tie", "ids", "part"])

    coded = slim.withColumn("tie", F.xxhash64("text")).mapInArrow(encoded, "doc_id long, tie long, ids binary, part int")
    ranged = coded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.col("tie").asc())
    width = encoder_of(tokenizer).width

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        part, seq, size = TaskContext.get().partitionId(), 0, 0

        def flush():
            nonlocal seq, size
            line = write_shard(folder, f"shard-{part:08d}-{seq:04d}", ids, doc_ids, width)
            ids.clear()
            doc_ids.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_pylist([line], pa.schema([("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("n_null", pa.int64())]))

        for batch in it:
            ids += batch.column("ids").to_pylist()
            doc_ids += batch.column("doc_id").to_pylist()
            size += sum(map(len, ids[len(ids) - batch.num_rows :]))
            if size > SHARD_BYTES:
                yield flush()
        if ids:
            yield flush()

    lines = written(ranged.mapInArrow(run, "name string, n_docs long, n_tokens long, least long, most long, n_null long"), "manifest")
    manifest = [r.asDict() for r in lines.orderBy("name").collect()]
    start = 0
    for line in manifest:
        line["start"] = start
        start += line["n_tokens"]
    return folder, manifest


def read_store(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Every document of a store, found by key through the index: doc_id, start, n_tokens, ids_crc32. A shard is read
    in pieces of about READ_BYTES."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, start in zip(*batch.to_pydict().values()):
                with Shard(folder, name) as shard:
                    known, keys, index = shard.n_docs - shard.n_null, shard.doc_ids(), shard.index()
                    n = index.find(keys[:known])
                    first = index.first[n].astype(np.int64)
                    after = np.arange(known) - first
                    if (n < 0).any() or (after < 0).any() or (after >= index.count[n]).any():
                        raise ValueError(f"{name}: the index doesn't find its keys")
                    offsets = shard._numbers(shard.offsets, shard.n_docs + 1, "<i8")
                    crc, at = [], 0
                    while at < shard.n_docs:
                        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_BYTES // shard.width)) - 1)
                        crc += [zlib.crc32(x.astype("<u4").tobytes()) for x in shard.ids(at, end - at)]
                        at = end
                    ids = pa.array(keys, mask=np.arange(shard.n_docs) >= known)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(m["name"], m["start"]) for m in manifest]
    listed = spark.createDataFrame(rows, "name string, start long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Store:
    """Keyed access from one process. Shards ascend, so the manifest is bisected for those that can hold a key; the
    rest is constant time. The ``most_open`` shards used last stay open."""

    def __init__(self, folder: str, manifest: list[dict], most_open: int = 64):
        self.folder, self.most_open, self.open = folder, most_open, {}
        self.keyed = [m for m in manifest if m["least"] is not None]
        self.least, self.most = [m["least"] for m in self.keyed], [m["most"] for m in self.keyed]
        self.null = [m for m in manifest if m["n_null"]]

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        while self.open:
            self.open.popitem()[1].close()

    def shard(self, name: str) -> Shard:
        found = self.open.pop(name, None) or Shard(self.folder, name)
        self.open[name] = found
        if len(self.open) > self.most_open:
            self.open.pop(next(iter(self.open))).close()
        return found

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this id (None: without one)."""
        held = self.null if doc_id is None else self.keyed[bisect_left(self.most, doc_id) : bisect_right(self.least, doc_id)]
        return [x for m in held for x in self.shard(m["name"]).get(doc_id)]
