"""SentencePiece models run by the tokenizers library, checked against SentencePiece itself.

The model's protobuf is parsed here (wire format, no generated code). From it
are rebuilt the normaliser (character map, blanks, the leading metaspace), the
segmentation model - unigram scores, or merges in score order for a BPE model -
and byte fallback. Texts are encoded in batches, which the library spreads over
threads, and ids are decoded by the rebuilt decoder. The ids that come out are
the rebuilt model's; every document is encoded by SentencePiece, too, only to
verify them, and ``parity`` says whether both agree (two equal scores might be
broken differently).

If normalisation leaves texts as they are but for blanks, and no piece has
something before a metaspace, then a piece never crosses the start of a run of
blanks. Texts are then cut there, and batches hold each distinct segment that
the worker hasn't met yet. Cutting, telling segments apart, and joining their
ids and the texts of pieces are Arrow kernels over whole batches.

Defined results: null text is empty and has no ids; bytes that are no UTF-8 are
encoded as replacement characters; ids decode to the normalised text, which is
the text itself for models that normalise nothing (``roundtrip``); repeated rows
are encoded each on its own; an empty table gives an empty result; other columns
pass through ``encode`` untouched.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, fresh_name, small_batches, text_bytes

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_SEGMENTS = 1_000_000
IDLE_SEGMENTS = 250_000  # that a worker keeps between tasks, where other stages need its memory
JOINED = 64  # segments that the library encodes as one text


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; fixed-width values stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """What is needed of a model file. Numbers of fields are those of its public schema."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @staticmethod
    def read(path: str) -> Model:
        with open(path, "rb") as f:
            raw = f.read()
        m = Model()
        for n, v in fields(raw):
            if n == 1:
                p = dict(fields(v))
                m.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif n == 2:
                t = dict(fields(v))
                m.kind, m.byte_fallback, m.suffix = t.get(3, UNIGRAM), bool(t.get(35, 0)), bool(t.get(24, 0))
            elif n == 3:
                s = dict(fields(v))
                m.charsmap, m.dummy_prefix, m.squeeze, m.escape = s.get(2, b""), bool(s.get(3, 1)), bool(s.get(4, 1)), bool(s.get(5, 1))
        if m.kind not in (UNIGRAM, BPE) or m.suffix or not m.escape:
            raise ValueError("only unigram and BPE models with a leading metaspace are supported")
        return m

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def separable(self) -> bool:
        """Whether segments that begin at a run of blanks are encoded independently of each other."""
        return not self.charsmap and not self.squeeze and self.dummy_prefix and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, k in self.pieces if k in (NORMAL, USER, UNUSED))


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first (of one piece: the pair of smallest ids)."""
    ids = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER, UNUSED)}
    out = []
    for p, i in ids.items():
        for at in range(1, len(p)):
            if p[:at] in ids and p[at:] in ids:
                out.append((-m.pieces[i][1], i, ids[p[:at]], ids[p[at:]]))
    return [(m.pieces[a][0], m.pieces[b][0]) for _, _, a, b in sorted(out)]


def rebuild(m: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == UNIGRAM:
        # pieces that text must not match are scored out of reach; the unknown and byte pieces are reached by fallback
        vocab = [(p, s if k in (NORMAL, USER) else -1e9) for p, s, k in m.pieces]
        model = models.Unigram(vocab, unk_id=m.unknown, byte_fallback=m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, merges(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if m.separable:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    parts = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(parts + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return t


MARK = SPACE.encode()


def packed_array(raw: bytes, offsets: np.ndarray) -> pa.Array:
    """The stretches of ``raw`` between offsets, as an array of byte strings."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])


def slices(items: pa.Array, bounds: np.ndarray) -> list[bytes]:
    """The byte strings of ``items`` joined: those from one bound to the next."""
    _, offsets, data = items.buffers()
    at = np.frombuffer(offsets, np.int64, len(items) + 1)[bounds].tolist() if len(items) else [0] * len(bounds)
    raw = memoryview(data) if data else b""
    return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]


class Codec:
    """Encode and decode with a rebuilt model; one per worker."""

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import SentencePieceProcessor

        self.model, self.threads = Model.read(path), threads
        self.tokenizer = rebuild(self.model)
        self.own = SentencePieceProcessor(model_file=path)
        self.plain = self.model.separable
        self.cache: dict[bytes, bytes] = {}  # segments to packed ids
        self.parts: pa.Array | None = None  # pieces as decoded
        self.begins = np.array([k != BYTE and p.startswith(SPACE) for p, _, k in self.model.pieces])

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids as packed 4-byte integers, by the rebuilt normaliser, pre-tokenizer and model, over all threads."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}i", *ids) for ids in (e.ids for e in found)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts in UTF-8 as packed 4-byte integers."""
        if not self.plain:
            return self.raw([t.decode() for t in texts])
        # the metaspace itself may stand in a text; it counts as a blank
        texts = [b" " + t.replace(MARK, b" ") if t else t for t in texts]
        bounds = np.cumsum([0, *map(len, texts)])
        raw = b"".join(texts)
        blank = np.frombuffer(raw, "u1") == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[bounds[:-1][np.diff(bounds) > 0]] = True  # each text begins a segment, also where the one before ends in blanks
        starts = np.flatnonzero(first)
        cut = packed_array(raw, np.append(starts, len(raw))).dictionary_encode()
        words = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, words))
        at = [i for i, x in enumerate(found) if x is None]
        new = [words[i] for i in at]
        more = self.segments(new) if new else []
        for i, x in zip(at, more):
            found[i] = x
        if len(self.cache) + len(new) > CACHE_SEGMENTS:  # frequent segments are in this batch, too
            self.cache = dict(zip(words, found))
        else:
            self.cache.update(zip(new, more))
        return slices(pa.array(found, pa.large_binary()).take(cut.indices), np.searchsorted(starts, bounds))

    def segments(self, new: list[bytes]) -> list[bytes]:
        """Ids of segments. Those with one blank go to the library many as one text, whose pre-tokens they are: each
        has one piece that begins with a metaspace, its first. Others are texts of their own. The first blank is what
        the normaliser puts before a text."""
        out: dict[bytes, bytes] = {}
        one = [s for s in new if s[1:2] not in (b"", b" ")]
        rest = [s for s in new if s[1:2] in (b"", b" ")]
        groups = [one[i : i + JOINED] for i in range(0, len(one), JOINED)]
        found = self.tokenizer.encode_batch_fast([b"".join(g)[1:].decode() for g in groups] + [s[1:].decode() for s in rest], add_special_tokens=False)
        if groups:
            ids = [np.array(e.ids, "<i4") for e in found[: len(groups)]]
            if [int(np.count_nonzero(self.begins[x])) for x in ids] != list(map(len, groups)):
                raise ValueError("segments and their first pieces differ in number")
            ids = np.concatenate(ids)
            at = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * 4
            packed = packed_array(ids.tobytes(), at).to_numpy(zero_copy_only=False).tolist()
            if len(one) == len(new):
                return packed
            out.update(zip(one, packed))
        for s, e in zip(rest, found[len(groups) :]):
            out[s] = np.array(e.ids, "<i4").tobytes()
        if b" " in out:  # the normaliser adds no prefix to an empty text, but a lone blank is a piece
            out[b" "] = struct.pack("<i", self.tokenizer.token_to_id(SPACE))
        return [out[s] for s in new]

    def rest(self) -> None:
        """Between tasks only a bounded cache stays."""
        if len(self.cache) > IDLE_SEGMENTS:
            self.cache.clear()

    def _decoded(self, ids: list[list[int]]) -> list[bytes]:
        """What the rebuilt decoder makes of ids that stand inside a text: it strips one blank where a text begins."""
        first = [self.tokenizer.token_to_id(SPACE)] if self.model.dummy_prefix else []
        return [t.encode() for t in self.tokenizer.decode_batch([first + x for x in ids], skip_special_tokens=False)]

    def decode(self, many: list[bytes]) -> list[bytes]:
        """The (normalised) texts of packed ids; bytes that are no UTF-8 become replacement characters. A piece decodes
        alike wherever it stands, so all were decoded once, and so does a byte that is ASCII; other runs of bytes are
        decoded as they come, each distinct one once a batch."""
        if self.parts is None:
            found = self._decoded([[i] for i in range(len(self.model.pieces))])
            self.parts = pa.array([b"" if k == CONTROL else x for x, (_, _, k) in zip(found, self.model.pieces)], pa.large_binary())
            self.byte = np.array([k == BYTE for _, _, k in self.model.pieces])
            self.high = np.array([k == BYTE and int(p[3:-1], 16) > 127 for p, _, k in self.model.pieces])
        ids = np.frombuffer(b"".join(many), "<i4")
        bounds = np.cumsum([0, *(len(x) // 4 for x in many)])
        parts, high = self.parts, np.flatnonzero(self.high[ids])
        if len(high):
            byte = self.byte[ids]
            first = byte.copy()
            first[1:] &= ~byte[:-1]
            first[bounds[:-1][np.diff(bounds) > 0]] = True  # no run crosses texts; beginnings that are no bytes do no harm
            ends = ~byte
            ends[1:] |= first[1:]
            begin = np.flatnonzero(first)
            begin = begin[np.unique(np.searchsorted(begin, high, "right") - 1)]
            stop = np.append(np.flatnonzero(ends), len(ids))
            stop = stop[np.searchsorted(stop, begin, "right")]
            runs = [ids[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist())]
            number = {x: len(parts) + i for i, x in enumerate(dict.fromkeys(runs))}
            decoded = self._decoded([np.frombuffer(x, "<i4").tolist() for x in number])
            parts = pa.concat_arrays([parts, pa.array(decoded, pa.large_binary())])
            # a run becomes one number, and what is left of it goes
            inside = np.zeros(len(ids) + 1, np.int8)
            np.add.at(inside, begin + 1, 1)
            np.add.at(inside, stop, -1)
            stays = np.cumsum(inside[:-1]) == 0
            ids = ids.copy()
            ids[begin] = [number[x] for x in runs]
            ids, bounds = ids[stays], np.concatenate([[0], np.cumsum(stays)])[bounds]
        whole = slices(parts.take(pa.array(ids, pa.int32())), bounds)
        return [t[1:] if self.model.dummy_prefix and t[:1] == b" " else t for t in whole]

    def checked(self, texts: list[bytes]) -> Iterator[tuple[bytes, bool]]:
        """Per text its packed ids, and whether SentencePiece gives the same for the whole text."""
        texts = [_valid(t) for t in texts]
        own = self.own.encode([t.decode() for t in texts], num_threads=self.threads)
        for mine, theirs in zip(self.encode(texts), own):
            yield mine, mine == struct.pack(f"<{len(theirs)}i", *theirs)


def _valid(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


_CODECS: dict[tuple[str, int], Codec] = {}


def codec_of(path: str, threads: int) -> Codec:
    """One codec per worker process."""
    if (path, threads) not in _CODECS:
        _CODECS[path, threads] = Codec(path, threads)
    return _CODECS[path, threads]


def encode(docs: DataFrame, path: str, threads: int = 2, ids: str = "token_ids", parity: str = "parity") -> DataFrame:
    """``docs`` with two more columns: the ids of ``text`` (array of int), and whether both libraries agree."""
    small_batches(docs.sparkSession)
    ids, parity = fresh_name(docs, ids), fresh_name(docs, parity)
    schema = T.StructType([*docs.schema, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(parity, T.BooleanType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, threads)
        for batch in batches(it):
            found = list(codec.checked(text_bytes(batch)))
            ends = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x, _ in found], out=ends[1:])
            flat = np.frombuffer(b"".join([x for x, _ in found]), "<i4")
            batch = batch.append_column(ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
            yield batch.append_column(parity, pa.array([p for _, p in found]))
        codec.rest()

    return docs.mapInArrow(run, schema)


def summary(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32, parity, roundtrip (ids decode to the text), decoded_sha256."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, roundtrip boolean, decoded_sha256 string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, threads)
        for batch in batches(it):
            texts, rows = text_bytes(batch), []
            found = list(codec.checked(texts))
            for text, (x, same), back in zip(texts, found, codec.decode([x for x, _ in found])):
                rows.append((len(x) // 4, zlib.crc32(x), same, back == text, hashlib.sha256(back).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_tokens", "ids_crc32", "parity", "roundtrip", "decoded_sha256"])
        codec.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
