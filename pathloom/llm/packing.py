"""Numpy arrays as compressed bytes, and groups of rows in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from .common import trim


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, equal places of numbers side by side."""
    out = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        out.append(a.dtype.str.encode().ljust(8) + np.array([len(a)], "<i8").tobytes())
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(body: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 8, []
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        kind, n = np.dtype(raw[at : at + 8].decode().strip()), int(np.frombuffer(raw, "<i8", 1, at + 8)[0])
        at += 16
        x = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(x.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the narrowest kind."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return np.flatnonzero(new)


def spread(sizes: np.ndarray) -> np.ndarray:
    """0 repeated sizes[0] times, 1 sizes[1] times, and so on."""
    return np.repeat(np.arange(len(sizes)), sizes)


def units(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, of a partition sorted by them. A group's batches are held as they come
    and joined once, when the next group begins."""
    held: list[pa.RecordBatch] = []
    trim()
    for batch in it:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            cuts.insert(0, 0)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
