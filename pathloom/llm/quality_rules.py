"""Quality rules: counts over words and lines, and bands of zstandard ratios.

Repetitive text compresses far better than prose, random characters hardly at
all. Each document is compressed whole and in fixed chunks; the ratios must lie
inside bands whose limits depend on length, since the dictionary that a
compressor builds pays off more in long texts.

Defined results: a null text counts as empty (no words, so ``base_failed`` and
not kept); a null id stays null; repeated rows are judged each on its own; an
empty table gives an empty result; other columns are ignored by ``measure`` and
passed on untouched by ``keep``. Texts are never cut: one long document is
compressed as a whole, chunk after chunk.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, batches, small_batches, text_bytes

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio (bytes before / bytes after). The upper ones are a line through ``most`` (bytes, ratio) over
    the logarithm of the length, level before and beyond; the lower ones are steps, ``least`` (length below, limit).

    The upper limits were fitted (see ``fit``) to 20,000 labelled documents: they stand just above the ratios of good
    prose of a length (0.1 to 0.2 above the mean from 1 KB on), and reject looped text, tables of words and words
    with repeated marks, which compress better than prose of their length. The lower ones stand above random text
    (base64, printable, alphanumeric or CJK characters: up to 1.14 at 300 bytes, 1.26 at 512 and 1.43 at 30 KB, in
    words of four characters at least from 512 bytes on) and below prose (1.26 at 256, 1.40 at 512, 2.07 at 4096).
    Texts under 256 bytes have no lower limit, because frame overhead dominates there; chunks under
    ``least_length`` (a text's last) are not judged, since the whole text is."""

    level: int = 3
    most: tuple[tuple[int, float], ...] = ((256, 1.95), (512, 1.96), (724, 2.035), (1024, 2.08), (1448, 2.15), (2048, 2.19), (2896, 2.235), (4096, 2.285), (8192, 2.385), (16384, 2.465), (32768, 2.545), (65536, 2.605), (131072, 2.66), (4194304, 2.96))
    least: tuple[tuple[int, float], ...] = ((256, 0.0), (320, 1.155), (384, 1.195), (448, 1.225), (512, 1.255), (640, 1.315), (768, 1.34), (1024, 1.37), (1536, 1.4), (2048, 1.41), (4096, 1.43))
    least_beyond: float = 1.45
    least_length: int = 512
    chunk: int = 4096
    chunk_share: float = 0.5

    def upper(self, n: int) -> float:
        i = bisect_right(self.most, (n, math.inf))
        if i in (0, len(self.most)):
            return self.most[max(0, i - 1)][1]
        (a, x), (b, y) = self.most[i - 1], self.most[i]
        return x + (y - x) * math.log(n / a) / math.log(b / a)

    def lower(self, n: int) -> float:
        return next((r for below, r in self.least if n < below), self.least_beyond)


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, CONTINUATION + WHITE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) != len(windows):
            inside = bytearray(n)
            for i, g in enumerate(windows):
                if seen[g] > 1:
                    inside[i] = inside[i + 1] = inside[i + 2] = 1
            repeated = sum(inside)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def in_bands(text: bytes, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple[bool, float]:
    """Whether the ratios of the text lie in the bands, and the whole text's ratio."""
    n = len(text)
    if not n:
        return False, 0.0
    ratio = n / len(zstd.compress(text))
    if ratio > bands.upper(n) or ratio < bands.lower(n):
        return False, ratio
    if n > bands.chunk:
        outside = chunks = 0
        for i in range(0, n, bands.chunk):
            part = text[i : i + bands.chunk]
            if len(part) < bands.least_length:
                break
            r = len(part) / len(zstd.compress(part))
            chunks += 1
            outside += r > bands.upper(len(part)) or r < bands.lower(len(part))
        if outside > bands.chunk_share * chunks:
            return False, ratio
    return True, ratio


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(texts: list[bytes], bands: Bands) -> list[tuple]:
    zstd = zstandard.ZstdCompressor(level=bands.level)
    out = []
    for text in texts:
        c = counts(text)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        good, ratio = in_bands(text, bands, zstd)
        out.append((*c, failed, good and not failed, ratio))
    return out


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and zstd_ratio."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = list(zip(*_judge(text_bytes(batch), bands)))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(rows, kinds))], ["doc_id", *NAMES, "base_failed", "kept", "zstd_ratio"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            yield batch.filter(pa.array([r[6] for r in _judge(text_bytes(batch), bands)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, good: DataFrame, bands: Bands = Bands(), rows: int = 20_000, share: float = 0.9995, margin: float = 0.01) -> Bands:
    """``bands`` with upper limits just above the ratios of documents that are known to be good (ids in ``good``,
    column doc_id): at each length of ``most``, above ``share`` of those within half an octave that the base rules
    pass, each moved along the limits there are; where there are fewer than 20, the limit stays. At most ``rows``
    labelled documents, those of the smallest hashes of ids, are used."""
    measured = measure(docs, bands).where("not base_failed").join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n"))
    some = measured.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("n", "zstd_ratio").collect()
    over = [(math.log2(r.n), r.zstd_ratio - bands.upper(r.n)) for r in some]
    most = []
    for n, limit in bands.most:
        near = sorted(x for at, x in over if abs(at - math.log2(n)) <= 0.5)
        most.append((n, round(limit + near[min(len(near) - 1, int(share * len(near)))] + margin, 4) if len(near) >= 20 else limit))
    return replace(bands, most=tuple(most))
