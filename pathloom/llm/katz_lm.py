"""Scores of a Katz backoff model of n-grams that is learnt from the same documents.

A document's tokens are its words (A-Z as a-z) and an end. With counts ``c``
over the training documents, ``d_r`` the Good-Turing discount of counts up to 5
(of each order its own):

* ``P(w) = d * c(w) / N`` for known tokens; what the discounts leave is the
  probability of the unknown word;
* ``P(w | h) = s(h) * d * c(h w) / c(h)`` where ``h w`` was seen, else
  ``a(h) * P(w | h')``, and ``P(w | h')`` alone where ``h`` was not; ``h'`` is
  ``h`` without its first token. ``a(h)`` makes the sum over all tokens exactly
  one. ``s(h)`` is 1, but where all that follows ``h`` is too frequent to be
  discounted: there ``s(h) = c(h) / (c(h) + 1)`` leaves mass for the rest.
  Discounts that irregular counts of counts would put outside (0, 1) are
  ``(r - 1/2) / r``.

A document's first token has the begin as its history, the next ones what there
is, up to ``order - 1`` tokens. Every order is a pass of its own, since an
order's probabilities of what was seen are what the next one's weights need.

Rows of single tokens would be many times the input, so all steps move packed,
compressed arrays of blocks of documents:

1. A block codes its texts by its own word list; the list goes, cut by hash, to
   the tables of words, which answer with counts and ids (request, response).
2. For each order a block sends its distinct n-grams, as ids of history and
   word, to the n-gram's partition: that of the history, or, if that is so
   frequent that it would fill one (there are at most twice as many such as
   partitions), that of the n-gram. The partition answers with counts (and, as
   histories of the next order, with numbers), and keeps what ``a(h)`` needs of
   histories after which a block has unseen words (only held-out documents have
   them).
3. Once the counts of counts fix the discounts, the weights of these histories
   are answered, too; after the last order each block scores its documents.

The driver sees one row of sums per partition and order, and the frequent
histories. Partitions are as many as the session's, or as the text needs.

Defined results: a null text is empty and has the end as its one token; a null
doc_id is hashed as empty text; repeated rows are documents of their own; with
nothing to learn from, every score is 0; an empty table gives an empty result.
Words are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, text_bytes, written
from .mixing import mixed64
from .packing import narrow, pack, runs, spread, units, unpack
from .shingles import word_hashes

U = np.uint64
K = 5
BLOCK_TOKENS = 1_500_000
TASK_BYTES = 64 << 20  # text whose n-grams one task of the tables takes, about
CELLS = 2  # parts of the tables per task, which goes through them one by one and holds no more
BEGIN, END, WORDS = 0, 1, 2  # ids of the begin and of the end; words' ids follow


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def discounts(n: np.ndarray) -> np.ndarray:
    """d_1 .. d_K of counts of counts n_1 .. n_(K+1)."""
    r = np.arange(1, K + 1)
    plain = (r - 0.5) / r
    if (n <= 0).any() or (common := (K + 1) * n[K] / n[0]) >= 1:
        return plain
    d = ((r + 1) * n[1 : K + 1] / (r * n[:K]) - common) / (1 - common)
    return np.where((d > 0) & (d < 1), d, plain)


class Unigrams:
    """log10 P(w) by count, the unknown word at 0."""

    def __init__(self, n: np.ndarray, total: int):
        self.d, self.total = discounts(n), total
        r = np.arange(1, K + 1)
        left = float(((1 - self.d) * r * n[:K]).sum()) / total if total else 1.0
        self.scale = 1.0 if left > 0 else total / (total + 1)
        self.unknown = left if left > 0 else 1 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        d = np.append(np.append(0.0, self.d), 1.0)[np.minimum(c, K + 1)]
        return np.where(c > 0, self.scale * d * c / max(1, self.total), self.unknown)


ROW = "kind int, block long, part int, n long, body binary"
DOCS, LIST, ANSWER, STATS, GRAMS, COUNTS, BACKOFF, WEIGHTS = range(8)


def _row(kind: int, block: int, part: int, n: int, body: bytes) -> tuple:
    return kind, block, part, n, body


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["kind", "block", "part", "n", "body"])


def _code(parts: int):
    """Texts to coded blocks, and their word lists cut by hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, ids, tokens, seq = [], [], [], 0, 0

        def flush():
            nonlocal tokens, seq
            block = TaskContext.get().partitionId() * 1_000_000 + seq
            n = np.concatenate(counts)
            words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            held = np.array([held_out(i) for i in ids])
            train = np.bincount(codes[~held[spread(n)]], minlength=len(words))
            null = np.array([i is None for i in ids])
            yield _out([_row(DOCS, block, -1, int((~held).sum()), pack(np.array([i or 0 for i in ids], np.int64), null, held, narrow(n), narrow(codes)))])
            part = ((words >> U(32)) * U(parts) >> U(32)).astype(np.int64)
            begins = np.searchsorted(part, np.arange(parts + 1))
            yield _out([_row(LIST, block, p, 0, pack(words[a:b], narrow(train[a:b]))) for p, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())) if b > a] or [_row(LIST, block, 0, 0, pack(words, train))])
            for x in (hashes, counts, ids):
                x.clear()
            tokens, seq = 0, seq + 1

        for batch in batches(it, 1 << 20):
            h, n = word_hashes(text_bytes(batch))
            hashes.append(h)
            counts.append(n)
            ids.extend(batch.column("doc_id").to_pylist())
            tokens += len(h)
            if tokens >= BLOCK_TOKENS:
                yield from flush()
        if ids:
            yield from flush()

    return run


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part of the word table: counts and places answered to each block, and the part's sums."""
    for t in units(it, ["part"]):
        part, blocks = t.column("part")[0].as_py(), t.column("block").to_pylist()
        lists = [unpack(b) for b in t.column("body").to_pylist()]
        words, place = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        c = np.bincount(place, weights=np.concatenate([x[1] for x in lists]), minlength=len(words)).astype(np.int64)
        at = 0
        for block, (own, _) in zip(blocks, lists):
            mine = place[at : at + len(own)]
            at += len(own)
            yield _out([_row(ANSWER, block, part, 0, pack(narrow(mine), narrow(c[mine])))])
        n = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]
        yield _out([_row(STATS, 0, part, len(words), pack(np.array([(c > 0).sum(), c.sum(), *n], np.int64)))])


class Totals:
    """What the word tables sum up to, with the ends of the training documents."""

    def __init__(self, stats: list, train_docs: int, parts: int):
        sizes, n = np.zeros(parts, np.int64), np.zeros(K + 1, np.int64)
        self.tokens, self.kinds, self.train_docs = train_docs, int(train_docs > 0), train_docs
        for r in stats:
            x = unpack(r["body"])[0]
            sizes[r["part"]] = r["n"]
            self.kinds += int(x[0])
            self.tokens += int(x[1])
            n += x[2:]
        if 0 < train_docs <= K + 1:
            n[train_docs - 1] += 1
        self.begins = WORDS + np.cumsum(sizes) - sizes
        self.unigrams = Unigrams(n, self.tokens)

    def crowd(self, cells: int) -> float:
        """Histories more frequent than this are spread over all cells."""
        return self.tokens / (2 * cells)


@dataclass
class Level:
    """The distinct n-grams of one order in a block, dealt out to cells."""

    gram: np.ndarray  # per token, the number of the n-gram that it ends; -1 without enough history
    last: np.ndarray  # per n-gram, a token that ends it
    ids: np.ndarray  # per n-gram, its history's id in the tables
    count: np.ndarray  # and training count
    by: np.ndarray  # n-grams by cell, in the order of their histories' ids
    begins: np.ndarray

    def cell(self, k: int) -> np.ndarray:
        return self.by[self.begins[k] : self.begins[k + 1]]


def _level(hist: np.ndarray, hist_ids: np.ndarray, hist_count: np.ndarray, word: np.ndarray, ids: np.ndarray, crowd: float, cells: int) -> Level:
    """``hist``: per token the number of its history in ``hist_ids`` and ``hist_count``, or -1."""
    at = np.flatnonzero(hist >= 0)
    _, first, number = np.unique(hist[at] << 32 | word[at], return_index=True, return_inverse=True)
    gram = np.full(len(word), -1, np.int64)
    gram[at] = number
    last = at[first]
    own, count = hist_ids[hist[last]], hist_count[hist[last]]
    spot = mixed64(own.astype(U))
    spot = np.where(count > crowd, mixed64(spot + ids[word[last]].astype(U)), spot)
    cell = ((spot >> U(32)) * U(cells) >> U(32)).astype(np.int64)
    by = np.lexsort((own, cell))
    return Level(gram, last, own, count, by, np.searchsorted(cell[by], np.arange(cells + 1)))


@dataclass
class Block:
    """A block of documents with what the word tables answered, and its n-grams as far as the tables have answered."""

    doc_ids: np.ndarray
    null: np.ndarray
    held: np.ndarray
    sizes: np.ndarray  # tokens per document
    known: np.ndarray
    base: np.ndarray
    ids: np.ndarray  # of the block's words, by local number
    count: np.ndarray
    word: np.ndarray  # tokens: local word, document
    doc: np.ndarray
    value: np.ndarray  # per token, log10 of its probability by the orders that are known
    level: Level | None = None  # of the order that isn't


class Known:
    """What the driver knows of an order: discounts, and weights of histories that are spread over all cells."""

    def __init__(self, d: np.ndarray, hot: dict[int, tuple[float, float]]):
        self.d, self.hot = d, hot


def _block(rows: list[tuple[int, int, int, bytes]], totals: Totals, cells: int, known: list[Known], more: bool) -> Block:
    """Of rows (kind, part, order, body) with one block's documents and answers: probabilities by the ``known`` orders
    (2 and up), recursively, and the n-grams of the next one if there is ``more``."""
    doc_ids, null, held, n, codes = unpack(next(b for k, *_, b in rows if k == DOCS))
    found = [(p, *unpack(b)) for p, b in sorted((p, b) for k, p, _, b in rows if k == ANSWER)]
    ids = np.concatenate([np.array([BEGIN, END]), *(totals.begins[p] + place.astype(np.int64) for p, place, _ in found)])
    c = np.concatenate([np.full(2, totals.train_docs), *(x.astype(np.int64) for *_, x in found)])
    n = n.astype(np.int64)
    docs, ends = len(n), np.cumsum(n + 1) - 1
    word = np.full(int(ends[-1]) + 1, END, np.int64)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner] = codes.astype(np.int64) + 2
    doc = spread(n + 1)
    x = Block(doc_ids, null, held, n + 1, np.bincount(doc[c[word] > 0], minlength=docs), np.bincount(doc, weights=np.log10((c[word] + 1) / (totals.tokens + totals.kinds + 1)), minlength=docs), ids, c, word, doc, np.log10(totals.unigrams.p(c))[word])
    starts, crowd = ends - n, totals.crowd(cells)
    hist, hist_ids, hist_count = np.concatenate([[BEGIN], word[:-1]]), ids, c
    hist[starts] = BEGIN
    for order, of in enumerate(known, 2):
        level = _level(hist, hist_ids, hist_count, word, ids, crowd, cells)
        count, number = np.zeros(len(level.last), np.int64), np.zeros(len(level.last), np.int64)
        extra, crowded = np.zeros(len(count)), level.count > crowd
        for k, cell, o, body in rows:
            if k == COUNTS and o == order:
                counts, scaled, *numbers = unpack(body)
                p = level.cell(cell)
                count[p] = counts
                extra[p[scaled]] = np.log10(level.count[p[scaled]] / (level.count[p[scaled]] + 1.0))
                if numbers:
                    number[p] = cell << 40 | numbers[0].astype(np.int64)
        for k, cell, o, body in rows:
            if k == WEIGHTS and o == order:
                p = level.cell(cell)
                p = p[(count[p] == 0) & (level.count[p] > 0) & ~crowded[p]]
                extra[p] = unpack(body)[0][np.unique(level.ids[p], return_inverse=True)[1]]
        q = np.flatnonzero(crowded)
        if len(q):
            own, place = np.unique(level.ids[q], return_inverse=True)
            both = np.array([of.hot[i] for i in own.tolist()])[place]
            extra[q] = np.where(count[q] > 0, both[:, 1], both[:, 0])
        discounted = np.append(np.append(1.0, of.d), 1.0)[np.minimum(count, K + 1)] * count
        value = np.where(count > 0, _log(discounted) - _log(level.count), x.value[level.last]) + extra
        x.value = np.where(level.gram >= 0, value[level.gram], x.value)
        hist, hist_ids, hist_count = np.concatenate([[-1], level.gram[:-1]]), number, count
        hist[starts] = -1
    if more:
        x.level = _level(hist, hist_ids, hist_count, word, ids, crowd, cells)
    return x


def _of_unit(t: pa.Table) -> list[tuple[int, int, int, bytes]]:
    return list(zip(*(t.column(c).to_pylist() for c in ("kind", "part", "n", "body"))))


def _grams(totals: Totals, cells: int, known: list[Known]):
    """Blocks with their answers to their distinct n-grams of the next order, by cell."""
    order = len(known) + 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(it, ["block"]):
            block = t.column("block")[0].as_py()
            x = _block(_of_unit(t), totals, cells, known, True)
            level = x.level
            train = np.bincount(level.gram[(level.gram >= 0) & ~x.held[x.doc]], minlength=len(level.last))
            out = []
            for k in range(cells):
                p = level.cell(k)
                if len(p):
                    heads = runs(level.ids[p])
                    words, which = np.unique(x.word[level.last[p]], return_inverse=True)  # the block's order is that of ids
                    # what the lower order gives: a word's count says it, of longer ones the logarithm does
                    lower = narrow(x.count[words]) if order == 2 else x.value[level.last[p]]
                    body = pack(*map(narrow, (np.diff(level.ids[p][heads], prepend=0), level.count[p][heads], np.diff(np.append(heads, len(p))), np.diff(x.ids[words], prepend=0), which, train[p])), lower)
                    out.append(_row(GRAMS, block, k, order, body))
            if out:
                yield _out(out)

    return run


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.where(x > 0, x, 1))


def _sum(totals: Totals, cells: int, order: int, top: int):
    """A cell's n-grams to counts, answered to each block; backoff requests; and the cell's counts of counts. Below the
    top order n-grams get numbers, as histories of the next."""
    crowd = totals.crowd(cells)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(it, ["part"]):
            cell, blocks = t.column("part")[0].as_py(), t.column("block").to_pylist()
            rows = [unpack(b) for b in t.column("body").to_pylist()]
            h = np.concatenate([np.repeat(np.cumsum(r[0], dtype=np.int64), r[2]) for r in rows])
            ch = np.concatenate([np.repeat(r[1], r[2]) for r in rows])
            w = np.concatenate([np.cumsum(r[3], dtype=np.int64)[r[4]] for r in rows])
            train = np.concatenate([r[5] for r in rows])  # as narrow as they came
            lower = np.concatenate([r[6][r[4]] if order == 2 else r[6] for r in rows])
            ends = np.cumsum([len(r[4]) for r in rows])
            del rows
            by = np.lexsort((w, h))
            new = np.ones(len(by), bool)
            new[1:] = (h[by][1:] != h[by][:-1]) | (w[by][1:] != w[by][:-1])
            gram = np.empty(len(by), np.int32 if len(by) < 1 << 31 else np.int64)
            gram[by] = np.cumsum(new) - 1
            one = by[new]
            h, w, ch, lower = h[one], None, ch[one].astype(np.int64), lower[one]
            del by, new
            c = np.bincount(gram, weights=train, minlength=len(one)).astype(np.int64)
            # histories: numbers of n-grams by count, and the lower order's probability of all words seen after
            hh, of = np.unique(h, return_inverse=True)
            m = np.stack([np.bincount(of[c == r], minlength=len(hh)) for r in range(1, K + 1)])
            big = np.bincount(of[c > K], minlength=len(hh))
            seen = np.where(c > 0, totals.unigrams.p(lower) if order == 2 else 10.0**lower, 0.0)
            seen_mass = np.bincount(of, weights=seen, minlength=len(hh))
            count_h = np.zeros(len(hh), np.int64)
            count_h[of] = ch
            hot = count_h > crowd
            scaled = (m.sum(axis=0) == 0) & (big > 0) & ~hot
            asks = ((count_h > 0) & ~hot)[of] & (c == 0)
            asked, begin = [], 0
            for block, end in zip(blocks, ends.tolist()):
                own = gram[begin:end]
                begin = end
                numbers = [narrow(own)] if order < top else []
                yield _out([_row(COUNTS, block, cell, order, pack(narrow(c[own]), np.flatnonzero(scaled[of[own]] & (c[own] > 0)), *numbers))])
                if len(q := np.unique(of[own[asks[own]]])):
                    asked.append((q, np.full(len(q), block)))
            n = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]
            x = np.flatnonzero(hot)
            yield _out([_row(STATS, 0, cell, order, pack(n, hh[x], count_h[x], m[:, x].ravel(), big[x], seen_mass[x]))])
            if asked:
                q, block = (np.concatenate(y) for y in zip(*asked))
                used, q = np.unique(q, return_inverse=True)
                yield _out([_row(BACKOFF, 0, cell, order, pack(narrow(count_h[used]), narrow(m[:, used].ravel()), seen_mass[used], narrow(q), block))])

    return run


def weights(d: np.ndarray, count: np.ndarray, m: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of a(h) and of s(h): the mass that discounts leave over the unigram mass of what wasn't seen."""
    r = np.arange(1, K + 1)[:, None]
    none = m.sum(axis=0) == 0
    left = np.where(none, 1 / (count + 1.0), ((1 - d[:, None]) * r * m).sum(axis=0) / count)
    return np.log10(left / (1 - seen)), np.where(none, np.log10(count / (count + 1.0)), 0.0)


def _back_off(d: np.ndarray):
    """Backoff requests to weights, answered to each block in the order of its histories."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for cell, order, body in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "body"))):
                count, m, seen, of, block = unpack(body)
                back, _ = weights(d, count.astype(np.int64), m.reshape(K, -1).astype(np.int64), seen)
                starts = runs(block)
                yield _out([_row(WEIGHTS, int(block[a]), cell, order, pack(back[of[a:b]])) for a, b in zip(starts, np.append(starts[1:], len(of)))])

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(totals: Totals, cells: int, known: list[Known]):
    """Blocks with all answers to scores."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(it, ["block"]):
            x = _block(_of_unit(t), totals, cells, known, False)
            score = np.bincount(x.doc, weights=x.value, minlength=len(x.sizes))
            columns = [pa.array(x.doc_ids, mask=x.null), pa.array(x.held), *map(pa.array, (x.sizes, x.known, np.full(len(x.sizes), totals.tokens, np.int64), x.base, score))]
            yield pa.RecordBatch.from_arrays(columns, [y.split()[0] for y in RESULT.split(", ")])

    return run


def _known(summed: DataFrame) -> Known:
    """An order's discounts and frequent histories, of what its cells sum up to."""
    n, hot = np.zeros(K + 1, np.int64), {}
    for row in summed.where(F.col("kind") == STATS).collect():
        own, h, count, m, _, seen = unpack(row["body"])
        n += own
        for i, x in enumerate(h.tolist()):
            old = hot.get(x, (0, np.zeros(K, np.int64), 0.0))
            hot[x] = (int(count[i]), old[1] + m.reshape(K, -1)[:, i], old[2] + float(seen[i]))
    d = discounts(n)
    return Known(d, {x: tuple(float(y[0]) for y in weights(d, np.array([count]), m[:, None], np.array([seen]))) for x, (count, m, seen) in hot.items()})


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), by a model of n-grams
    of up to ``order`` (2 at least) tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    cells, of_task = CELLS * tasks, F.col("part") % tasks
    coded = written(slim.mapInArrow(_code(cells), ROW), "coded")
    lists = coded.where(F.col("kind") == LIST)
    answered = written(lists.repartitionById(tasks, of_task).sortWithinPartitions("part", "block").mapInArrow(_count, ROW), "words")
    train_docs = coded.where(F.col("kind") == DOCS).agg(F.sum("n")).first()[0] or 0
    totals = Totals(answered.where(F.col("kind") == STATS).collect(), train_docs, cells)

    rows = coded.where(F.col("kind") == DOCS).union(answered.where(F.col("kind") == ANSWER))
    known: list[Known] = []
    for k in range(2, order + 1):
        grams = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_grams(totals, cells, list(known)), ROW)
        summed = written(grams.repartitionById(tasks, of_task).sortWithinPartitions("part", "block").mapInArrow(_sum(totals, cells, k, order), ROW), "counts")
        known.append(_known(summed))
        weighed = summed.where(F.col("kind") == BACKOFF).mapInArrow(_back_off(known[-1].d), ROW)
        rows = rows.union(summed.where(F.col("kind") == COUNTS)).union(weighed)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_finish(totals, cells, known), RESULT)
