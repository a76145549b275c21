"""The methods behind the operators: frames that are no scans, skew, seeds, orders, verification, lookups, bad bytes."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import common, exact_dedup, katz_lm, mixing, ngram_join, packing, quality_rules, sentencepiece_codec, shingles, suffix_dedup, token_store
from pathloom.llm.components import components

SPM, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def twice(spark, docs):
    """Every document two times, above a join: the physical keys of its rows repeat."""
    return docs.join(F.broadcast(spark.range(2).withColumnRenamed("id", "copy")))


def test_row_keys_above_joins(spark, docs, twice, texts):
    n = docs.count()
    exact = exact_dedup.label(twice)
    groups = docs.select(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")).distinct().count()
    assert exact.count() == 2 * n and exact.where("kept").count() == groups == exact_dedup.keep(twice).count()
    rows = suffix_dedup.summary(twice).collect()
    # each byte of a text that is there twice goes, if it is long enough
    assert len(rows) == 2 * n and all(r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0) for r in rows)
    taken = mixing.taken(mixing.mix(twice)).collect()
    assert len(taken) == 2 * n and all(r.taken <= 3 * r.size for r in taken)
    joined = Counter(r.component_id for r in ngram_join.label(twice).where("n_shingles > 0").collect())
    assert sum(joined.values()) == 2 * sum(bool(t.split()) for t in texts.values()) and not any(k % 2 for k in joined.values())
    keyed = common.with_row_key(twice, "f", "r")
    assert keyed.select("f", "r").distinct().count() == 2 * n
    exploded = docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))
    assert common.with_row_key(exploded, "f", "r").select("f", "r").distinct().count() == 2 * n


def test_exact_dedup_of_large_groups(spark, monkeypatch):
    rows = [(i, "same  text" if i % 3 else f"text {i}") for i in range(300)] + [(None, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shape = lambda: sorted(map(repr, exact_dedup.label(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    plain = shape()
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 1)
    assert shape() == plain
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 7)
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 20)
    assert shape() == plain


def test_suffix_dedup_with_small_buckets(spark, monkeypatch):
    """Many buckets, cut inside groups, give the same spans as few."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = [word(500), word(700)]
    rows = [(i, word(200) + shared[i % 2] + word(300)) for i in range(60)] + [(100 + i, shared[0][i : 450 + i]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shape = lambda: {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in suffix_dedup.summary(df).collect()}
    plain = shape()
    assert all(plain[i] for i in range(60))
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 10)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_CUTS", 0)
    assert shape() == plain


def test_sentencepiece_against_itself(spark, sf_dir, docs, texts):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=SPM)
    for r in sentencepiece_codec.summary(docs, SPM).collect():
        ids = own.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()


def test_sentencepiece_oddities():
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=SPM)
    odd = ["", " ", "  a  b ", "x\n\n y\t", "é▁x ▁", "日本 \U0001f600\U0001f601", "\u0000 z", "a" * 3000, " lead", "trail  ", "<0x41> </s> <unk>"]
    for threads in (1, 2):
        codec = sentencepiece_codec.Codec(SPM, threads)
        found = list(codec.checked([t.encode() for t in odd]))
        assert [np.frombuffer(x, "<i4").tolist() for x, _ in found] == [own.encode(t) for t in odd] and all(same for _, same in found)
        assert [t.decode() for t in codec.decode([x for x, _ in found])] == [own.decode(own.encode(t)) for t in odd]


def test_sentencepiece_decodes_by_batch():
    """Of byte runs only distinct ones that aren't ASCII are decoded, whatever the rows; runs end where texts do."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=SPM)
    codec = sentencepiece_codec.Codec(SPM, 2)
    texts = ["one\n\ttwo \U0001f600 three\n", "\U0001f601", "", "\U0001f600 \U0001f600", "\n"] * 200
    ids = [np.array(own.encode(t), "<i4").tobytes() for t in texts]
    byte = {b: own.piece_to_id(f"<0x{b:02X}>") for b in (0xC3, 0xA9, 0x0A)}
    odd = [[byte[0xC3]], [byte[0xA9]], [byte[0xC3], byte[0xA9]], [byte[0x0A]] * 2]
    codec.decode([])
    seen, decoded = [], codec._decoded
    codec._decoded = lambda many: seen.extend(many) or decoded(many)
    many = [*ids, *(np.array(x, "<i4").tobytes() for x in odd)]
    assert [t.decode() for t in codec.decode(many)] == [own.decode(np.frombuffer(x, "<i4").tolist()) for x in many]
    assert len(seen) == len({*map(tuple, seen)}) <= 12 and all(max(x) > byte[0x0A] for x in seen)
    assert [*codec.encode([t.encode() for t in texts])] == ids and codec.encode([]) == [] and codec.encode([b"", b""]) == [b"", b""]


def test_bytes_that_are_no_utf8(spark):
    raw = [(1, b"caf\xe9 au lait"), (2, b"\xff\xfe\xfd"), (3, "café au lait".encode()), (4, b"ok " * 200 + b"\x80")]
    df = spark.createDataFrame(raw, "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("s").alias("source"), F.lit(3).alias("n_chars"))
    rows = {r.doc_id: r for r in sentencepiece_codec.summary(df, SPM).collect()}
    assert all(r.parity for r in rows.values()) and [rows[i].roundtrip for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert len(sentencepiece_codec.encode(df, SPM).select("doc_id", "token_ids").collect()) == 4
    assert len(token_store.read_store(spark, *token_store.write_store(df, BPE)).collect()) == 4
    assert mixing.apply(df).select("doc_id", "n_chars").count() == len(raw)
    for f in (exact_dedup.label, suffix_dedup.summary, ngram_join.label, quality_rules.measure, katz_lm.score):
        assert f(df).count() == len(raw)


def test_mix_by_shards(docs):
    """Another seed changes what a shard holds, not what sources give; shards are full, and blocks have their length."""
    options = {"length": 64, "shard_slots": 128}
    by_seed = {}
    for seed in (7, 8):
        mixed = mixing.mix(docs, seed=seed, **options)
        counts = mixing.counts(mixed).collect()
        total, slots = Counter(), Counter()
        for r in counts:
            total[r.source] += r.words
            slots[r.shard] += r.slots
        assert all(n == 128 for s, n in slots.items() if s < max(slots)) and sorted(slots) == list(range(len(slots)))
        by_seed[seed] = total, {(r.shard, r.source): r.slots for r in counts}
    assert by_seed[7][0] == by_seed[8][0] and by_seed[7][1] != by_seed[8][1]
    whole = Counter(r.n_words for r in mixing.blocks(docs, **options).collect())
    assert whole[64] > 0.9 * sum(whole.values()) and max(whole) == 64
    assert sum(n * k for n, k in whole.items()) == sum(by_seed[7][0].values())
    shards = {s for r in mixing.taken(mixing.mix(docs, **options)).collect() for s in r.shards}
    assert shards == {s for s, _ in by_seed[7][1]}


def _good_turing(counts):
    of = Counter(counts)
    n = [of[r] for r in range(1, 7)]
    plain = {r: (r - 0.5) / r for r in range(1, 6)}
    if 0 in n or 6 * n[5] / n[0] >= 1:
        return plain
    common_ = 6 * n[5] / n[0]
    d = {r: ((r + 1) * n[r] / (r * n[r - 1]) - common_) / (1 - common_) for r in range(1, 6)}
    return {r: d[r] if 0 < d[r] < 1 else plain[r] for r in d}


def _katz(tokens, held, order):
    """Probabilities of a Katz model, by definition: p(word, history)."""
    grams = [None] + [Counter() for _ in range(order)]
    for i, t in tokens.items():
        if not held[i]:
            padded = ["<s>", *t]
            for at in range(1, len(padded)):
                grams[1][(padded[at],)] += 1
                for k in range(2, order + 1):
                    if at - k + 1 >= 0:
                        grams[k][tuple(padded[at - k + 1 : at + 1])] += 1
    total, d = sum(grams[1].values()), [None, *(_good_turing(g.values()) for g in grams[1:])]
    unknown = 1 - sum(d[1].get(r, 1) * r for r in grams[1].values()) / total
    after, seen = [None, *(Counter() for _ in grams[1:])], [None, *(defaultdict(list) for _ in grams[1:])]
    for k in range(2, order + 1):
        for g, r in grams[k].items():
            after[k][g[:-1]] += r
            seen[k][g[:-1]].append((g[-1], r))

    back = {}

    def p(w, h):
        if not h:
            c = grams[1][(w,)]
            return d[1].get(c, 1) * c / total if c else unknown
        k, n = len(h) + 1, after[len(h) + 1][h]
        if not n:
            return p(w, h[1:])
        scale = 1.0 if any(r <= 5 for _, r in seen[k][h]) else n / (n + 1)
        c = grams[k][(*h, w)]
        if c:
            return scale * d[k].get(c, 1) * c / n
        if h not in back:
            left = 1 - sum(scale * d[k].get(r, 1) * r / n for _, r in seen[k][h])
            back[h] = left / (1 - sum(p(x, h[1:]) for x, _ in seen[k][h]))
        return back[h] * p(w, h[1:])

    return p, grams


@pytest.mark.parametrize("order", [2, 4])
def test_katz_orders(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(150 + i, rows[i][1]) for i in range(10)] + [(None, "w1 w2"), (400, None)]
    tokens = {i: [*(t or "").split(), "</s>"] for i, t in rows}
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in tokens}
    p, grams = _katz(tokens, held, order)
    for h in [(), ("<s>",), *[g[:-1] for g in list(grams[order])[:15]]]:
        assert sum(p(w, h) for (w,) in grams[1]) + p("<unknown>", h) == pytest.approx(1)
    for r in katz_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order).collect():
        padded = ["<s>", *tokens[r.doc_id]]
        expected = sum(math.log10(p(padded[at], tuple(padded[max(0, at - order + 1) : at]))) for at in range(1, len(padded)))
        assert r.score == pytest.approx(expected), r.doc_id


def test_no_pair_is_verified_twice(docs, monkeypatch):
    asked = []
    true = ngram_join._verified

    def spy(pairs, bodies, rule):
        asked.extend(tuple(sorted(map(bytes, r))) for r in pairs.select("a", "b").collect())
        return true(pairs, bodies, rule)

    monkeypatch.setattr(ngram_join, "_verified", spy)
    ngram_join.label(docs, ngram_join.Rule(3, 90, block=3)).count()
    assert asked and max(Counter(asked).values()) == 1


def test_frequent_tokens_and_zones(spark, monkeypatch):
    """Salts, zones and blocks of n-grams that all documents share change nothing."""
    rng = random.Random(2)
    stock = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(stock[: 20 + rng.randint(0, 40)] + [f"u{i}"] * rng.randint(0, 2))) for i in range(120)] + [(200 + i, f"a{i} b{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(max(1, len(t.split()) - 2))} for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    for frequent, tables, block in ((4, 100_000, 5), (4, 0, 5)):
        monkeypatch.setattr(ngram_join, "FREQUENT_ROWS", frequent)
        monkeypatch.setattr(ngram_join, "BROADCAST_TOKENS", tables)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.label(df, ngram_join.Rule(3, 90, block=block)).collect()}
        assert got == {i: (len(sets[i]), root[i]) for i in sets}, (frequent, tables, block)


def test_components(spark, monkeypatch):
    from pathloom.llm import components as module

    key = lambda x: b"%06d" % x
    links = [(key(0), key(i)) for i in range(1, 40)] + [(key(i), key(i + 1)) for i in range(100, 140)] + [(key(7), key(7)), (key(900), key(900)), (None, key(3)), (key(5), key(0))]
    df = spark.createDataFrame(links, "a binary, b binary")
    expected = {**{key(i): key(0) for i in range(40)}, **{key(i): key(100) for i in range(100, 141)}, key(900): key(900)}
    for hub in (1000, 3):
        monkeypatch.setattr(module, "HUB_LINKS", hub)
        found = [(bytes(r.node), bytes(r.root)) for r in components(df).collect()]
        assert len(found) == len(dict(found)) and dict(found) == expected
    assert components(df.limit(0)).collect() == []


def test_units_and_packing():
    keys = [[1, 1, 2], [2], [], [2, 3, 3], [3], [4]]
    batches = [pa.record_batch({"k": pa.array(k, pa.int64()), "n": pa.array([i] * len(k), pa.int64())}) for i, k in enumerate(keys)]
    got = [t.column("k").to_pylist() for t in packing.units(iter(batches), ["k"])]
    assert got == [[1, 1], [2, 2, 2], [3, 3, 3], [4]] and list(packing.units(iter([]), ["k"])) == []
    arrays = [np.zeros(0, np.int64), np.arange(300), np.array([-1, 2**62]), np.array([0.5, -2.0])]
    back = packing.unpack(packing.pack(*map(np.asarray, arrays)))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back))
    assert [packing.narrow(np.array([x])).dtype.itemsize for x in (0, 256, 65536, 1 << 40)] == [1, 2, 4, 8]


def test_shingles(texts):
    raw = [t.encode() for t in list(texts.values())[:200]] + [b"", b" \t", b"One", b"one two", b"\xff \x00"]
    for n in (1, 3, 5):
        for t, s in zip(raw, shingles.sets(raw, n)):
            w = t.lower().split()
            assert len(s) == (len(set(zip(*(w[i:] for i in range(n))))) if len(w) >= n else bool(w))
    a, b, c = shingles.sets([b"A b C d", b"x a B c D", b"a b"], 3)
    assert len(np.intersect1d(a, b)) == 2 and not len(np.intersect1d(a, c))


def test_quality_bands_by_definition(texts):
    """Every verdict, by the stated limits: whole texts, chunks, both sides."""
    bands, z = quality_rules.Bands(), zstandard.ZstdCompressor(level=3)

    def least(n):
        return next((r for below, r in bands.least if n < below), bands.least_beyond)

    def most(n):
        return float(np.interp(np.log(n), np.log([at for at, _ in bands.most]), [r for _, r in bands.most]))

    def good(t):
        if not t:
            return False
        ratio = len(t) / len(z.compress(t))
        if not least(len(t)) <= ratio <= most(len(t)):
            return False
        parts = [t[i : i + bands.chunk] for i in range(0, len(t), bands.chunk)]
        parts = [p for p in parts if len(p) >= bands.least_length] if len(t) > bands.chunk else []
        bad = 0
        for p in parts:
            r = len(p) / len(z.compress(p))
            bad += not least(len(p)) <= r <= most(len(p))
        return bad <= bands.chunk_share * len(parts)

    rng = random.Random(1)
    raw = [t.encode() for t in texts.values()] + [rng.randbytes(n).hex().encode() for n in (300, 5000, 20000)]
    raw += [(b"loop of a phrase " * 400), bytes(rng.choices(b"abcdefghijklmnop qrstuvw", k=9000)), b"".join(raw[:40])]
    for row, t in zip(quality_rules._judge(raw, bands), raw):
        assert row[6] == (good(t) and not row[5])


def test_quality_bands_decide(spark, sf_dir):
    """Of what labels call bad and the base rules pass, the bands reject half at least, and nothing that they call good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    passed = quality_rules.measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    count = {(r.quality, r.kept): r["count"] for r in passed.groupBy("quality", "kept").count().collect()}
    assert (1, False) not in count and count[0, False] >= count.get((0, True), 0)


def test_quality_limits_are_fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = labels.where("quality = 1")
    wide = quality_rules.Bands(most=((256, 9.0), (1024, 9.0), (4096, 9.0), (16384, 9.0)))
    fitted = quality_rules.fit(docs, good, wide)
    found = [r for _, r in fitted.most if r != 9.0]
    assert found and all(1.5 < r < 2.7 for r in found) and fitted.most == quality_rules.fit(docs, good, wide).most
    assert quality_rules.measure(docs, fitted).where("not base_failed and not kept").join(good, "doc_id").count() <= 2
    assert quality_rules.fit(docs, good, wide, rows=10).most == wide.most  # too few to fit anything


def test_store_lookups(spark, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_BYTES", 5000)
    rows = [(i * 7, f"word{i} and more") for i in range(2000)] + [(14, "again"), (None, "without"), (-3, "negative")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder, manifest = token_store.write_store(df, BPE)
    assert len(manifest) > 3
    read = token_store.read_store(spark, folder, manifest).orderBy("start").collect()
    ids = [r.doc_id for r in read]
    assert ids == [-3, *sorted(r[0] for r in rows[:2000] + [(14,)]), None] and [r.start for r in read] == [sum(x.n_tokens for x in read[:i]) for i in range(len(read))]
    with token_store.Store(folder, manifest, most_open=2) as store:
        assert len(store.get(14)) == 2 and len(store.get(None)) == 1 and len(store.get(-3)) == 1
        assert all(len(store.get(i)) == 1 for i in range(21, 14000, 7)) and len(store.open) <= 2
        assert not any(store.get(i) for i in range(-50, 14050) if i % 7 and i != -3)
    index = token_store.build_index(np.array([5, 9, 2**40, -8]), np.arange(4), np.ones(4, int))
    assert sorted(index.find(np.array([5, 9, 2**40, -8])).tolist()) == [0, 1, 2, 3] and (index.find(np.array([1, 2, 3])) == -1).all()


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_tables_are_swept(spark, docs):
    before = len(common.WRITTEN)
    table = common.written(docs.limit(3), "some")
    assert table.count() == 3 and len(common.WRITTEN) == before + 1
    common.discard(table)
    assert len(common.WRITTEN) == before
