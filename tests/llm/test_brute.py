"""The operators against brute force over whole small tables, and against SQL where there is some."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from pathloom.llm import chat_format, exact_dedup, katz_lm, license_scan, mixing, ngram_join, quality_rules, suffix_dedup, token_store
from pathloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, expected = QUERIES[name](spark, sf_dir).toArrow(), con.sql(SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(expected.column_names)
    rows = lambda t: sorted(repr(tuple(r[c] for c in names)) for r in t.to_pylist())
    assert rows(got) == rows(expected)


def _repeats(raw):
    """Per document: bytes, bytes that go, runs of them, digest of the rest."""
    places = defaultdict(list)
    for i, t in raw.items():
        for j in range(len(t) - 399):
            places[t[j : j + 400]].append((i, j))
    gone = {i: np.zeros(len(t), bool) for i, t in raw.items()}
    for found in places.values():
        if len(found) > 1:
            for i, j in found:
                gone[i][j : j + 400] = True
    runs = lambda g: int((np.diff(np.concatenate([[0], g.astype(int), [0]])) == 1).sum())
    return {i: (len(g), int(g.sum()), runs(g), hashlib.sha256(np.frombuffer(raw[i], np.uint8)[~g].tobytes()).hexdigest()) for i, g in gone.items()}


def test_suffix_dedup(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()}
    assert got == _repeats({i: t.encode() for i, t in texts.items()})


def test_suffix_dedup_crowds(spark, monkeypatch):
    """Crowded leading tokens take another path to the same result."""
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 123, n)).decode()
    shared = word(900)
    rows = [(i, word(300) + shared + word(300)) for i in range(12)] + [(100, word(500)), (101, shared[:420]), (102, "ab" * 400), (103, "z" * 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = _repeats({i: t.encode() for i, t in rows})
    for crowd in (256, 2):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.summary(df).collect()} == expected


def _passages(texts):
    """Per document: words in strings of 51 words that also start anywhere else."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) for i, t in texts.items()}
    places = defaultdict(list)
    for i, w in words.items():
        for j in range(len(w) - 50):
            places[tuple(w[j : j + 51])].append((i, j))
    inside = defaultdict(set)
    for found in places.values():
        for i, j in found if len(found) > 1 else ():
            inside[i].update(range(j, j + 51))
    return {i: len(inside[i]) for i in texts}


def test_suffix_dedup_passages(spark, sf_dir, texts):
    got = {r.doc_id: r.n_passage_words for r in QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()}
    assert got == _passages(texts) and any(got.values())


def test_suffix_dedup_short_passages(spark):
    """Passages of over 50 words count as such under 400 bytes, too, where no byte of them goes."""
    rng = np.random.default_rng(5)
    words = lambda n: ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n)]
    over, under, twice = words(51), words(50), words(55)
    texts = {i: " ".join(words(20 + i) + over + words(30)) for i in range(6)}
    texts |= {10 + i: " ".join(words(20 + i) + under + words(30)) for i in range(6)}
    texts |= {20: "\n".join(twice + words(9) + twice), 21: "  ".join(over).upper(), 22: " ".join(over[:50]), 23: "é " * 60, 24: "", 25: " ".join(words(300))}
    df = spark.createDataFrame([*texts.items(), (26, None)], "doc_id long, text string")
    expected = _passages(texts) | {26: 0}
    assert [expected[i] for i in (0, 10, 20, 21, 22, 23, 25)] == [51, 0, 110, 51, 0, 60, 0]
    rows = {r.doc_id: r for r in suffix_dedup.summary(df).collect()}
    assert {i: r.n_passage_words for i, r in rows.items()} == expected
    assert not any(r.n_removed for r in rows.values())


def test_word_codes_in_pieces(texts, monkeypatch):
    """Codes follow the words, wherever texts are cut to be hashed."""
    raw = [t.encode() for t in texts.values()] + [b"", b" \n", b"A" * 5000 + b" b"]
    plain = suffix_dedup.word_codes(raw)
    assert [len(c) // suffix_dedup.CODE for c in plain] == [len(t.split()) for t in raw]
    for piece in (1, 700):
        monkeypatch.setattr(suffix_dedup, "SLICE", piece)
        assert suffix_dedup.word_codes(raw) == plain


def test_token_store(spark, sf_dir, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, {}
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [1]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_store"](spark, sf_dir).collect()}
    assert got == expected
    folder, manifest = token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"))
    store = token_store.Store(folder, manifest)
    for i in list(texts)[::17]:
        (ids,) = store.get(i)
        assert len(ids) == expected[i][1] and zlib.crc32(ids.astype("<u4").tobytes()) == expected[i][2]
    assert store.get(10**9) == [] and store.get(None) == []


def test_encoder_words():
    e = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ǅ é ́x ΑΣ ΑΣΑ", "it's 12a b\u0085c éa ÀÉ, Ÿ ÿ. ª º ×a Kß ﬁ", "", " \t\n", "x" * 5000, "(a) b!!! ...c &#$", "日本語 テスト"]
    raw = [t.encode() for t in odd]
    assert e.by_word and e.direct and e.encode(raw) == e.packed(raw)


def test_sentencepiece(spark, sf_dir):
    rows = QUERIES["op4_sentencepiece"](spark, sf_dir).collect()
    assert all(r.parity and r.roundtrip for r in rows)


def test_mixing(spark, sf_dir, docs, texts):
    rows = QUERIES["op5_mixing"](spark, sf_dir).collect()
    again = {r.doc_id: r.taken for r in QUERIES["op5_mixing"](spark, sf_dir).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, goal = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and r.taken <= 3 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert all(r.source_size == size[source[r.doc_id]] for r in rows)
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, float(3 * sum(size.values()))  # words per weight, found by halving: each source gets them, at most 3 times its size
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 3 * size[s]) for s in size) < sum(size.values()) else (low, mid)
    assert goal == pytest.approx({s: min(low * weight[s], 3 * size[s]) for s in size}) and sum(goal.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_license_scan(spark, sf_dir, texts):
    for r in QUERIES["op6_license_scan"](spark, sf_dir).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), texts[r.doc_id]))
        found = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_license_labels(spark, sf_dir, texts):
    """Labels of templates, as regular expressions over words say them."""
    rules = []
    for label, markup in license_scan.TEMPLATES:
        rule = re.sub(r"\s*\[\[(.*?)\]\]", lambda m: "(?:" + "".join(rf" {w}" for w in m.group(1).split()) + ")?", " " + markup)
        rule = re.sub(r"\s*\{(\d+)\}", r"(?: [^ ]+){0,\1}", rule)
        rules.append((label, re.compile(rule + "(?= |$)")))
    extra = {-1: "x released under the terms of the mit license y", -2: "licensed under cc by nc sa 4 0", -3: "licensed under cc by a b c 4 0", -4: "this is my tool is licensed under the gnu general public license version 2 or 3"}
    df = spark.createDataFrame([*extra.items()], "doc_id long, text string")
    rows = QUERIES["op6_license_scan"](spark, sf_dir).collect() + license_scan.scan(df).collect()
    found = 0
    for r in rows:
        joined = "".join(" " + w.decode() for w in license_scan.words((texts | extra)[r.doc_id].encode()))
        expected = {label for label, rule in rules if rule.search(joined)}
        assert set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(","))) == expected, r.doc_id
        found += bool(expected)
    assert found > len(extra) - 1


def _links(texts, words, percent):
    shingles = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        shingles[i] = set(zip(*(w[j:] for j in range(words)))) if len(w) >= words else {tuple(w)} if w else set()
    linked, index = defaultdict(set), defaultdict(list)
    for i in sorted(shingles):
        for j, n in Counter(j for g in shingles[i] for j in index[g]).items():
            if 100 * n >= percent * (len(shingles[i]) + len(shingles[j]) - n):
                linked[i].add(j)
                linked[j].add(i)
        for g in shingles[i]:
            index[g].append(i)
    root = {}
    for i in sorted(shingles):
        todo = [] if i in root else [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo.extend(linked[x])
    return {i: (len(s), root[i]) for i, s in shingles.items()}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, texts, words, percent):
    rule = ngram_join.Rule(words, percent, block=3)  # small units, so that blocks meet
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.label(docs, rule).collect()}
    assert got == _links(texts, words, percent)


def test_near_copies_chain(spark):
    """A chain of copies, each linked with the next only, is one component; its ends are not alike."""
    words = [f"w{i}" for i in range(130)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(20)] + [(100, "alone and short"), (101, "x y z " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.label(df, ngram_join.Rule(3, 90, block=2)).collect()}
    assert got == {i: c for i, (_, c) in _links(dict(rows), 3, 90).items()}


def test_quality_rules(spark, sf_dir, texts):
    z = zstandard.ZstdCompressor(level=3)
    bands = quality_rules.Bands()
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(tri)
        rep = {i + k for i, g in enumerate(tri) if many[g] > 1 for k in range(3)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        assert not (r.kept and r.base_failed)
        if r.kept:
            assert len(t.encode()) / len(z.compress(t.encode())) <= bands.upper(len(t.encode()))


def test_quality_keeps_what_labels_call_good(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    kept = quality_rules.measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(good, "doc_id")
    assert kept.where("not kept and not base_failed").count() == 0


def test_katz(spark, sf_dir, texts):
    tokens = {i: [*t.encode().lower().split(), b"</s>"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c, pairs, after = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            c.update(t)
            pairs.update(zip(["<s>", *t[:-1]], t))
            after.update(["<s>", *t[:-1]])
    n, v = sum(c.values()), len(c)

    def discounts(counts):
        of = Counter(counts.values())
        d = katz_lm.discounts(np.array([of[r] for r in range(1, 7)]))
        return lambda r: d[r - 1] if r <= 5 else 1.0

    d1, d2 = discounts(c), discounts(pairs)
    unknown = 1 - sum(d1(r) * r for r in c.values()) / n
    uni = lambda w: d1(c[w]) * c[w] / n if c[w] else unknown
    follow = defaultdict(list)
    for (h, w), r in pairs.items():
        follow[h].append((w, r))
    scale = {h: 1.0 if any(r <= 5 for _, r in x) else after[h] / (after[h] + 1) for h, x in follow.items()}
    back = {h: (1 - scale[h] * sum(d2(r) * r for _, r in x) / after[h]) / (1 - sum(uni(w) for w, _ in x)) for h, x in follow.items()}

    def p(w, h):
        if not after[h]:
            return uni(w)
        r = pairs[h, w]
        return scale[h] * d2(r) * r / after[h] if r else back[h] * uni(w)

    for h in ["<s>", *list(follow)[:20]]:
        assert sum(p(w, h) for w in c) + p("<unk>", h) == pytest.approx(1)
    for r in QUERIES["op10_katz_lm"](spark, sf_dir).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(w, h)) for h, w in zip(["<s>", *t[:-1]], t)))


def test_exact_dedup_trees(docs):
    """Any fan-in gives the same groups."""
    rows = lambda f: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.label(docs.repartition(9), f).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert rows(2) == rows(16)


def test_chat_layouts(spark):
    records = [
        (1, '{"prompt": "p <x>", "response": "r\\\\b"}'),
        (2, '{"instruction": "i", "input": "", "output": "o", "other": 3}'),
        (3, '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "</turn>"}, {"role": "assistant", "content": "a"}]}'),
        (4, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}'),
        (5, '{"strange": 1}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    turns = chat_format.canonical_json(df, "record")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.render(turns).select("conv_id", chat_format.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {
        1: [("user", "p <x>"), ("assistant", "r\\b")],
        2: [("user", "i"), ("assistant", "o")],
        3: [("system", "s"), ("user", "</turn>"), ("assistant", "a")],
        4: [("user", "h"), ("assistant", "g")],
    }
    typed = spark.createDataFrame([(7, [("user", "x"), ("assistant", "y")])], "conv_id long, messages array<struct<role: string, content: string>>")
    assert [(r.turn, r.role, r.text) for r in chat_format.canonical(typed).collect()] == [(0, "user", "x"), (1, "assistant", "y")]
    with pytest.raises(ValueError):
        chat_format.canonical(df.select("conv_id"))
