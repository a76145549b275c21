"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import base64
import json
import random
import re
import string

import public_tokenizers
import pytest

import corpus_pipeline
from pathloom.llm import chat_format, exact_dedup, katz_lm, license_scan, mixing, ngram_join, quality_rules, sentencepiece_codec, suffix_dedup, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, file string, row long, kept boolean, token_ids string, part int"
LONG = "lorem ipsum dolor sit amet " * 9000
ROWS = [
    (1, "a b c", "en", "s", 5, "f", 1, True, "x", 0),
    (1, "a b c", "en", "s", 5, "f", 1, True, "x", 0),
    (2, " a b c ", "en", None, 7, None, None, None, None, None),
    (None, "abc", None, None, None, "f", 2, False, None, 1),
    (3, None, "en", "s", None, "g", 3, True, "y", 2),
    (4, "", "en", "t", 0, "g", 4, True, "y", 2),
    (5, LONG, "en", "s", len(LONG), "h", 5, True, "z", 3),
    (6, "éß \U0001f600 \u0000 x" * 30, "de", "t", 1, "h", 6, True, "z", 3),
]
SPM, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def _store(df):
    return token_store.read_store(df.sparkSession, *token_store.write_store(df, BPE))


PER_ROW = {
    "exact_dedup": exact_dedup.label,
    "suffix_dedup": suffix_dedup.summary,
    "token_store": _store,
    "sentencepiece": lambda d: sentencepiece_codec.summary(d, SPM),
    "encode": lambda d: sentencepiece_codec.encode(d, SPM),
    "mixing": lambda d: mixing.taken(mixing.mix(d)),
    "license_scan": license_scan.scan,
    "ngram_join": ngram_join.label,
    "quality_rules": quality_rules.measure,
    "katz": katz_lm.score,
    "remove": suffix_dedup.remove,
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", list(PER_ROW))
def test_one_row_per_document(odd, name):
    rows = PER_ROW[name](odd).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", list(PER_ROW))
def test_empty(odd, name):
    assert PER_ROW[name](odd.limit(0)).collect() == []


def test_exact_dedup(odd):
    rows = exact_dedup.label(odd).collect()
    same = [r for r in rows if r.text_sha256 == rows[[x.doc_id for x in rows].index(2)].text_sha256]
    assert {r.group_size for r in same} == {4} and {r.keep_id for r in same} == {2}  # most code points
    assert sum(r.kept for r in same) == 1
    kept = exact_dedup.keep(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "6"]


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(9, "same"), (9, "same"), (None, "same")], "doc_id long, text string")
    assert sorted((r.keep_id, r.group_size, r.kept) for r in exact_dedup.label(df).collect()) == [(9, 3, False), (9, 3, False), (9, 3, True)]
    assert exact_dedup.keep(df).count() == 1


def test_ngram_join(odd):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.label(odd).collect())
    assert [x for x in got if x[0] in ("1", "2", "3", "4", "None")] == [("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 0, "3"), ("4", 0, "4"), ("None", 1, "None")]
    kept = ngram_join.keep(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "None"]


def test_token_store(odd):
    rows = {(r.doc_id, r.start): r for r in _store(odd).collect()}
    starts = sorted(s for _, s in rows)
    assert starts[0] == 0 and all(rows[k].n_tokens == 1 for k in rows if k[0] in (3, 4))
    assert max(rows, key=lambda k: k[1])[0] is None  # a null id comes last
    folder, manifest = token_store.write_store(odd, BPE)
    store = token_store.Store(folder, manifest)
    assert len(store.get(1)) == 2 and len(store.get(None)) == 1 and store.get(77) == []


def test_katz_without_training(spark):
    import zlib

    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = katz_lm.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(True, 3, 0, 0, 0.0, 0.0)}


def test_quality_rules(odd):
    rows = {r.doc_id: r for r in quality_rules.measure(odd).collect()}
    assert not any(r.kept for r in rows.values()) and rows[3].n_words == 0 and rows[5].n_words == 45000
    assert quality_rules.keep(odd).columns == odd.columns


def test_mixing(odd):
    rows = mixing.taken(mixing.mix(odd)).collect()
    assert all(r.taken <= 3 * r.size for r in rows) and all(r.taken == 0 for r in rows if r.doc_id in (3, 4))
    mixed = mixing.apply(odd, length=64)
    assert mixed.columns == odd.columns
    assert sum(len(r.text.encode().split()) for r in mixed.collect()) == sum(r.taken for r in mixing.taken(mixing.mix(odd, length=64)).collect())


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "a\\<>"), (2, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", chat_format.F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.canonical(df))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 0), None: (1, 4), 2: (1, 0)}
    assert chat_format.read_back(chat_format.render(df.limit(0))).collect() == []


def test_templates():
    a = license_scan.compile_template("x", "copyright {2} by [[the]] holder")
    t = lambda s: a.accepts_at(license_scan.words(s.encode()), 0)
    assert t("Copyright 2020 ACME by the holder") == 6 and t("copyright by holder") == 3
    assert t("copyright 1 2 3 by holder") is None and t("copyright by a holder") is None
    with pytest.raises(ValueError):
        license_scan.compile_template("x", "[[ a b")


def test_pipeline_stages(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns
        assert stage(spark, odd.limit(0), "").collect() == []


def test_every_license_template_matches():
    filled = {"[[this {4} is]] ": "this small piece of software is ", "{2}": "2 0", "{1}": "3"}
    automata = [license_scan.compile_template(*t) for t in license_scan.TEMPLATES]
    for (label, markup), a in zip(license_scan.TEMPLATES, automata):
        with_all = markup
        for mark, words in filled.items():
            with_all = with_all.replace(mark, words)
        with_all = with_all.replace("[[", "").replace("]]", "")
        bare = " ".join(re.sub(r"\[\[.*?\]\]|\{\d+\}", " ", markup).split())
        for text in (with_all, bare):
            n = len(text.split())
            assert license_scan.scan_text(f"before it {text} after it".encode(), [a])[7] == [(label, 2, 2 + n)], text
            assert license_scan.scan_text(text.rsplit(None, 1)[0].encode(), [a])[7] == [] or markup.endswith("]]"), text
    found = license_scan.scan_text(b"Licensed under a CC BY ND 4.0; licensed under the terms of the MIT license", automata)
    assert found[5] == "cc-by,cc-by-notice,mit,mit-notice"


def _random_text(kind, n, rng):
    if kind == "base64 lines":
        return re.sub(r"(.{76})", r"\1\n", base64.b64encode(rng.randbytes(n)).decode())[:n]
    if kind == "base64 words":
        return re.sub(r"(.{6})", r"\1 ", base64.b64encode(rng.randbytes(n)).decode())[:n]
    chars = {"printable": string.printable[:94] + " " * 12, "alphanumeric": string.ascii_letters + string.digits + " " * 10, "cjk": [chr(c) for c in range(0x4E00, 0x9FA6)] + [" "] * 3000}[kind]
    return "".join(rng.choices(chars, k=n // 3 if kind == "cjk" else n))


@pytest.mark.parametrize("kind", ["base64 lines", "base64 words", "printable", "alphanumeric", "cjk"])
def test_random_text_is_rejected(spark, kind):
    rng = random.Random(5)
    texts = [_random_text(kind, n, rng) for n in (600, 1000, 2000, 4000, 7600, 30000, 100000) for _ in range(5)]
    texts = [t for t in texts if len(t.split()) >= 50]
    assert len(texts) >= 15
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.base_failed, r.kept) for r in quality_rules.measure(df).collect()] == [(False, False)] * len(texts)
    assert quality_rules.keep(df).count() == 0


def test_mostly_random_chunks_are_rejected():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(4000)]  # as rich as prose; 300 words compress like a table
    prose = " ".join(rng.choices(vocabulary, k=30_000)).encode()
    dump = _random_text("base64 lines", 6 * len(prose) // 5, rng).encode()
    bands = quality_rules.Bands()
    counted = quality_rules._judge([dump + prose], bands)[0]
    # the whole text alone is inside the bands
    assert counted[5:7] == (False, False) and bands.lower(len(dump + prose)) < counted[7] < bands.upper(len(dump + prose))
    assert quality_rules._judge([prose], bands)[0][6]


def test_json_records_are_not_lost(spark):
    turns = [("user", "q"), ("assistant", "a")]
    cases = [
        ({"prompt": "[INST] hi", "response": "x"}, [("user", "[INST] hi"), ("assistant", "x")]),
        ({"prompt": '["a"]', "response": '[{"role": "x"}]'}, [("user", '["a"]'), ("assistant", '[{"role": "x"}]')]),
        ({"prompt": "q", "response": "a", "text": "t", "role": "r", "turn": 3}, turns),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "text": "[", "tags": ["b"]}, turns),
        ({"instruction": "q", "output": "a", "meta": [1, [2]]}, turns),
        ({"prompt": [{"role": "user"}], "response": "x"}, None),
        ({"messages": ["q", "a"]}, None),
        ({"strange": "[1"}, None),
        ({"messages": []}, None),
        ({"prompt": None, "response": None}, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(100, "{not json"), (101, None)]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {}
    for r in chat_format.canonical_json(df, "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: t for i, (_, t) in enumerate(cases) if t}
    left = {r.conv_id: (r.record, r.known_layout) for r in chat_format.unmapped_json(df, "record").collect()}
    assert left == {i: (text, i == 9) for i, text in rows if i not in got}


def test_mix_reaches_targets_of_other_caps(spark):
    # the small source's target is 5 times its size
    rows = [(i, "w " * 40, "b") for i in range(5)] + [(100 + i, "w " * 40, "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(df, length=16, most=5, weights=(1, 2))).collect()
    words = {s: sum(r.taken for r in got if (r.doc_id >= 100) == (s == "a")) for s in "ab"}
    assert {r.source_size: r.target for r in got}[200] == 1000 and words == {"a": 1600, "b": 1000}
