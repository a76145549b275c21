"""The pipeline against a plain version of its stages over whole texts."""

import re
from collections import Counter

import corpus_pipeline
from pathloom.llm import mixing, quality_rules

from .test_brute import _links


def test_pipeline(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bands = quality_rules.Bands()
    kept = {i: r for i, r in docs.items() if quality_rules._judge([(r.text or "").encode()], bands)[0][6]}
    groups = {}
    for i, r in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append(i)
    kept = {i: kept[i] for i in (min(g, key=lambda i: (-len(docs[i].text), i)) for g in groups.values())}
    roots = _links({i: r.text for i, r in kept.items()}, 5, 80)
    kept = {i: r for i, r in kept.items() if roots[i][1] == i}
    size = Counter()
    for r in kept.values():
        size[r.source] += len(r.text.encode().split())
    goal = mixing.targets(dict(size))
    pieces = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = pieces
    for _, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, sf_dir)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(kept)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= set(kept) and all(r.parity and r.token_ids for r in out)
    mixed = corpus_pipeline.STAGES[3][1](spark, stage, sf_dir).collect()
    got = Counter()
    for r in mixed:
        assert r.text.encode() in docs[r.doc_id].text.encode() and r.n_chars == len(r.text)
        got[r.source] += len(r.text.encode().split())
    assert all(abs(got[s] - goal[s]) <= 1 for s in goal) and len(out) == len(mixed)
