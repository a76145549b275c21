"""License scans by template-markup matching.

A template is a license's wording with two kinds of markup: ``[[ ... ]]``
encloses words that may be absent, ``{n}`` stands for 0 to ``n`` replaceable
words (names, years, versions). It is compiled to an automaton over words:
mandatory words are the only way forward, optional regions add an empty step
around them, replaceable ones up to ``n`` steps on any word. A text carries the
license if some stretch of its words is accepted, that is if all mandatory
wording matches exactly.

Defined results: a null text is empty and has no labels; phrases and templates
are found wherever they stand in the whole text; repeated rows are scanned each
on its own; an empty table gives an empty result; only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, text_bytes

# The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Public license wording, as templates.
TEMPLATES = (
    ("mit-notice", "[[this {4} is]] released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "[[this {4} is]] licensed under the gnu general public license [[version {2}]]"),
    ("cc-by-notice", "licensed under [[a]] [[the]] cc by {2} 4 0"),
    ("cc-by-notice", "licensed under [[a]] [[the]] creative commons attribution {2} 4 0 [[international]] license"),
    ("gpl-3.0-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1} of the license or at your option any later version"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software",
    ),
    ("isc-text", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
)

#: Bytes that belong to no word become blanks, A-Z become a-z, all else stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Automaton:
    """States with steps on one word, steps on any word, and empty steps; 0 begins, the last accepts."""

    label: str
    steps: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    anys: list[int | None] = field(default_factory=lambda: [None])
    empty: list[set[int]] = field(default_factory=lambda: [set()])
    anchor: bytes = b""
    reach: int = 0

    def state(self) -> int:
        self.steps.append({})
        self.anys.append(None)
        self.empty.append(set())
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def accepts_at(self, tokens: list[bytes], at: int) -> int | None:
        """The end of the longest accepted stretch that begins at word ``at``."""
        last, end, now = len(self.steps) - 1, None, self.closure({0})
        for i in range(at, len(tokens) + 1):
            if last in now:
                end = i
            if i == len(tokens) or not now:
                break
            token = tokens[i]
            now = self.closure({t for s in now for t in (self.steps[s].get(token), self.anys[s]) if t is not None})
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template; raises on unbalanced markup or no mandatory words."""
    a, here, opened, run, runs, before, anchors = Automaton(label), 0, [], [], [], 0, []
    for token in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", markup):
        # a run ends here, before the token is counted
        if run and (token == "[[" or token[0] == "{"):
            runs.append(run)
            anchors.append(before)
            run = []
        if token == "[[":
            opened.append(here)
        elif token == "]]":
            a.empty[opened.pop()].add(here)
        elif token[0] == "{":
            ways = [here]
            for _ in range(int(token[1:-1])):
                ways.append(a.state())
                a.anys[ways[-2]] = ways[-1]
            here = a.state()
            for w in ways:
                a.empty[w].add(here)
            before += int(token[1:-1])
        else:
            nxt = a.state()
            a.steps[here][token.encode()] = nxt
            here = nxt
            if not opened:
                run.append(token.encode())
            before += 1
    if run:
        runs.append(run)
        anchors.append(before)
    if opened or not runs:
        raise ValueError(f"bad template: {markup}")
    best = max(range(len(runs)), key=lambda i: len(runs[i]))
    a.anchor = b" " + b" ".join(runs[best]) + b" "
    a.reach = anchors[best] - len(runs[best])
    return a


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which ``phrase`` (blanks around) stands in ``joined`` (blanks around)."""
    out, at, counted, n = [], joined.find(phrase), 0, 0
    while at >= 0:
        n += joined.count(b" ", counted, at)
        counted = at
        out.append(n)
        at = joined.find(phrase, at + 1)
    return out


def scan_text(text: bytes, automata: list[Automaton]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, spans (label, first word, end word)."""
    tokens = words(text)
    joined = b" " + b" ".join(tokens) + b" "
    base, labels, starts, spans = set(), set(), [], []
    for phrase, label in PHRASES:
        if found := places(joined, b" " + phrase.encode() + b" "):
            base.add(label)
            starts += found
    for a in automata:
        for at in places(joined, a.anchor):
            for begin in range(max(0, at - a.reach), at + 1):
                if (end := a.accepts_at(tokens, begin)) is not None and end > at:
                    labels.add(a.label)
                    spans.append((a.label, begin, end))
                    break
    score = 1.0 if spans else 0.5 if base else 0.0
    return len(tokens), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, spans


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per document with counts, labels, score and the matched spans of words."""
    small_batches(docs.sparkSession)
    automata = [compile_template(*t) for t in templates]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long>>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = [scan_text(t, automata) for t in text_bytes(batch)]
            rows = [(*r[:7], [{"label": x, "first": b, "end": e} for x, b, e in r[7]]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
