"""Very long runs of marks, passages that begin anywhere, ids with several texts, odd column types, and hosts that fall."""

import os
import random
import sys
import time

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import duck, same_rows  # noqa: E402

from quarry.llm import licenses, mixing, queries, shingles, simhash, spans  # noqa: E402


@pytest.mark.parametrize("mark", [".", "!?", ";", ":", ". ", "\n", "\n \t"])
def test_a_megabyte_of_marks_is_read_in_a_second(mark):
    text = mark * (1_000_000 // len(mark)) + "a"
    began = time.process_time()
    found = spans.sentences(text.encode())[1]
    n, known = licenses.Recogniser().identifiers(text)
    assert time.process_time() - began < 5  # in seconds of CPU; quadratic scanning takes hours
    assert sum(map(len, found)) == len(text.split()) and known == [] and n >= 1


def fresh(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))


def test_passages_inside_long_sentences_are_caught(spark):
    """A passage of 60 words without any mark, at another offset of a long sentence in each document."""
    rng = random.Random(5)
    lost, total = 0, 0
    for _ in range(6):
        passage = fresh(rng, 60)
        docs = [(i, f"{fresh(rng, 20 + 7 * i)} {passage} {fresh(rng, 33)}.") for i in range(8)]
        got = {r.id: r for r in spans.dedup(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), changed_only=True).collect()}
        assert got.keys() <= set(range(1, 8)) and all(r.first_id == 0 for r in got.values())
        assert all(r.n_words - r.n_kept_words <= 60 for r in got.values())
        lost += sum(r.n_words - r.n_kept_words for r in got.values())
        total += 7 * 60
    assert lost > 0.6 * total


def test_cuts_do_not_depend_on_what_is_far():
    rng = random.Random(6)
    passage = fresh(rng, 80).encode()
    inside = None
    for before in (0, 1, 5, 18, 40):
        words = spans.sentences(f"{fresh(rng, before)} ".encode() + passage + f" {fresh(rng, 25)}.".encode())[1]
        flat = passage.split()
        starts, at = set(), -before
        for s in words:
            starts.add(at)
            at += len(s)
        own = {x for x in starts if spans.NEAR <= x < len(flat) - spans.NEAR}
        inside = own if inside is None else inside
        assert own == inside and own


def test_spans_of_several_texts_under_one_id(spark):
    """Texts under one id are documents of their own; rows alike in id and text are one document."""
    rng = random.Random(7)
    passage = f"{fresh(rng, 12)}. {fresh(rng, 12)}. {fresh(rng, 12)}."
    other = f"{fresh(rng, 15)}. {fresh(rng, 15)}."
    docs = [(1, f"{other} {passage}"), (1, f"{other} {passage}"), (2, passage), (2, other), (2, fresh(rng, 50)), (None, passage), (3, None)]
    got = spans.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    by = {(r.id, r.n_words): r for r in got}
    assert by[1, 66].n_removed == 0 and by[1, 66].first_id is None
    assert (by[2, 36].n_kept_words, by[2, 36].first_id) == (0, 1)
    assert (by[2, 30].n_kept_words, by[2, 30].first_id) == (0, 1)
    assert by[2, 50].n_removed == 0 and by[None, 36].n_removed == 0 and by[3, 0].text is None


INTERNAL = ("target", "part", "whole", "source_size", "last_h", "last_size", "weight", "rank", "words", "extra", "root", "fp", "cells", "stays", "best", "parts", "one", "row", "mark", "lost")


def odd_columns(spark, rows):
    """Documents with columns named as the operators name theirs, and maps, structs and arrays."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(3) for c in INTERNAL})
    return df.withColumns({"tags": F.create_map(F.lit("k"), F.col("lang")), "deep": F.struct(F.create_map(F.lit(1), F.lit(2)).alias("m"), F.array(F.lit(1.5)).alias("a")), "a.b": F.lit("dot")})


ROWS = [
    (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "fr", "s", 1), (1, "other words under the same id", "en", "s", 1),
    (2, "a b c d e f", "en", "s", 2), (3, "", "en", None, 0), (4, None, None, None, None), (None, " ", "en", "t", 1), (None, "no id", "en", "t", 5),
]


@pytest.mark.parametrize("keep", [simhash.keep_one, shingles.keep_one])
@pytest.mark.parametrize("most", [simhash.BROADCAST_KEYS, 0])
def test_near_dedup_of_odd_columns(spark, keep, most, monkeypatch):
    """One row of each group, whichever way the keys are looked up; rows alike in id and text give the one of least hash."""
    for module in (simhash, shingles):
        monkeypatch.setattr(module, "BROADCAST_KEYS", most)
    docs = odd_columns(spark, ROWS)
    kept = keep(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d e f"), ("1", "other words under the same id"), ("3", ""), ("None", "no id")]
    assert sorted(map(str, keep(docs.repartition(3)).collect())) == sorted(map(str, kept.collect()))


def test_mixing_of_odd_columns(spark):
    docs = odd_columns(spark, ROWS)
    again = mixing.repeat_documents(docs)
    assert again.columns == docs.columns
    had = {(r.doc_id, r.text, r.lang) for r in docs.collect()}
    assert {(r.doc_id, r.text, r.lang) for r in again.collect()} <= had
    rows = docs.select(*[c for c in docs.columns if c != "a.b"]).withColumns({"size": mixing.word_count(F.col("text")), "h": mixing.seeded_hash(F.col("doc_id"), 0)})
    found = mixing.mix(rows, mixing.by_rank(rows, [5, 2, 1]))
    assert found.count() == len(ROWS) and {"source_size", "target", "taken"} <= set(found.columns) and found.columns.count("target") == 1


def test_many_sources_by_rank(spark):
    sources = spark.range(1000).selectExpr("if(id = 999, null, lpad(cast(id as string), 4, '0')) AS source").repartition(7)
    got = {r.source: r.weight for r in mixing.by_rank(sources.union(sources), [5, 2, 1]).collect()}
    assert len(got) == 1000 and all(got[f"{k:04d}"] == (5, 2, 1)[k % 3] for k in range(999)) and got[None] == (5, 2, 1)[999 % 3]


def test_bad_hosts_fall_in_sql_too(spark, tmp_path):
    """A host whose documents mostly fail takes its good ones along, in the query and in SQL; small and mixed hosts stay."""
    import duckdb

    rng = random.Random(8)
    good = lambda: fresh(rng, 60)
    rows = [(i, good(), f"host{i % 12}") for i in range(360)]
    rows += [(1000 + i, "short text" if i % 10 else good(), "spam") for i in range(150)]
    rows += [(2000 + i, "#### $$$$ |||| " * 40 + fresh(rng, 55) if i % 8 else good(), "symbols") for i in range(80)]
    rows += [(3000 + i, "short" if i % 2 else good(), "mixed") for i in range(40)]
    rows += [(4000, good(), "one"), (4001, "short", "bad one"), (4002, good(), None), (4003, None, "spam"), (4004, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = queries.op2_host_rules(spark, str(tmp_path))
    same_rows(found, con, queries.oracle_sql()["op2_host_rules"])
    kept = {r.doc_id: (r.kept, r.base_failed) for r in found.collect()}
    assert all(kept[i] == (True, False) for i in range(360)) and kept[4000] == kept[4002] == (True, False)
    assert [kept[1000 + i] for i in range(0, 150, 10)] == [(False, False)] * 15
    assert [kept[2000 + i][0] for i in range(0, 80, 8)] == [False] * 10
    assert [kept[3000 + i] for i in range(0, 40, 2)] == [(True, False)] * 20


@pytest.mark.parametrize("cell", [simhash.CELL, 16])
def test_links_of_large_cells(spark, cell, monkeypatch):
    """Grid cells over the limit are split into blocks and lose no link; points that agree in their counts only don't link."""
    from quarry.llm import components

    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(9)
    points = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        points |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(60)}
    low = rng.getrandbits(32)
    points |= {low | sum((1 + rng.randrange(2)) << 2 * k for k in range(16)) << 32 for _ in range(150)}
    points = sorted(points)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long").repartition(3)
    roots = {r.node % (1 << 64): r.root for r in components.connected_components(simhash.links(df)).collect()}
    label = list(range(len(points)))
    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= 3 and label[i] != label[j]:
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    sizes = {k: label.count(k) for k in set(label)}
    assert {p for p, k in zip(points, label) if sizes[k] > 1} == roots.keys()
    for i, p in enumerate(points):
        for j in range(i):
            if p in roots and points[j] in roots:
                assert (roots[p] == roots[points[j]]) == (label[i] == label[j])


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BOOST = "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)"
EPL = "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nMore."
NOTICES = [
    (APACHE, "Apache-2.0"), (BOOST, "BSL-1.0"), (LGPL, "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"), (ZLIB, "Zlib"), (EPL, "EPL-2.0"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */\n#include <a.h>\n\nint y;", "GPL-2.0-or-later"),
    ("MIT License\n\nCopyright (c) 2020 A. Body", "MIT"), ("This file is Licensed under the Apache License 2.0.", None), ("Licensed under the Apache License 2.0. More", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
]


def test_verbatim_notices_through_scan(spark):
    """Standard notices, and what comments hold, as documents with prose around; comment marks between lines hide nothing but words."""
    rows = [(i, f"Some prose before.\n\n{text}\n\nAnd after; all the same.") for i, (text, _) in enumerate(NOTICES)]
    found = {r.id: {m.licence for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: {x} - {None} for i, (_, x) in enumerate(NOTICES)}


def test_every_rule_is_reachable():
    """Each licence sentence comes out of the splitter as it is stored, and each rule out of its sentences."""
    r = licenses.Recogniser()
    for name, text in licenses.SENTENCES.items():
        head = "spdx-license-identifier: " if name.startswith("spdx ") else ""
        assert r.identifiers(f"{head}{text}.\n")[1][-1] == (bool(head), name)
    assert r.identifiers("License: MIT\n\nmore")[1] == []
    for licence, names in licenses.RULES:
        found = r.licences(list(enumerate(names)))
        assert found[0][0] == licence and found[0][1] == 0


# Toxicity


def slow_features(text, lexicon):
    """Each feature from its meaning, word by word."""
    import math

    from quarry.llm import toxicity as t

    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(t.FEATURES)
    n, words = len(tokens), [x.strip(t.EDGE).lower() for x in tokens]
    mixed = [any(a.isalpha() and all(c in "0123456789@$!*#|€._-" for c in x[i + 1 : j]) and j > i + 1 and x[j].isalpha() for i, a in enumerate(x) for j in range(i + 2, len(x))) for x in tokens]
    plain = ["".join(c for c in x.strip(" \t\n\"',;:?()[]").lower().translate(t.STAND_INS) if c not in "*#|._-").strip(t.EDGE) for x in tokens]
    listed, learned = [w in t.LEXICON for w in words], [w in lexicon.words for w in words]
    stems = [any(len(w) > k and w[:k] in lexicon.stems for k in t.STEM_SIZES) for w in words]
    hidden = [m and (p in t.LEXICON or p in lexicon.words) for m, p in zip(mixed, plain)]
    you = [i for i, w in enumerate(words) if w in t.SECOND_PERSON]
    insults = [i for i in range(n) if listed[i] or learned[i] or stems[i] or hidden[i]]
    raw = text.encode()
    count = lambda which: sum(raw.count(bytes([b])) for b in which)
    letters = max(1, count(range(65, 91)) + count(range(97, 123)) + count(range(192, 256)))
    return [
        math.log1p(n), sum(listed), sum(listed) / n, sum(learned), sum(learned) / n, sum(stems), sum(stems) / n, len(insults) / n,
        sum(any(abs(i - j) <= t.NEAR for j in you) for i in insults), len(you) / n, sum(hidden), sum(mixed) / n, sum(len(w) > 2 and x.isupper() for w, x in zip(words, tokens)) / n,
        count(range(65, 91)) / letters, raw.count(b"!") / len(raw), raw.count(b"?") / len(raw), count(b".,;:!?'\"-()") / len(raw), count(t.SYMBOLS) / len(raw), count(range(48, 58)) / len(raw),
        (raw.count(b"!!") + raw.count(b"??")) / n,
    ]


def test_features_against_their_meaning():
    from quarry.llm import toxicity

    rng = random.Random(14)
    lexicon = toxicity.Lexicon(frozenset({"grumf", "blarg"}), frozenset({"zork", "plim"}))
    pieces = ["you", "YOU", "idiot!", "1d10t", "St*pid", "grumf", "gr.u.mf", "zorkel", "zork", "plimm", "Hello", "world.", "(why??)", "!!", "#1", "ÄRGER", "ta", "a1b", "x" * 30, "blarg,", "é", "123"]
    for k in range(400):
        text = " ".join(rng.choices(pieces, k=rng.randrange(80)))
        assert toxicity.features(text, toxicity._Classes(lexicon)) == pytest.approx(slow_features(text, lexicon)), text
    assert toxicity.features("idiot " * 500, toxicity._Classes(lexicon))[1] == 500


def test_toxicity_learns_and_is_calibrated(spark):
    """Made-up insults near second persons: held-out documents are told apart, scores match rates, repeated ids don't grow the sample."""
    from quarry.llm import toxicity

    rng = random.Random(15)
    bad = ["".join(rng.choices("bdgkz", k=3)) + "oof" for _ in range(25)]
    rows, labels = [], []
    for i in range(900):
        words = fresh(rng, rng.randrange(30, 120)).split()
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(4):
                at = rng.randrange(len(words))
                words[at:at] = ["you", rng.choice(bad)]
        elif rng.random() < 0.1:
            words.insert(3, "you")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(0, f"{fresh(rng, 20)}") for _ in range(300)] + [(None, "you"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([*labels, (5, labels[5][1]), (None, 1), (901, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, train=F.col("doc_id") % 3 != 0)
    by_id = dict(labels)
    got = [(by_id[r.id], r.score, r.predicted) for r in toxicity.score(docs, model).collect() if r.id in by_id and r.id % 3 == 0 and r.id]
    caught = [p for y, _, p in got if y]
    assert len(got) == 299 and sum(caught) / len(caught) > 0.9 and sum(p for y, _, p in got if not y) <= 6
    assert abs(sum(s for _, s, _ in got) - sum(y for y, _, _ in got)) < 15
    assert sum((s - y) ** 2 for y, s, _ in got) / len(got) < 0.05


# Decontamination


def test_two_passes_whatever_the_benchmark(spark, monkeypatch):
    """One pass counts, one probes, for one item as for thousands."""
    from quarry.llm import decontaminate

    calls = []
    for name in ("_frequencies", "_probed"):
        monkeypatch.setattr(decontaminate, name, lambda *a, _f=getattr(decontaminate, name), _n=name: (calls.append(_n), _f(*a))[1])
    rng = random.Random(16)
    items = [(i, fresh(rng, 40)) for i in range(2000)]
    docs = [(i, f"{fresh(rng, 30)} {items[7 * i][1] if i % 2 else ''} {fresh(rng, 20)}") for i in range(40)]
    for some in (items[:1], items):
        calls.clear()
        found = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(some, "item_id long, text string"))
        got = {r.id: (r["items"], decontaminate.covered([tuple(s) for s in r.spans])) for r in found.collect()}
        assert sorted(calls) == ["_frequencies", "_probed"]
    assert got == {i: (([str(7 * i)], 40) if i % 2 else ([], 0)) for i in range(40)}


def test_filter_lets_its_shingles_through(spark):
    import numpy as np

    from quarry.llm import decontaminate

    rng = np.random.default_rng(1)
    own, other = rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 1 << 64, 50_000, np.uint64)
    f = decontaminate._filter(spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "shingle long"))
    assert len(f.passes(own)) == len(own) and len(f.passes(other)) < 0.05 * len(other)
