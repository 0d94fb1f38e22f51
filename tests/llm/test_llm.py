"""The training-data operators: against SQL and brute force, and on nulls, empty and long texts, ties and odd columns."""

import hashlib
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import duck, same_rows  # noqa: E402

from quarry.llm import boosting, components, decontaminate, gru, host_rules, language, licenses, mixing, pii, queries, sharding, shingles, simhash, spans, toxicity  # noqa: E402
from quarry.session import load  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "Alpha beta gamma. Delta epsilon zeta!\nAlpha beta gamma.", "en", "s1", 10),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \t\n ", "fr", "s2", 4),
    (5, "x" * 300_000, "en", "s1", 300_000),
    (6, "one two " * 60_000, "en", None, 480_000),
    (7, "Alpha beta gamma. Delta epsilon zeta!\nAlpha beta gamma.", "en", "s1", 10),
    (7, "Alpha beta gamma. Delta epsilon zeta!\nAlpha beta gamma.", "en", "s1", 10),
    (None, "no id here, only words", "de", "s3", 22),
    (8, "ÄÖÜ straße   ½   naïve\x1cwords \U0001f600", "de", "s2", 20),
    (9, "\x00 nul \x7f bytes", "en", "s2", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = ("id", "fp", "h", "size", "hash", "key", "spans", "items", "score", "host", "mark", "toxic", "n_words", "bucket", "u", "v", "slot_")
    return df.withColumns({c: F.lit(7) for c in clash})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same_rows(queries.queries()[name](spark, sf), duck(sf), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_over_awkward_tables(spark, odd, tmp_path, name):
    """Nulls, empty and long texts, repeated rows and clashing columns, and then no rows at all."""
    items = [(1, "alpha beta gamma delta"), (None, "one two one two"), (2, None), (3, ""), (4, "!!"), (4, "no id here"), (4, "no id here")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 10)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for folder, empty in (("full", False), ("empty", True)):
        for table, df in (("documents", odd), ("benchmark", bench), ("labels", labels)):
            (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/{folder}/{table}.parquet")
        got = queries.queries()[name](spark, f"{tmp_path}/{folder}")
        rows = got.collect()
        if name != "op6_spans":
            assert len(rows) == (0 if empty else len(ROWS))
            assert Counter(r.doc_id for r in rows) == (Counter() if empty else Counter(r[0] for r in ROWS))
        assert got.columns == queries.queries()[name](spark, f"{tmp_path}/full").columns


# Licences


def test_licence_sequences():
    r = licenses.Recogniser()
    text = (
        "Some prose here. Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,'
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        ' Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    )
    n, found = r.identifiers(text)
    assert n == 4 and [x for _, x in found] == ["mit_grant", "mit_notice", "mit_asis"]
    assert r.licences(found) == [("MIT", 1, 3)]
    n, found = r.identifiers("text without stop\nLicensed under the Apache License, Version 2.0.\nmore")
    assert r.licences(found) == [("Apache-2.0", 0, 0)]
    assert r.licences([(0, "mit_notice"), (1, "mit_asis")]) == []
    assert r.licences([(0, "gpl_free"), (1, "gpl_hope"), (2, "gpl_details"), (3, "mit_ref")]) == [("GPL-3.0-or-later", 0, 2), ("MIT", 3, 3)]
    assert r.licences([(0, "gpl_free"), (9, "gpl_hope"), (10, "gpl_details")]) == [("GPL-3.0-or-later", 0, 0)]
    assert r.identifiers(None) == (0, []) and r.identifiers(" . \n") == (0, [])


@pytest.mark.parametrize("version, stop, comma", [(3, ":", ","), (2, ";", ";"), (2, ";", ","), (3, ";", ";")])
def test_verbatim_gpl_notices(version, stop, comma):
    r = licenses.Recogniser()
    opening = f"This program is free software{stop} "
    terms = (
        "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
        f"the Free Software Foundation{comma} either version {version} of the License, or\n(at your option) any later version.\n\n"
    )
    warranty = (
        "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
    )
    for text in (opening + terms + warranty, opening + terms, "The tool is free software; " + terms + warranty, "The tool is free software; " + terms):
        n, found = r.identifiers(text)
        assert r.licences(found) == [(f"GPL-{version}.0-or-later", text.startswith("The"), n - 1)]


def test_verbatim_mpl_notice():
    r = licenses.Recogniser()
    ref = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    copy = " If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    assert r.licences(r.identifiers(ref + copy)[1]) == [("MPL-2.0", 0, 2)]
    assert r.licences(r.identifiers(ref)[1]) == [("MPL-2.0", 0, 0)]


def test_licences_of_documents_against_lines(spark, sf):
    """In the test data notices stand on lines of their own, so looking at lines finds the same."""
    known = licenses.Recogniser().identifier
    want = {}
    for r in load(spark, sf, "documents").collect():
        want[r.doc_id] = [known[x] for x in map(licenses.normalise, (r.text or "").encode().split(b"\n")) if x in known]
    got = {r.doc_id: [x.partition(":")[2] for x in r.identifiers.split(",") if x] for r in queries.op1_licenses(spark, sf).collect()}
    assert got == want and any(want.values())


# Host rules


def test_metrics_against_a_plain_count():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", " ", "\n", "\t", "#", "ü", "\x1c", "a b c ", " "], k=rng.randrange(80)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))
        assert host_rules.metrics(text) == want


def test_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, f"h{i % 8}") for i in range(400)] + [(1000 + i, bad if i % 20 else good, "spam") for i in range(400)] + [(5000, good, "tiny"), (5001, bad, "small"), (5002, good, None)]
    found = {r.id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source")).collect()}
    assert all(found[i].kept for i in range(400))
    assert not any(found[1000 + i].kept for i in range(400)) and not found[1000].base_failed
    assert found[5000].kept and found[5002].kept and found[5001].base_failed and not found[5001].host_rejected


def test_domain(spark):
    urls = [("https://www.Example.com:80/a",), ("ftp://u:p@h.org",), ("no url",), (None,)]
    assert [r[0] for r in spark.createDataFrame(urls, "u string").select(host_rules.domain(F.col("u"))).collect()] == ["example.com", "h.org", None, None]


# Decontamination


def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, ids = set(), set()
    for item, body in items:
        other = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in body or ""))
        size = min(window, len(other))
        for j in range(len(other) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == other[j : j + size]:
                    hit.update(range(i, i + size))
                    ids.add(item)
    return len(words), len(hit), sorted(str(x) for x in ids if x is not None)


@pytest.mark.parametrize("most", [None, 0])
def test_windows_against_brute_force(spark, most, monkeypatch):
    """With the tables of prefixes and hits broadcast, and with joins that shuffle."""
    if most is not None:
        monkeypatch.setattr(decontaminate, "BROADCAST_PREFIXES", most)
        monkeypatch.setattr(decontaminate, "BROADCAST_HITS", most)
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices(["a", "b", "C", "dé", "e-f", "g"], k=n))
    docs = [(i, say(rng.randrange(60))) for i in range(60)] + [(60, None), (61, ""), (62, "a"), (62, "a"), (None, say(30))]
    items = [(i, say(rng.randrange(1, 14))) for i in range(25)] + [(25, None), (26, "--"), (None, say(4)), (27, docs[3][1]), (27, docs[4][1])]
    found = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    got = sorted(((r.id, r.n_words, decontaminate.covered([tuple(s) for s in r.spans]), r["items"]) for r in found.collect()), key=str)
    assert got == sorted(((i, *brute_hits(t, items, 5)) for i, t in docs), key=str)
    clean = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert sorted(map(str, (tuple(r) for r in clean.collect()))) == sorted(str(d) for d in docs if not brute_hits(d[1], items, 5)[1])


# Mixing


def test_mixing_is_near_its_targets_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, f"s{min(7, int(rng.expovariate(0.7)))}" if i % 50 else None, rng.randrange(0, 300)) for i in range(3000)] + [(7, "s1", 10)] * 3 + [(None, "s2", 40)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("h", mixing.seeded_hash(F.col("doc_id"), 5))
    weights = mixing.by_rank(df, [5, 2, 1])
    found = mixing.mix(df, weights).collect()
    again = mixing.mix(df.repartition(7), weights).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted((s for s in size if s is not None)) + [None]
    share = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, open_, want = sum(size.values()), set(order), {}
    while True:  # clamp, hand on, repeat
        left = total - sum(want.values())
        now = {s: left * share[s] / sum(share[x] for x in open_) for s in open_}
        over = {s for s in open_ if now[s] > 3 * size[s]}
        if not over:
            want |= now
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 3


def test_repeated_documents_are_whole(spark, odd):
    again = mixing.repeat_documents(odd)
    assert again.columns == odd.columns
    had = Counter(str(r) for r in odd.collect())
    assert set(Counter(str(r) for r in again.collect())) <= set(had)
    rows = [(i, "w " * 10, "big") for i in range(300)] + [(1000 + i, "w " * 10, "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter(r.doc_id for r in mixing.repeat_documents(docs).collect())
    assert all(times[1000 + i] == 3 for i in range(20))
    assert sum(times[i] for i in range(300)) == 260
    assert max(times.values()) == 3


# SimHash


def slow_fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points):
    """Least id by point over links of at most 3 bits."""
    label = list(range(len(points)))
    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= 3:
                x, y = label[i], label[j]
                if x != y:
                    label = [min(x, y) if k in (x, y) else k for k in label]
    return label


def test_fingerprints_and_components(spark):
    rng = random.Random(8)
    base = [[rng.choice("ABCdefgé") * rng.randrange(1, 4) for _ in range(120)] for _ in range(12)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for _ in range(5):
            copy = list(w)
            copy[rng.randrange(120)] = "zz"
            texts.append("\t".join(copy))
    texts += [None, "", " \n", "One", "one two", "ONE  two", texts[0], texts[0]]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.id: r for r in simhash.components(docs).collect()}
    points = [slow_fingerprint(t, 3) for t in texts]
    assert [got[i].fp % (1 << 64) for i in ids] == points
    least = {}
    label = classes(points)
    for i, k in zip(ids, label):
        least[k] = min(i, least.get(k, i))
    assert [got[i].component_id for i in ids] == [least[k] for k in label]
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(least.values())


def test_grid_loses_no_link(spark):
    """Dense balls of fingerprints with pairs at every distance up to 3, and far ones."""
    rng = random.Random(10)
    points = set()
    for _ in range(15):
        centre = rng.getrandbits(64)
        points |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(25)}
    points = sorted(points)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    roots = {r.node % (1 << 64): r.root for r in components.connected_components(simhash.links(df)).collect()}
    label = classes(points)
    groups = defaultdict(set)
    for p, k in zip(points, label):
        groups[k].add(p)
    for members in groups.values():
        if len(members) == 1:
            assert not members & roots.keys()
        else:
            assert len({roots[p] for p in members}) == 1 and members == {p for p in roots if roots[p] == roots[min(members)]}


def test_keep_one_of_repeated_ids(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "5", "6", "None", "8", "9"])
    same = spark.createDataFrame([(3, "a b c d e", "x")] * 4 + [(3, "a b c d e", "y")] * 2, "doc_id long, text string, lang string")
    assert simhash.keep_one(same).count() == 1
    assert simhash.keep_one(none).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, None), (n + 5, n + 6), (n + 6, n + 5)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {n + 5: n + 5, n + 6: n + 5}


# Sentence spans


def slow_spans(docs, least_sentences, least_words):
    """Positions that later copies of runs cover, by scanning all runs in order."""
    first, gone, homes = {}, defaultdict(set), defaultdict(set)
    for key, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words = spans.sentences((text or "").encode())[1]
        size = lambda i, j: sum(map(len, words[i:j]))
        fits = [(i, j) for i in range(len(words)) for j in range(i + least_sentences, len(words) + 1) if size(i, j) >= least_words]
        for i, j in fits:
            if j != min(b for a, b in fits if a == i) and i != max(a for a, b in fits if b == j):
                continue
            run = b" ".join(w for s in words[i:j] for w in s)
            if first.setdefault(run, (key, i)) != (key, i):
                gone[key] |= set(range(i, j))
                homes[key].add(first[run][0])
    return {k: (sorted(v), min(homes[k])) for k, v in gone.items()}


def test_spans_against_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choices(["aa", "B", "cé", "d"], k=rng.randrange(1, 30))) + rng.choice([". ", "!\n", "\n", "? "]) for _ in range(12)]
    docs = [(i, "".join(rng.choices(pool, k=rng.randrange(12)))) for i in range(40)] + [(40, None), (41, ""), (None, pool[0] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.sentences, r.first_id) for r in spans.repeated(df, least_sentences=2, least_words=6).collect()}
    assert got == slow_spans(docs, 2, 6) and got
    text = {r.id: r for r in spans.dedup(df, least_sentences=2, least_words=6).collect()}
    for key, body in docs[:41]:
        words = spans.sentences((body or "").encode())[1]
        gone = got.get(key, ([], []))[0]
        left = [w for k, s in enumerate(words) if k not in gone for w in s]
        assert (text[key].n_sentences, text[key].n_removed, text[key].n_kept_words) == (len(words), len(gone), len(left))
        if not gone:
            assert text[key].text == body


def test_sentences_keep_all_words():
    rng = random.Random(0)
    for _ in range(500):
        text = "".join(rng.choices(["a", "bb", "Ccc", "é", " ", ". ", "\n", "! ", "?", "\t", "dd ee ff gg "], k=rng.randrange(120))).encode()
        where, words = spans.sentences(text)
        assert [x for s in words for x in s] == text.translate(simhash.LOWER).split()
        assert all(len(s) <= spans.LONGEST for s in words)
        assert spans.remove(text, list(range(len(where)))).split() == [] and spans.remove(text, []) == text


def test_passages_across_documents_are_caught(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    for passage in (fresh(55), ". ".join(fresh(9) for _ in range(6)) + "."):
        docs = [(i, f"{fresh(40)}.\n{passage}\n{fresh(40)}.") for i in range(6)] + [(100 + i, f"{fresh(80)}. {fresh(30)}.") for i in range(20)]
        got = {r.id: r for r in spans.dedup(spark.createDataFrame(docs, "doc_id long, text string"), changed_only=True).collect()}
        assert got.keys() == set(range(1, 6))
        assert all(r.first_id == 0 and r.n_kept_words == 80 for r in got.values())


# Sharding


def slow_fill(shards, slots):
    """Preference lists first, then turns."""
    number = lambda t: int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
    wish = [[(number(f"offset|{s}") % slots + j * (number(f"step|{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    table, turn = {}, 0
    while len(table) < slots:
        k = turn % len(shards)
        table[next(x for x in wish[k] if x not in table)] = k
        turn += 1
    return [table[i] for i in range(slots)]


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill(names, 101)
    assert table == slow_fill(names, 101)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    big = [sharding.fill([f"s{k}" for k in range(n)], 4099) for n in (20, 21)]
    moved = sum(a != b for a, b in zip(*big))
    assert moved < 0.15 * 4099
    for wrong in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(*wrong)


def test_placement(spark, odd, tmp_path):
    placed = sharding.place(odd.withColumn("shard", F.lit("old")), ["a", "b", "c"], slots=101)
    assert placed.count() == len(ROWS) and placed.columns == [*odd.columns, "slot", "shard"]
    table = sharding.fill(["a", "b", "c"], 101)
    for r in placed.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard == "abc"[table[r.slot]]
    sharding.write_shards(placed.select("doc_id", "text", "shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)


# Language


def test_gradient():
    net = gru.BiGRU(3, 2)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    x, y = np.random.default_rng(0).integers(97, 103, (5, 6)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    grad = net.gradient(x, y)[1]
    for k, w in net.w.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
        w[at] += 1e-4
        up = net.gradient(x, y)[0]
        w[at] -= 2e-4
        down = net.gradient(x, y)[0]
        w[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(grad[k][at], rel=0.02, abs=1e-5)


def test_pooling_counts_every_position():
    """Windows give what labelling each position once gives, by strings that end MARGIN bytes from what is labelled."""
    net = gru.BiGRU(4, 3, seed=1)
    model = language.Model(["a", "b", "c"], net)
    for text in ("Hello hello WORLD, x" * 3, "ünï " + "z" * 100, "many words of 12 kinds! " * 60):
        line = language.normalised(text)
        around = b" " * language.MARGIN + line + b" " * (language.MARGIN + language.LABELLED)
        rows = []
        for lo in range(0, len(line), language.LABELLED):
            part = np.frombuffer(around[lo : lo + language.LABELLED + 2 * language.MARGIN], np.uint8)
            rows.append(net.log_probabilities(part[None, :])[language.MARGIN : -language.MARGIN, 0])
        mean = np.exp(np.concatenate(rows)[: len(line)]).mean(axis=0)
        assert model.predict([text]) == (["abc"[mean.argmax()]], [pytest.approx(mean.max(), rel=1e-5)])
    assert language.normalised(" Straße, 12\n" + "q" * 70) == "straße ".encode() + b"q" * 70
    assert model.predict([None, "", "12 !?", "x"])[0][:3] == ["und"] * 3


def test_words_are_read_in_their_order():
    """The network reads across words: the same words in another order give other probabilities."""
    net = gru.BiGRU(4, 2, seed=2)
    one, other = language.Model(["a", "b"], net).predict(["alpha beta gamma delta", "delta gamma beta alpha"])[1]
    assert abs(one - other) > 1e-6


def test_copies_do_not_fill_the_sample(spark):
    """However often a text is repeated it counts once, and what the driver gets stays bounded."""
    rng = random.Random(3)
    words = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, "x y z same text again", "en") for i in range(5000)] + [(10_000 + i, words("abcde", 30), "en") for i in range(150)]
    rows += [(20_000 + i, words("uvwxy", 30), "fr") for i in range(150)] + [(30_000, words("uvwxy", 200_000), "fr"), (30_001, None, "fr"), (30_002, "12", "de"), (30_003, words("uvwxy", 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = {}
    train = gru.BiGRU.train
    try:
        gru.BiGRU.train = lambda self, x, y, *a, **b: seen.update(x=x, y=y) or train(self, x, y, *a, **b)
        model = language.fit(docs, max_docs=100, windows_per_doc=4, steps=60)
    finally:
        gru.BiGRU.train = train
    assert model.languages == ["en", "fr"] and len(seen["x"]) == 2 * 100 * 4
    english = {bytes(w) for w, k in zip(seen["x"], seen["y"]) if k == 0}
    assert len(english) > 300 and sum(b"same text" in w for w in english) <= 4
    got = {r.id: r.lang for r in language.identify(docs, model).collect()}
    assert got[10_000] == "en" and got[30_000] == got[20_000] == "fr" and got[30_001] == got[30_002] == "und"


def test_held_out_languages(spark, sf):
    got = queries.op8_language(spark, sf).toPandas().merge(load(spark, sf, "documents").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna() & got.text.notna()]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_one_language_only(spark):
    docs = spark.createDataFrame([(i, "some words", "en") for i in range(9)] + [(9, "12", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {(r.id, r.lang) for r in language.identify(docs, model).collect()} == {(i, "en") for i in range(9)} | {(9, "und")}


# Personal data


def regex_spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        double = "".join(str(int(d) * 2) if i % 2 else d for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0 and double:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.RANK[s[2]]))


def test_anchors_find_what_the_patterns_find():
    rng, scanner = random.Random(13), pii.Scanner()
    for k in range(20_000):
        text = "".join(rng.choices("a@.-+ 0123456789()_%xé\n١İ" if k % 2 else "1234567890.-+ @a", k=rng.randrange(60)))
        assert [s for s in scanner.spans(text) if s[2] in pii.KINDS[:4]] == regex_spans(text), text


def test_added_kinds():
    text = "pay to IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789 (not ssn 000-45-6789), password=hunter2secret9, https://u:p@h.example/x"
    found = {(text[a:b], k) for a, b, k in pii.Scanner().spans(text)}
    assert {("DE89 3704 0044 0532 0130 00", "iban"), ("123-45-6789", "ssn"), ("hunter2secret9", "secret"), ("https://u:p@h.example/x", "url")} <= found
    assert not any(k == "ssn" and t.startswith("000") for t, k in found)
    assert "[iban]" in pii.redact(text, pii.Scanner().spans(text)) and "hunter2" not in pii.redact(text, pii.Scanner().spans(text))


def test_personal_data_of_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in load(spark, sf, "documents").collect()}
    for r in queries.op9_pii(spark, sf).collect():
        want = regex_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, _, kind in want) for k in pii.KINDS[:4])


# Toxicity


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3) | (x[:, 2] > 1.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], np.ones(2000), trees=60)
    model.calibrate(model.raw(x[:2000]), y[:2000], np.ones(2000))
    p = model.probability(x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.95
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.knots) > 0).all() and p.min() >= 0 and p.max() <= 1


def test_held_out_toxicity(spark, sf):
    got = queries.op10_toxicity(spark, sf).toPandas().merge(load(spark, sf, "labels").toPandas(), on="doc_id")
    assert (got.predicted == got.toxic).mean() > 0.9 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.85


def test_hidden_insults_and_second_person():
    classes_ = toxicity._Classes(toxicity.Lexicon(frozenset({"grumf"}), frozenset({"zork"})))
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU 1d10t ! grumf zorkel plain", classes_)))
    assert (f["hidden"], f["learned"], f["stems"], f["near_you"]) == (1, 1, 1, 3)
    assert toxicity.features(None, classes_) == [0.0] * len(toxicity.FEATURES)


# The pipeline


def slow_times(rows):
    """How often a mix takes each row of rows(id, source, size): sources clamped in turn, then documents in the order of their hashes."""
    size = defaultdict(int)
    for _, source, n in rows:
        size[source] += n
    order = sorted((x for x in size if x is not None), key=str.encode) + [None] * (None in size)
    share = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(size.values()) - sum(target.values())
        now = {x: left * share[x] / sum(share[y] for y in open_) for x in open_}
        over = {x for x in open_ if now[x] > 3 * size[x]}
        target |= {x: 3 * size[x] for x in over} if over else now
        open_ = open_ - over if over else set()
    times = {}
    for source in order:
        words = int(target[source] + 0.5)
        whole = min(3, words // size[source]) if size[source] else 0
        extra, seen = words - whole * size[source], 0
        own = Counter((int(hashlib.md5(f"0|{'' if i is None else i}".encode()).hexdigest()[:15], 16), n, i) for i, x, n in rows if x == source)
        for h, n in sorted({k[:2] for k in own}):
            alike = [(k[2], c) for k, c in own.items() if k[:2] == (h, n)]
            together = n * sum(c for _, c in alike)
            part = (extra - seen) // sum(c for _, c in alike) if seen <= extra else -1
            again = seen + together <= extra or 0 <= part and 2 * part >= n
            seen += together
            for i, c in alike:
                times[i, source, n] = c * (1 if n == 0 else whole + again)
    return times


def check_stages(spark, folder):
    """Each stage on what the stage before kept, by brute force; returns the rows of the last."""
    import corpus_pipeline

    docs = load(spark, folder, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in load(spark, folder, "benchmark").collect()]
    scores = {r.doc_id: r.predicted for r in queries.op10_toxicity(spark, folder).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        had = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
        now = docs.collect()
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns), name
        assert {str(r[: len(columns)]) for r in now} <= {str(r[: len(columns)]) for r in had}, name
        if k == 0:
            want = Counter(r.doc_id for r in had if not scores[r.doc_id])
        elif k == 1:
            least = {}
            for r, c in zip(had, slow_similar([r.text for r in had], 5, 8)):
                least[c] = min(r.doc_id if r.doc_id is not None else float("inf"), least.get(c, float("inf")))
            want = Counter(None if x == float("inf") else x for x in least.values())
        elif k == 2:
            want = Counter(r.doc_id for r in had if not brute_hits(r.text, bench, 10)[1])
        elif k == 3:
            want = Counter()
            sizes = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in had]
            for (i, _, _), n in slow_times(sizes).items():
                want[i] += n
            want = +want
        else:
            want = Counter(r.doc_id for r in had)
            table = sharding.fill(queries.SHARDS)
            for r in now:
                slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % len(table)
                assert (r.slot, r.shard) == (slot, queries.SHARDS[table[slot]])
        assert Counter(r.doc_id for r in now) == want, name
    return now


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    now = check_stages(spark, sf)
    assert now and sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, now))


def slow_similar(texts, words, least):
    """Least index by text over links of pairs whose sets of shingles have that Jaccard similarity."""
    sets = []
    for t in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x, y = label[i], label[j]
            if x != y and (a == b or 10 * len(a & b) >= least * len(a | b)):
                label = [min(x, y) if k in (x, y) else k for k in label]
    return label


@pytest.mark.parametrize("group", [shingles.GROUP, 8])
def test_near_dedup_stage_finds_every_similar_pair(spark, group, monkeypatch):
    """Copies with so many changed words that they lie on both sides of 0.8, mostly over 3 bits apart."""
    import corpus_pipeline

    monkeypatch.setattr(shingles, "GROUP", group)
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [None, "", " \n", "One", "one  TWO", "ONE two", "a b c d e", "a b c d e f"]
    for n in (30, 60, 200, 3000):
        for _ in range(5):
            base = [word() for _ in range(n)]
            for changes in (0, 0, 1, n // 60, n // 50, n // 40, n // 30, n // 12):
                copy = list(base)
                for k in rng.sample(range(n), changes):
                    copy[k] = word()
                texts.append(" ".join(copy))
    base = [word() for _ in range(50)]
    texts += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(50) for _ in range(2)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    least, by_bits = {}, {}
    for i, k, b in zip(ids, slow_similar(texts, 5, 8), classes([slow_fingerprint(t, 3) for t in texts])):
        least[k], by_bits[b] = min(i, least.get(k, i)), min(i, by_bits.get(b, i))
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(least.values()) and kept != sorted(by_bits.values())


def test_wide_fingerprints_by_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9, 700):
        rows = rng.integers(0, 2**64 - 1, (n, 3), np.uint64)
        want = [[sum(int(w) >> b & 1 for w in column) for b in range(64)] for column in rows.T]
        assert simhash._set_bits(rows).reshape(3, 64).tolist() == want
        hashes = rows[:, 0]
        found = simhash.margins(hashes)
        assert found.shape == (simhash.BLOCKS, 64) and (abs(found) <= n).all() and ((found - n) % 2 == 0).all()
        words = simhash.wide_fingerprint(found)
        assert [[w >> b & 1 for b in range(64)] for w in words] == (found[: simhash.POINT] > 0).astype(int).tolist()
        cells = simhash.sure_cells(found)
        assert cells.dtype.itemsize <= 8 and cells.max() < 2**31 and len(set(cells.tolist())) == simhash.BANDS


def test_similar_sets_share_cells_and_lie_near():
    """Sets of a similarity of just 0.8, of several sizes: all share a cell within the radius; others are far."""
    rng = np.random.default_rng(6)
    for common, left, right in ((4, 0, 1), (8, 1, 1), (8, 0, 2), (40, 5, 5), (200, 25, 25)):
        for _ in range(60):
            hashes = rng.integers(0, 2**64 - 1, common + left + right, np.uint64)
            a, b = (simhash.margins(x) for x in (hashes[: common + left], np.delete(hashes, range(common, common + left))))
            apart = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)))
            assert apart <= simhash.radius(0.8) and (simhash.sure_cells(a) == simhash.sure_cells(b)).any()
    assert shingles.least_words(0.8) == 4 and shingles.least_words(0.5) == 1 and shingles.least_words(0.81) == 5


def test_wide_links_within_cells(spark, monkeypatch):
    """Pairs of a cell within the distance, over batches of few rows; crowded cells are connected whole."""
    rng = random.Random(30)
    monkeypatch.setattr("quarry.llm.words.BATCH_ROWS", 7)
    rows = []
    for cell in range(40):
        centre = [rng.getrandbits(63) for _ in range(3)]
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((cell, *(c ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6))) for c in centre)))
    rows += [(k, *(rng.getrandbits(63) for _ in range(3))) for k in range(40) for _ in range(3)]
    df = spark.createDataFrame(rows, "cell int, s0 long, s1 long, s2 long")
    for crowd in (simhash.CROWD, 6):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        label = {p[1]: p[1] for p in rows}
        for i, x in enumerate(rows):
            for y in rows[:i]:
                if x[0] == y[0] and (sum(x[0] == r[0] for r in rows) > crowd or sum((a ^ b).bit_count() for a, b in zip(x[1:], y[1:])) <= 8):
                    a, b = sorted((label[x[1]], label[y[1]]))
                    label = {k: a if v == b else v for k, v in label.items()}
        got = {r.node: r.root for r in components.connected_components(simhash.wide_links(df, 8)).collect()}
        sizes = Counter(label.values())
        assert {k: got.get(k, k) for k in label} == label and set(got) == {k for k, v in label.items() if sizes[v] > 1}


def test_near_dedup_stage_proposes_by_simhash(spark, monkeypatch):
    """Without any distance and any shared cell of the fingerprints no different texts are linked."""
    import corpus_pipeline

    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text, "end"])), (3, " ".join(text))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()] == [1]
    monkeypatch.setattr(shingles, "radius", lambda similarity: -1)
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_near_dedup_of_repeated_ids(spark, odd, none):
    kept = shingles.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "5", "6", "None", "8", "9"])
    same = spark.createDataFrame([(3, "a b c d e", "x")] * 4 + [(3, "a b c d e", "y")] * 2, "doc_id long, text string, lang string")
    assert shingles.keep_one(same).count() == 1
    assert shingles.keep_one(none).count() == 0


def test_pipeline_over_awkward_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(i, 1, int(i == 9)) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    for folder, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        spark.createDataFrame([(1, "one two one two")], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
        rows = check_stages(spark, f"{tmp_path}/{folder}")
        assert bool(rows) == (folder == "odd")
