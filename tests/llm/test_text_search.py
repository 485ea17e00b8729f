"""License scan, lexical search and collocations against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sylvagraph.llm import collocations, lexical, licenses

ODD = [None, "", " ", "...", "a", "É漢字🙂 12.5", "x" * 5000, "word " * 20_000, "The same\nThe same", "The same\nThe same"]


def docs_of(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"])[i % len(langs or ["en"])], "s", 0, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row int")


# 11: license scans.
NOTES = [
    "Released under the MIT License.", "under the mit license under the MIT license, under-the.mit/license", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "SPDX-License-Identifier: GPL-2.0-or-later", "mit der Zeit, public domain of the open sea",
    "permission is hereby granted, free of charge, to any person obtaining a copy", "dedicated to the public domain", "Copyright (c) 2019 by nobody", "under the mit licenses; cc by ncs; apache license version 20",
]


def plain_scan(text):
    """Every rule over every text, without gates; containment by looking at all pairs."""
    bare = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).strip(" ")
    words = bare.split("  ") if bare else []
    spaced, found = f" {bare} " if bare else "", []
    for k, rule in enumerate(licenses.RULES):
        for m in re.finditer(licenses.spaced(rule.pattern), spaced):
            first = spaced[: m.start()].count(" ") // 2
            found.append((first, -(first + m.group().count(" ") // 2 - 1), -rule.priority, k))
    kept = [d for d in found if not any(e < d and e[1] <= d[1] and e[2] <= d[2] for e in found)]
    base = sorted(d for d in found if licenses.RULES[d[3]].base)
    label = lambda ds: ",".join(sorted({licenses.RULES[d[3]].label for d in ds}))
    score = max([licenses.RELEVANCE[-d[2]] for d in kept], default=0.0)
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, label(base), label([*base, *kept]), score


def test_license_scan_is_every_rule_over_every_text(spark):
    rng = random.Random(3)
    mixed = [" ".join(rng.choice(NOTES) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [*ODD, *NOTES, *mixed, "lorem ipsum " * 3000 + NOTES[2]]
    got = licenses.summary(licenses.scan(docs_of(spark, texts), ["doc_id", "a.b"]), ["doc_id", "a.b"]).collect()
    assert {r.doc_id: tuple(r)[2:] for r in got} == {i: plain_scan(t) for i, t in enumerate(texts)}
    assert {r["a.b"] for r in got} == {"clash"} and len(got) == len(texts)


def test_license_scan_suppresses_by_priority_and_containment(spark):
    row = licenses.scan(docs_of(spark, ["Licensed under CC BY-NC 4.0."]), ["doc_id"]).first()
    kept = {(d.label, d.first, d.last) for d in row.detections if d.kept}
    assert kept == {("cc-by-nc-4.0", 0, 6)} and any(d.base and not d.kept for d in row.detections)
    assert licenses.scan(docs_of(spark, ["x"]).limit(0), ["doc_id"]).count() == 0


def test_license_keywords_hold_for_what_their_rules_match():
    for rule in licenses.RULES:
        sample = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", rule.pattern)
        for _ in range(3):
            sample = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", sample)
        sample = f" {sample} ".replace(" ", "  ")
        for m in re.finditer(licenses.spaced(rule.pattern), re.sub(r"\[(.)[^\]]*\]", r"\1", sample)):
            assert rule.keyword.lstrip() in m.group(), rule


# 12: ranked lexical search.
def plain_search(docs, items, k=10):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(split(text)) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize(("least", "shard"), [(10, 64), (1000, 4096), (0, 7)])
def test_search_is_brute_force_in_all_tiers(spark, monkeypatch, least, shard):
    monkeypatch.setattr(lexical, "TIER_LEAST", least)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    texts = [*ODD, *corpus(600)]
    docs = docs_of(spark, texts).repartition(3)
    rng = random.Random(9)
    asked = [(i, t) for i, t in enumerate([*(" ".join(rng.choices([f"W{j}" for j in range(400)], k=8)) for _ in range(30)), *texts[40:50], None, "", "never-seen", "w0 w0 W0"])]
    items = spark.createDataFrame([*asked, (3, asked[3][1]), (None, "w1 w2")], "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.search(docs, items).collect()), key=str)
    assert got == plain_search(list(enumerate(texts)), [*asked, (3, asked[3][1]), (None, "w1 w2")])


def test_search_proves_items_early_and_lets_others_fall_through(spark):
    rng = random.Random(2)
    texts = [f"common{i % 3} " * rng.randint(1, 4) + " ".join(f"rare{rng.randint(0, 200)}" for _ in range(5)) for i in range(4000)]
    docs = docs_of(spark, texts).selectExpr("doc_id as id", "cast(text as binary) as text")
    items = ["rare1 rare2 rare3", "rare7 common0", "common1 common2"]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in items for w in lexical.terms(t.encode())))}
    pairs = [(number[w], i) for i, t in enumerate(items) for w in lexical.terms(t.encode())]
    _, proven = lexical.Index(docs, number).search(3, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), 10)
    assert proven[0] >= 1 and proven[-1] >= 1 and sum(proven) == 3


def test_search_of_empty_tables_repeated_and_null_ids_and_blocks(spark, monkeypatch):
    none = docs_of(spark, ["a"]).limit(0)
    items = spark.createDataFrame([(1, "a b"), (2, "b c d"), (3, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs_of(spark, ["a"]), items.limit(0)).count() == 0
    rows = [(7, "a b"), (7, "a b"), (None, "a b"), (None, "b"), (3, "a b"), (5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 2)  # a block an item, or an item longer than a block
    got = sorted((tuple(r) for r in lexical.search(docs, items, 4).collect()), key=str)
    assert got == plain_search(rows, [(1, "a b"), (2, "b c d"), (3, "a")], 4)


# 13: collocations.
def plain_collocations(rows, top=2000, least=30):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                counts.update((lang or "und", tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    out = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])
    drop = {(lang, p[i : i + n]) for (lang, p), v in out.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * v[1] >= 80 * out[lang, p[i : i + n]][1]}
    found = []
    for lang in totals:
        own = sorted(((-v[0], -v[1], " ".join(p).encode(), v) for (at, p), v in out.items() if at == lang and (lang, p) not in drop), key=lambda r: r[:3])
        found += [(lang, i + 1, p.decode(), v[1], v[2], v[3], totals[lang], v[0]) for i, (_, _, p, v) in enumerate(own[:top])]
    return sorted(found)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_collocations_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 10 * block)
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "new", "york", "city", "É", "x\x00y", "x\x1fy", *(f"r{i}" for i in range(80))]
    texts = [*ODD, *("".join(rng.choice([w.upper() if rng.random() < 0.2 else w for w in vocabulary[: rng.choice([6, 9, 89])]]) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(rng.randint(0, 80))) for _ in range(200))]
    langs = ["en", None, "de", "und", "en"]
    df = docs_of(spark, texts, langs).repartition(5)
    rows = [(langs[i % 5], t) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == plain_collocations(rows)
    assert sorted(tuple(r) for r in collocations.collocations(df, top=3, least=5).collect()) == plain_collocations(rows, 3, 5)


def test_collocations_of_hot_phrases_ties_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD_KEYS", 4)
    texts = ["new york city hall " * 50, *(f"p{i} q{i}. " * 30 for i in range(6)), "one two. " * 29]
    got = collocations.collocations(docs_of(spark, texts).repartition(4), top=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations([("en", t) for t in texts], 4)
    assert collocations.collocations(docs_of(spark, [None, "", "one two"])).count() == 0
    assert collocations.collocations(docs_of(spark, ["x"]).limit(0)).count() == 0
