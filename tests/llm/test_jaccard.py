"""The pipeline's near-duplicate stage against brute force."""

import random
from fractions import Fraction

import corpus_pipeline
import pytest

from sylvagraph.llm import jaccard


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)}


def plain_kept(texts):
    sets, label = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 5 * both >= 4 * (len(x) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return [i for i in range(len(texts)) if label[i] == i]


def changed(rng, words, n):
    """``words`` with ``n`` of them changed, so a similarity anywhere from 0.7 to 1."""
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


@pytest.mark.parametrize("frequent", [1 << 18, 0])
def test_near_duplicate_stage_is_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(5)
    texts = [None, "", " ", "one two", "One  two", "one two three four five", "one two three four five six"]
    for k in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 300))]
        texts += [" ".join(changed(rng, words, round(len(words) * share))) for share in (0, 0.005, 0.015, 0.02, 0.025, 0.03)]
    notice = [f"notice{i}" for i in range(60)]
    texts += [" ".join([*notice, *(f"own{k}x{i}" for i in range(k % 30))]) for k in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs.unionByName(docs.limit(2)), "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(texts)


def test_near_duplicate_stage_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c"), (3, "c"), (3, "d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [(0, "a b"), (3, "c"), (3, "d")]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_sketches_rule_out_no_link():
    rng = random.Random(9)
    ruled_out = 0
    for _ in range(2000):
        a = [f"w{i}" for i in range(rng.randint(6, 700))]
        b = changed(rng, a, rng.randint(0, max(1, len(a) // 8))) + [f"x{i}" for i in range(rng.randint(0, len(a) // 5))]
        x, y = (jaccard.shingles_of(" ".join(words).encode()) for words in (a, b))
        may = jaccard.may_be_alike(jaccard.sketch_of(x), jaccard.sketch_of(y), len(x), len(y), Fraction(4, 5))
        assert may or not jaccard.alike(x, y, Fraction(4, 5))
        ruled_out += not may
    assert ruled_out > 500


def test_pairs_of_a_passage_are_made_once(spark):
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(400)]
    rows = []
    for node in range(30):
        mine = sorted({*rng.sample(range(400), 40), *range(100 * (node % 3), 100 * (node % 3) + 90)})
        rows += [(keys[k], node, 1000 + node, pos, node, [0] * jaccard.LONGS) for pos, k in enumerate(mine)]
    df = spark.createDataFrame(rows, "key long, node long, size int, pos int, root long, longs array<bigint>")
    made = [[tuple(r) for r in jaccard._paired(x, Fraction(4, 5)).collect()] for x in (df, jaccard._marked(df))]
    assert set(made[0]) == set(made[1]) and len(set(made[1])) > 300
    assert 4 * len(made[1]) < len(made[0])


def test_the_sample_follows_the_table(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", 40)
    passage = " ".join(f"passage{i}" for i in range(20))
    texts = [f"{passage} own{i}" if i % 25 == 0 else " ".join(f"own{i}x{j}" for j in range(7)) for i in range(2000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known, _ = jaccard._frequent(docs, "text", 5, 42)
    assert set(jaccard.shingles_of(passage.encode()).tolist()) <= set(known.tolist())
