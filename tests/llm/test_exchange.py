"""op9: rounds of exchange over single words."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sylvagraph.llm import classlm, common


def made_texts():
    rng = random.Random(4)
    nouns, verbs, small = [f"noun{i}" for i in range(30)], [f"verb{i}ed" for i in range(20)], ["the", "a", "my"]
    return [" ".join(w for _ in range(rng.randint(0, 12)) for w in (rng.choice(small), rng.choice(nouns), rng.choice(verbs))) for _ in range(150)] + [None, "", "again again again again"]


def test_best_classes_are_brute_force():
    rng, size = np.random.default_rng(2), 6
    stream = np.concatenate(([0], np.where(rng.random(3000) < 0.1, 0, rng.integers(1, 40, 3000)), [0]))
    of = np.concatenate(([0], 1 + np.arange(39) % (size - 1)))

    def table_of(classes):
        return np.bincount(classes[stream[:-1]] * size + classes[stream[1:]], minlength=size * size).reshape(size, size).astype(float)

    before, after, own = np.zeros((40, size)), np.zeros((40, size)), np.zeros(40)
    for (v, w), n in Counter(zip(stream[:-1].tolist(), stream[1:].tolist(), strict=True)).items():
        if v == w:
            own[w] += n
        else:
            before[w, of[v]] += n
            after[v, of[w]] += n
    got = classlm.best_classes(table_of(of), of[1:], before[1:], after[1:], own[1:])
    for word in range(1, 40):
        found = []
        for b in range(1, size):
            other = of.copy()
            other[word] = b
            found.append(classlm.likelihood(table_of(other)))
        assert found[got[word - 1] - 1] == pytest.approx(max(found), abs=1e-6)
    assert (got != of[1:]).any()


def test_rounds_do_not_depend_on_the_cut_and_fit_better(spark):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = ({r.doc_id: r for r in classlm.fit_and_score(docs.repartition(n), rounds=3).collect()} for n in (1, 7))
    assert [one[i].score for i in range(len(texts))] == pytest.approx([many[i].score for i in range(len(texts))])
    none = {r.doc_id: r for r in classlm.fit_and_score(docs.coalesce(1)).collect()}
    assert all(one[i][:6] == pytest.approx(none[i][:6]) for i in range(len(texts)))
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    assert sum(one[i].score - one[i].base_score for i, h in enumerate(held) if h) > 0
    empty = classlm.fit_and_score(docs.limit(0), rounds=2)
    assert empty.count() == 0


def test_rounds_leave_the_coded_texts_alone(spark):
    folder = common.shared_dir(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("table-")}
    docs, there = spark.createDataFrame(list(enumerate(made_texts())), "doc_id long, text string").repartition(3), tables()
    found = classlm.fit_and_score(docs, rounds=2)
    assert len(tables() - there) == 1 and found.count() == docs.count()
    assert spark.conf.get(common.CLEANUP) == "false"


def test_integers_are_packed_whole():
    columns = [np.array([0, 7, 1 << 30], dtype=np.int32), np.array([-5, 1 << 40, 3], dtype=np.int64)]
    for some in (columns, [x[:0] for x in columns]):
        packed = classlm._packed_ints(*some)
        assert [x.tolist() for x in classlm._unpacked_ints(packed, len(some[0]), "<i4", "<i8")] == [x.tolist() for x in some]
