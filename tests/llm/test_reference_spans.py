"""Suffix automata against brute force."""

import random

import numpy as np

from tests.llm.data import awkward, empty
from trialframe.llm import reference_spans as R


def _longest(known, text):
    runs = {tuple(k[a:b]) for k in known for a in range(len(k)) for b in range(a + 1, len(k) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(text))]


def test_matching_statistics():
    rng = random.Random(7)
    for _ in range(60):
        known = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        text = [rng.randrange(4) for _ in range(25)]
        a = R.SuffixAutomaton(c for k in known for c in [*k, None])
        assert list(a.matching(text)) == _longest(known, text)
        assert len(a.length) <= 2 * sum(map(len, known)) + 1


def test_remove_known(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(40)}"
    known = [[word() for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    texts = {}
    for k in range(40):
        texts[k] = [x for _ in range(4) for x in [*(word() for _ in range(rng.randrange(9))), *rng.choice(known)[rng.randrange(3) :]]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    ref = spark.createDataFrame([(" ".join(k),) for k in known] + [(None,), ("",)], "text string")
    want = {}
    windows = {tuple(k[i : i + 6]) for k in known for i in range(len(k) - 5)}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 5):
            if tuple(t[i : i + 6]) in windows:
                gone[i : i + 6] = True
        want[k] = [x for x, g in zip(t, gone) if not g]
    for shard in (R.SHARD_WORDS, 50):
        got = R.remove_known(docs, ref, span=6, shard_words=shard).collect()
        assert {r["doc_id"]: r["kept_text"].split() for r in got} == want


def test_edges(spark):
    ref = spark.createDataFrame([("quick brown fox jumps over the lazy dog and runs",)], "text string")
    got = R.remove_known(awkward(spark), ref, span=5).collect()
    assert len(got) == awkward(spark).count()
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [10, 10]
    assert R.remove_known(empty(spark), ref).collect() == []
    assert not any(r["n_removed"] for r in R.remove_known(awkward(spark), ref.limit(0)).collect())
