"""A phrase in a third of the documents, with differing neighbours: its windows are spread over the tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import _brute_kept
from trialframe.llm import substring_dedup
from trialframe.llm.kernels import Words, gram_hashes

PHRASE = "all rights reserved by the owner of this page and no part of it may be copied"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(n))
    copied = [words(30) for _ in range(3)]
    out = {}
    for k in range(1500):
        parts = [words(25)]
        if k % 3 == 0:
            parts += [PHRASE, words(25)]
        if k % 20 == 0:
            parts += [copied[k % 3], PHRASE, copied[(k + 1) % 3]]
        out[k] = " ".join(parts)
    return out


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("heavy", [40, 10**9])
def test_same_as_brute_force(spark, texts, heavy):
    got = {r["doc_id"]: r["kept_text"].split() for r in substring_dedup.remove(rows(spark, texts), heavy=heavy).collect()}
    assert got == _brute_kept(texts, 20)


def test_the_phrase_is_found_and_spread(spark, texts):
    d = rows(spark, texts)
    heavy = substring_dedup.heavy_minimizers(d, 20, 100)
    data = np.frombuffer(PHRASE.encode(), dtype=np.uint8)
    grams = gram_hashes(Words(data, np.array([0, len(data)])).hashes(), substring_dedup.GRAM)
    assert 0 < len(heavy) <= 20 and np.isin(grams, heavy).any()

    def largest(split):
        sent = d.mapInArrow(substring_dedup._emit(20, split), substring_dedup._RUN)
        return sent.where("length(windows) > 0").groupBy("m").count().agg(F.max("count")).first()[0]

    assert largest(heavy[:0]) > 400
    assert largest(heavy) <= 100 + 6 * substring_dedup.LOCAL


def test_no_more_than_the_bound_are_heavy(spark, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MOST_HEAVY", 3)
    assert len(substring_dedup.heavy_minimizers(rows(spark, texts), 20, 1)) <= 3


def test_empty(spark, texts):
    assert len(substring_dedup.heavy_minimizers(rows(spark, texts).limit(0), 20, 1)) == 0
