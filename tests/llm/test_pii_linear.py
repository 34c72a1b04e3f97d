"""The personal-data patterns in linear time: the same matches, and no crash."""

import random
import re
import time

import pytest

from trialframe.llm import pii


def plain_base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        out += [(k, m.start(), m.end()) for m in pii.BASE[kind].finditer(text) if kind == "email" or pii._passes(kind, m[0])]
    return out


def plain_wide(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.WIDE[kind].finditer(text)]


def test_tails_of_the_patterns():
    assert pii._EMAIL_TAIL.pattern == r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert pii._WIDE_EMAIL_TAIL.pattern.startswith(r"(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+")


@pytest.mark.parametrize("seed", range(6))
def test_same_matches_as_the_plain_patterns(seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "@", ".", "..", " ", "(at)", "[at]", "(dot)", "_", "%", "+", "-", "1", "255", "256", "0000012", "4111", "1111", "é", "\n", "+49 170 1234567", "1.2.3.4", "x@y.de"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_base(text), text
        assert pii.candidates(text) == plain_wide(text), text


def test_long_runs_are_read_in_seconds():
    rng = random.Random(1)
    blob = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2_000_000))
    began = time.time()
    for text in (blob, blob + "@x.de", "9" * 1_000_000, ("1.2.3." + "9" * 5000), "a." * 300_000 + "@" + "b." * 300_000, "@" * 200_000, "a (at) " * 100_000):
        pii.base_spans(text)
        pii.candidates(text)
    assert time.time() - began < 60


def test_numbers_of_any_length(spark):
    long = "9" * 10_000
    rows = [(1, f"1.2.3.{long}"), (2, f"{long}@mail.org and 0000{'0' * 6000}1.2.3.4"), (3, f"call +{long}"), (4, None), (5, "x@y.de 1.2.3.4")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["n_ip"] for k in (1, 2, 3, 4, 5)] == [0, 1, 0, 0, 1]
    assert [got[k]["n_email"] for k in (1, 2, 3, 4, 5)] == [0, 1, 0, 0, 1]
    assert re.fullmatch(r"email:0:10009,ip:14\d+:\d+|email:0:\d+,ip:\d+:\d+", got[2]["spans"])
