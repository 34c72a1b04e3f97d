"""Spans that the trees add to the base rules: forms the patterns miss, at the asked precision."""

import random

import numpy as np
import pytest

from trialframe.llm import pii
from trialframe.llm.boosting import Block, Boosted, over

WORDS = "the a of report sent us today order number room please write and we meet on monday about it page part line".split()


def luhn(rng):
    while True:
        s = "4" + "".join(rng.choices("0123456789", k=15))
        if pii._passes("card", s):
            return s


def made(rng, form):
    name, host = rng.choice(["john", "mary", "kim", "li"]) + str(rng.randrange(99)), rng.choice(["mail", "post", "box"])
    area, line = f"{rng.randrange(200, 999)}", f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    return {
        "email": f"{name}@{host}.example.com", "phone": f"+1 ({area}) {line}", "card": luhn(rng),
        "ip": ".".join(str(rng.randrange(10, 250)) for _ in range(4)),
        "spelled": f"{name} (at) {host} (dot) com", "bare": f"{area}-{line}", "twice": " ".join([luhn(rng)] * 2),
        "at home": "meet (at) home", "run": str(rng.randrange(10**9, 10**10)), "bad card": "1234567812345678",
    }[form]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(5)
    rows, planted = [], {}
    forms = ["email", "phone", "card", "ip"] * 3 + ["spelled", "bare", "twice", "at home", "run", "bad card"]
    for k in range(2400):
        form = forms[k % len(forms)]
        text = made(rng, form)
        before, after = " ".join(rng.choices(WORDS, k=12)) + " ", " " + " ".join(rng.choices(WORDS, k=12))
        rows.append((k, before + text + after))
        planted[k] = (form, len(before), len(before) + len(text))
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return rows, planted, got


def added(found, form):
    rows, planted, got = found
    out = {}
    for k, text in rows:
        if planted[k][0] == form:
            base = pii._written(pii.base_spans(text))
            assert set(filter(None, base.split(","))) <= set(got[k]["spans"].split(","))
            out[k] = [s for s in got[k]["spans"].split(",") if s and s not in base.split(",")]
    return out


@pytest.mark.parametrize("form, kind", [("spelled", "email"), ("bare", "phone")])
def test_missed_forms_are_added(found, form, kind):
    spans = added(found, form)
    right = [k for k, s in spans.items() if s == ["{}:{}:{}".format(kind, *found[1][k][1:])]]
    assert len(right) >= 0.98 * len(spans)


def test_card_written_twice(found):
    for k, s in added(found, "twice").items():
        _, a, b = found[1][k]
        assert s == [f"card:{a}:{a + 16}", f"card:{b - 16}:{b}"]


@pytest.mark.parametrize("form", ["at home", "run", "bad card", "email", "phone", "card", "ip"])
def test_others_gain_nothing(found, form):
    spans = added(found, form)
    assert sum(map(bool, spans.values())) <= 0.02 * len(spans)


def test_rewritten_forms_escape_the_base_rules():
    rng = random.Random(2)
    for kind in pii.KINDS:
        for pick in range(40):
            text = made(rng, kind)
            new, size = pii.rewritten(kind, text, pick, False)
            assert (pii.KINDS.index(kind), 0, size) in pii._free(pii.proposals(new), pii.base_spans(new)), new


def test_free_spans():
    rng = random.Random(3)
    for _ in range(500):
        spans = [(0, a, a + rng.randrange(1, 9)) for a in rng.choices(range(40), k=6)]
        taken = [(1, a, a + rng.randrange(1, 9)) for a in rng.choices(range(40), k=rng.randrange(4))]
        assert pii._free(spans, taken) == [s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in taken)]


def test_no_base_spans_add_nothing(spark):
    rows = [(k, f"write to a{k} (at) b (dot) org") for k in range(90)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["spans"] for r in got} == {""}


def test_all_documents_are_learnt_from(spark):
    """Few addresses among many plain texts: a sample would hold too few of them."""
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(WORDS, k=8)) + f" {made(rng, 'email')} " + " ".join(rng.choices(WORDS, k=8))) for k in range(150)]
    rows += [(None, f"write to {pii.rewritten('email', made(rng, 'email'), 0, False)[0]} and we meet") for _ in range(10)]
    plain = spark.range(1000, 61_000).selectExpr("id AS doc_id", "'the report of 7 rooms' AS text")
    docs = plain.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = pii.find(docs).where("doc_id IS NULL").collect()
    assert sum(r["spans"].startswith("email:9:") for r in got) >= 9


def test_trees_do_not_depend_on_the_blocks(spark):
    """The fit over an RDD of blocks is the fit of all rows at once."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, (3000, 5)).astype(float)
    y, held = ((x[:, 0] > 20) ^ (x[:, 1] * 3 > x[:, 2]) ^ (rng.random(3000) < 0.1)).astype(float), np.arange(3000) % 3 == 0
    whole = Boosted(trees=4).fit(x, y, held)
    b = whole.binned(x)
    blocks = [Block(b[k::7], y[k::7], held[k::7], np.ones(len(y[k::7]), dtype=np.int64)) for k in range(7)]
    dealt = Boosted(trees=4).fit_blocks(whole.edges, over(spark.sparkContext.parallelize(blocks, 3)))
    assert (whole.features == dealt.features).all() and (whole.cuts == dealt.cuts).all() and (whole.values == dealt.values).all()
    assert whole.slope == pytest.approx(dealt.slope) and whole.shift == pytest.approx(dealt.shift)
