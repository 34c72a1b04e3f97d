"""What is taken for obfuscated, and the decoder against all readings."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from trialframe.llm import toxicity
from trialframe.llm.kernels import Words

VOCABULARY = "you are a killer and i am kill the idiot ass idiots we will kill him is fool they all bad ones an ask as asset class pass".split()


@pytest.fixture(scope="module")
def lm():
    text = " ".join(np.random.default_rng(0).choice(VOCABULARY, 20_000))
    n = np.zeros(toxicity.CLASSES**3)
    for b in toxicity._lm_counts([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])]):
        n[b.column(0).to_numpy()] = b.column(1).to_numpy()
    n = n.reshape([toxicity.CLASSES] * 3)
    two = (n.sum(0) + 0.1) / (n.sum((0, 2))[:, None] + 0.1 * toxicity.CLASSES)
    return np.log((n + 5 * two) / (n.sum(2)[:, :, None] + 5)).astype(np.float32)


def restored(text, lm):
    return [plain for *_, pairs in toxicity.document_features(pa.array([text]), lm) for _, _, plain in pairs]


@pytest.mark.parametrize(
    "text, plain",
    [
        ("you i d 1 o t", "idiot"), ("k 1 l l him", "kill"), ("an i.d.1.o.t here", "idiot"), ("a55", "ass"), ("you a$$, yes", "ass"),
        ("you are a k i l l e r", "a killer"), ("I a m a k i l l e r.", "i am a killer"), ("i d i o t, yes", "idiot"), ("1diots!", "idiots"),
        ("kiiiill", "kill"), ("k-i-l-l", "kill"), ("k1ll$", "kills"),
    ],
)
def test_combined_forms_are_restored(text, plain, lm):
    assert restored(text, lm) == [plain]


@pytest.mark.parametrize("text", ["", "idiot!", "1 2 3 4", "3.14.15.9", "192.168.1.10", "x 1 2 3", "we are, all; fine.", "!!! ... $$$", "a b", "100"])
def test_plain_text_has_no_lattice(text, lm):
    assert restored(text, lm) == []


def test_spaced_runs_end_with_their_text():
    texts = ["k i", "l l", "a k i l l"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    assert toxicity.suspects(Words(data, np.r_[0, np.cumsum([len(t) for t in texts])])) == [(2, "a k i l l")]


def readings(text, lm):
    """(score, words) of every way through the lattice, none merged."""
    paths = [(0.0, 0, 0, "", "")]
    for i, ch in enumerate(text):
        new = []
        for s, a, b, out, last in paths:
            if ch in toxicity.SEPARATING + " ":
                new.append((s + toxicity.SKIP, a, b, out, last))
            keep = 0.0 if ch.isalpha() else toxicity.KEEP_SPACE if ch == " " else toxicity.KEEP_SIGN
            for x, cost in [(ch, keep), *((x, toxicity.SUBSTITUTE) for x in toxicity.IMITATES.get(ch, ""))]:
                if i and text[i - 1] == ch and x == last:
                    new.append((s + toxicity.COLLAPSE, a, b, out, last))
                c = int(toxicity._CLASS[ord(x)])
                new.append((s + cost + float(lm[a, b, c]), b, c, out + x, x))
        paths = new
    return [(s + float(lm[a, b, 0]), out) for s, a, b, out, _ in paths]


def test_decoder_against_all_readings(lm):
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choices("aikls1$05 .-", k=rng.randrange(1, 8)))
        every = readings(text, lm)
        best = max(s for s, _ in every)
        assert toxicity.decode(text, lm) in {out for s, out in every if s > best - 1e-6}, text


def test_long_tokens_in_seconds(lm):
    began = time.time()
    for text in ("!" * 1_000_000 + "a1a", "k1" * 100_000, "k i " * 50_000, "a" + "." * 1_000_000 + "b1b"):
        restored(text, lm)
    assert time.time() - began < 60
