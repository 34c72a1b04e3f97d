"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model by the
non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

whose prior (the share of positives in unlabelled text) is estimated first: a
positives-against-unlabelled model ranks both samples, and the prior is the
smallest ratio of the two upper tails. Negative labels are never used.

The fit takes bounded samples, the smallest hashes of the ids: at most
``max_positives`` trusted and ``max_unlabelled`` other documents. Every
document is scored, on whole texts.

Edge cases: null and empty texts have all-zero counts and get a score like any
other; repeated rows get equal scores; a null id is never in a sample; without
positives every score is 0.5; an empty table returns no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.helpers import held_out
from trialframe.llm.kernels import Words, gram_hashes, slices
from trialframe.llm.rules_llr import trusted_sample

MAX_POSITIVES = 10_000
MAX_UNLABELLED = 20_000
FEATURES = [
    "log_words", "upper", "digits", "exclamations", "bars", "symbols", "adjacent_repeats", "repeated_windows", "word_length",
    "stops", "lines", "non_ascii", "repeated_lines",
]


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.int64)
    t[[ord(c) for c in chars]] = 1
    return t


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _BANG, _BAR, _SYMBOL, _STOP, _LINE = (_class(c) for c in ("0123456789", "!", "|", "#$%&*<>=~^@{}[]\\", ".,;:?", "\n"))
_HIGH = (np.arange(256) >= 0x80).astype(np.int64)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text. Shares of repeats are squared: a
    repeated line or two is common in good short texts, wholesale repetition is
    not."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j, data, offsets in slices(texts):
        w = Words(data, offsets)
        h = w.hashes()
        grams = gram_hashes(h, 3)
        words = np.diff(w.doc)

        def total(flags: np.ndarray) -> np.ndarray:
            c = np.r_[0, np.cumsum(flags)]
            return c[offsets[1:]] - c[offsets[:-1]]

        capital = _UPPER[data]
        if len(data) > 1:
            capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        letters = np.maximum(1, total(_LETTER[data] | _HIGH[data]))
        size, per = np.maximum(1, np.diff(offsets)), np.maximum(1, words)
        same = np.zeros(len(h) + 1)
        if len(h) > 1:
            same[1:-1] = h[1:] == h[:-1]
            same[w.doc[:-1][w.doc[:-1] < len(h)]] = 0
        same = np.r_[0, np.cumsum(same)]
        again, lines_again = np.zeros(j - i), np.zeros(j - i)
        breaks = np.r_[np.flatnonzero(data == 10), len(data)]
        for k in range(j - i):
            a, b = w.doc[k], w.doc[k + 1] - 2
            if b > a:
                again[k] = 1 - len(np.unique(grams[a:b])) / (b - a)
            x, y = np.searchsorted(breaks, offsets[k : k + 2])
            if y > x:  # several lines
                rows = data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
                lines_again[k] = 1 - len(set(rows)) / len(rows)
        out[i:j] = np.column_stack([
            np.log1p(words), total(capital) / letters, total(_DIGIT[data]) / size, total(_BANG[data]) / per, total(_BAR[data]) / per,
            total(_SYMBOL[data]) / per, (same[w.doc[1:]] - same[w.doc[:-1]]) / per, again**2, np.diff(offsets) / per / 10,
            total(_STOP[data]) / per, total(_LINE[data]) / per, total(_HIGH[data]) / size, lines_again**2,
        ])
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """Smallest ratio of the upper tails of scores; least: positives above."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 60))
    ratio = [(unlabelled >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 800, decay: float = 1e-4) -> dict:
    """Non-negative risk minimisation on feature rows; the model as a dict."""
    if not len(positive) or not len(unlabelled):
        return {"mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "w": np.zeros(len(FEATURES) + 1), "prior": 0.5}
    both = np.vstack([positive, unlabelled])
    mean, scale = positive.mean(0), np.maximum(both.std(0), 1e-3)
    side = lambda x: np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    p, u = side(positive), side(unlabelled)

    def apart(w):
        return -((1 - _logistic(p @ w)) @ p) / len(p) + (_logistic(u @ w) @ u) / len(u) + 1e-3 * w

    w = _adam(apart, p.shape[1], 300)
    prior = class_prior(p @ w, u @ w)

    def risk(w):
        sp, su = _logistic(p @ w), _logistic(u @ w)
        # the loss of a positive taken for a negative is softplus(g)
        negative = np.mean(np.logaddexp(0, u @ w)) - prior * np.mean(np.logaddexp(0, p @ w))
        up = -prior * ((1 - sp) @ p) / len(p)
        down = (su @ u) / len(u) - prior * (sp @ p) / len(p)
        return (up + down if negative >= 0 else -down) + decay * w

    return {"mean": mean, "scale": scale, "w": _adam(risk, p.shape[1], steps), "prior": prior}


def predict(model: dict, rows: np.ndarray) -> np.ndarray:
    x = np.clip((rows - model["mean"]) / model["scale"], -8, 8)
    return np.round(_logistic(x @ model["w"][:-1] + model["w"][-1]), 6)


def train(docs: DataFrame, trusted_ids: DataFrame, max_positives: int, max_unlabelled: int, id_col: str, text_col: str) -> dict:
    """Fit on samples of docs: positives of trusted_ids, and any documents."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = d.count()
    positives = F.broadcast(trusted_sample(trusted_ids, max_positives).withColumn("_p", F.lit(True)))
    part = F.pmod(F.xxhash64("_id", F.lit("unlabelled")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_unlabelled / max(1, rows)))
    sample = d.join(positives, "_id", "left").withColumn("_u", part & ~held_out(F.col("_id"))).where("_id is not null and (_p or _u)")
    measure = F.arrow_udf(lambda t: pa.array(list(features(t)), pa.list_(pa.float64())), "array<double>")
    got = sample.select("_id", F.coalesce("_p", F.lit(False)).alias("p"), "_u", measure("_text").alias("f")).orderBy("_id", F.hash("f")).toArrow()
    f = np.array(got["f"].to_pylist()).reshape(-1, len(FEATURES))
    p, u = got["p"].to_numpy(), got["_u"].to_numpy()
    return fit(f[p], f[u])


def score(
    docs: DataFrame, trusted_ids: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
    id_col: str = "doc_id", text_col: str = "text", out_col: str = "score",
) -> DataFrame:
    """docs with a column out_col, the probability of high quality."""
    model = train(docs, trusted_ids, max_positives, max_unlabelled, id_col, text_col)
    rate = F.arrow_udf(lambda t: pa.array(predict(model, features(t)), pa.float64()), "double")
    return docs.withColumn(out_col, rate(F.col(text_col)))
