"""Hard negatives and vector codes against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import hard_negatives, pivot_codes

SCHEMA = "vec_id long, embedding array<float>, label int, q string, d string, near string, score string, rank string, range string, n string"
CLASH = tuple("own" for _ in range(7))
BAD = [[None, 1.0], [float("nan"), 0.0], [float("inf"), 0.0], [0.5, float("-inf")]]


def rows_of(rng, n, dim=8, labels=4, centres=6):
    """Vectors in clusters, some repeated, of different norms, with nulls of every kind."""
    c = rng.normal(size=(centres, dim))
    out = []
    for k in range(n):
        v = (c[rng.integers(centres)] + 0.3 * rng.normal(size=dim)) * rng.choice([0.5, 1.0, 3.0])
        out.append((k, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    out += [(n + k, out[k][1], out[(k + 1) % 5][2]) for k in range(0, 20)]  # equal vectors under other ids
    out += [out[4], out[4], out[20], (n + 40, None, 1), (n + 41, out[0][1], None), (None, out[1][1], 1)]
    out += [(n + 50 + k, b + [0.0] * (dim - 2), 1) for k, b in enumerate(BAD)]
    out += [(n + 60, [0.0] * dim, 1), (n + 61, [], 2), (n + 62, [-0.7], 0), (n + 100, [-x for x in out[0][1]], 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([r + CLASH for r in rows], SCHEMA)


def ints(v, scale, dim):
    return [math.floor(scale * x) for x in v] + [0] * (dim - len(v))


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, label, is_anchor, dim):
    kept = {(i, label(i, y), tuple(ints(v, 256, dim))) for i, v, y in rows if i is not None and y is not None and finite(v)}
    out = set()
    for a in sorted({i for i, _, _ in kept if is_anchor(i)}):
        _, y, q = min(r for r in kept if r[0] == a)
        scored = [(-sum(x * z for x, z in zip(q, p)), i, own) for i, own, p in kept if i != a]
        positives = sorted({(s, i) for s, i, own in scored if own == y})[:5]
        for s, i in positives:
            fit = sorted({(t, j) for t, j, own in scored if own != y and 30 * -s <= 100 * -t <= 90 * -s})[:10]
            out |= {(a, i, k, j, -s, -t) for k, (t, j) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3)])
def test_hard_negatives(spark, seed, block):
    rng = np.random.default_rng(seed)
    rows = rows_of(rng, 400)
    relabel = lambda i, y: (y + 1) % 10 if i % 7 == 0 else y
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(frame(spark, rows), label, F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    want = brute_negatives(rows, relabel, lambda i: i % 10 == 0, 8)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_hard_negative_thresholds_do_not_depend_on_the_sample(spark, monkeypatch):
    rows = rows_of(np.random.default_rng(5), 300)
    ask = lambda: {tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("label"), F.col("vec_id") % 9 == 0).collect()}
    want = ask()
    monkeypatch.setattr(hard_negatives, "SAMPLE", 3)
    assert ask() == want == brute_negatives(rows, lambda i, y: y, lambda i: i % 9 == 0, 8)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(8, 32))
    q = np.floor(256 * (c[rng.integers(8, size=4000)] + 0.1 * rng.normal(size=(4000, 32)))).astype(np.int64)
    norms, angles = hard_negatives.angles_to(q, q[hard_negatives.spread(q, 16)].astype(float))
    kept = 0
    for k in range(50):
        score = q @ q[k]
        low, high = np.quantile(score, [0.99, 0.999])
        rows = hard_negatives.overlapping(angles, norms, angles[:, k], float(norms[k]), low, high)
        assert set(np.flatnonzero((score >= low) & (score <= high))) <= set(rows)
        kept += len(rows)
    assert kept < 0.4 * 50 * 4000


def test_hard_negative_edges(spark):
    df = frame(spark, rows_of(np.random.default_rng(1), 50))
    for few in (df.limit(0), df.where("label is null"), df.where("embedding is null")):
        assert hard_negatives.mine(few, F.col("label"), F.col("vec_id") % 2 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("label"), F.lit(None).cast("boolean")).collect() == []
    one = df.where("vec_id = 0").limit(1)
    assert hard_negatives.mine(one, F.col("label"), F.lit(True)).collect() == []
    large = spark.createDataFrame([(1, [1e30, 2.0], 1), (2, [1e30, -1e30], 1), (3, [3e38, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert len(hard_negatives.mine(large, F.col("label"), F.lit(True), low=0, high=10**6).collect()) == 2


def brute_codes(rows, dim, entries, rounds, parts=4):
    kept = [(i, y, np.array(ints(v, 1024, dim), dtype=object)) for i, v, y in rows if finite(v)]
    w = dim // parts
    first = {}
    for i, _, q in kept:
        if i is not None:
            first[i] = min(first.get(i, list(q)), list(q))
    start = [first[i] for i in sorted(first)[:entries]]
    books = [[list(q[p * w : p * w + w]) for q in start] for p in range(parts)]

    def nearest(q, p):
        d = [sum((a - b) ** 2 for a, b in zip(q[p * w : p * w + w], e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        codes = [[nearest(q, p)[0] for p in range(parts)] for _, _, q in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [q[p * w : p * w + w] for (_, _, q), c in zip(kept, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
            books[p] = [list(e) for e in books[p]]
    found = [[nearest(q, p) for p in range(parts)] for _, _, q in kept]
    error = [sum(d for _, d in f) for f in found]
    of = {}
    for (_, y, _), e in zip(kept, error):
        of[y] = of.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, "".join("%02x" % c for c, _ in f), e, of[y], digest)) for (i, y, _), f, e in zip(kept, found, error))


@pytest.mark.parametrize("seed,n,entries", [(1, 300, 32), (2, 60, 256)])
def test_codes(spark, seed, n, entries):
    rows = rows_of(np.random.default_rng(seed), n)
    got = pivot_codes.encode(frame(spark, rows), entries=entries)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in got.collect())
    assert got == brute_codes(rows, 8, entries, 4)


def test_nearest_prunes_and_keeps_ties():
    rng = np.random.default_rng(9)
    centres = np.floor(1000 * rng.normal(size=(256, 16)))
    points = np.floor(centres[rng.integers(256, size=3000)] + 60 * rng.normal(size=(3000, 16)))
    entries = np.concatenate([centres[:128], centres[:128]])  # each twice
    pivots = entries[pivot_codes.spread(entries, 8)]
    code, squared, evaluated = pivot_codes.Codebook(entries, pivots).nearest(points, np.sqrt(pivot_codes.distances(points, pivots)))
    d = pivot_codes.distances(points, entries)
    assert (code == d.argmin(1)).all() and (squared == d.min(1)).all() and (code < 128).all()
    assert evaluated < 0.5 * d.size


def test_code_edges(spark):
    df = frame(spark, rows_of(np.random.default_rng(1), 30))
    assert pivot_codes.encode(df.limit(0)).collect() == []
    assert pivot_codes.encode(df.where("embedding is null")).collect() == []
    got = pivot_codes.encode(df.where("vec_id is null")).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in got] == [(None, "", None)]
    large = spark.createDataFrame([(1, [1e30, 2.0, 0.0, 1.0, 5.0], 1), (2, [3e38, -1e30], None)], "vec_id long, embedding array<float>, label int")
    assert [r["code"] for r in pivot_codes.encode(large).orderBy("vec_id").collect()] == ["00000000", "01010100"]
