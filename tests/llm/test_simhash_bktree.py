"""Fingerprints, BK-trees and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.data import awkward, empty
from trialframe.llm import simhash_bktree as op


def fingerprint(text, shingle=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(points, radius):
    """Of distinct fingerprints, by comparing all pairs."""
    points = sorted(points)
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if bin(p ^ q).count("1") <= radius:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def near(rng, n, bits=64):
    """Fingerprints in clusters whose members differ in few bits."""
    out = set()
    while len(out) < n:
        p = rng.getrandbits(bits)
        for _ in range(rng.randint(1, 12)):
            out.add(p)
            for _ in range(rng.randint(1, 6)):
                p ^= 1 << rng.randrange(bits)
    return sorted(out)[:n]


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_fingerprints_of_whole_texts():
    rng = random.Random(1)
    seps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c "]
    texts = [None, "", " \n", "One", "a b c", "A b C d", "é ß 漢字 x y", "a b c d e f"]
    texts += ["".join(rng.choice(["w%d" % rng.randrange(9), "ÀB", "Z"]) + rng.choice(seps) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts.append(" ".join("w%d" % rng.randrange(500) for _ in range(70_000)))
    got = op.fingerprints(pa.array(texts, pa.string()))
    assert got.tolist() == [fingerprint(t) for t in texts]
    assert op.fingerprints(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_trees_find_all_within_the_radius(radius):
    rng = random.Random(radius)
    points = np.array(near(rng, 700), dtype=np.uint64)
    tree = np.arange(700) % 5
    slots, nodes = op.grow(points, tree, 5)
    assert sorted(nodes.tolist()) == list(range(700))
    queries, of = points[:300], np.arange(300) % 6  # tree 5 has no points
    got = {(int(q), int(p)) for a, b in op.search(points, slots, nodes, 5, queries, of, radius) for q, p in zip(a, b)}
    want = {(q, p) for q in range(300) for p in range(700) if tree[p] == of[q] and bin(int(queries[q]) ^ int(points[p])).count("1") <= radius}
    assert got == want


def test_search_follows_only_edges_within_the_radius(monkeypatch):
    rng = random.Random(3)
    points = np.array([rng.getrandbits(64) for _ in range(5000)], dtype=np.uint64)
    tree = np.zeros(5000, dtype=np.int64)
    slots, nodes = op.grow(points, tree, 1)
    seen = 0
    count = np.bitwise_count

    def counted(x):
        nonlocal seen
        seen += len(x)
        return count(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    list(op.search(points, slots, nodes, 1, points[:100], tree[:100], 4))
    assert seen < 0.6 * 100 * 5000


@pytest.mark.parametrize("blocks,shard", [(5, 4096), (6, 4096), (7, 20), (None, 7), (8, 4096)])
def test_links_of_any_cut(spark, blocks, shard):
    rng = random.Random(7)
    points = near(rng, 250) + near(rng, 80, bits=9)
    points = list(dict.fromkeys(points))
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in op.linked(df, 4, blocks, shard).collect()]
    want = components(points, 4)
    assert all(want[a] == want[b] for a, b in edges)
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in points} == want


def test_blocks_grow_with_the_corpus():
    assert [op.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**10)] == [5, 5, 6, 7]
    assert all(len({m for m in op.block_masks(b, 4)}) == len(op.block_masks(b, 4)) for b in range(5, 9))


def test_documents(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(3, 120))) for _ in range(60)]
    texts = [None, "", "  "] + base + base[:10]
    for t in base[:40]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append("\n".join(words).upper())
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(100, texts[5]), (None, base[0]), (None, "alone with no id at all")]
    got = op.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [fingerprint(t) for _, t in rows]
    root = components(set(prints), 4)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    want = sorted((str(d), f"{p:016x}", str(least[root[p]] if d is not None else None)) for (d, _), p in zip(rows, prints))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want


def test_edges(spark):
    docs = awkward(spark)
    got = op.find(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    by = {r["doc_id"]: r for r in got}
    assert {by[k]["fingerprint"] for k in (3, 4, 5)} == {"0" * 16} and {by[k]["component_id"] for k in (3, 4, 5)} == {3}
    assert by[2]["component_id"] == 1 and by[None]["component_id"] is None
    assert op.find(empty(spark)).collect() == []
    assert op.find(docs.where(F.col("doc_id").isNull())).collect()[0]["component_id"] is None
