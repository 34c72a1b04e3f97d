"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of the
text's word shingles, repeats included. Fingerprints that differ in at most
``radius`` bits are linked.

1. Equal fingerprints are one class; only distinct ones go on.
2. The 64 bits are cut into ``blocks`` pieces. Of two linked fingerprints at
   least ``blocks - radius`` pieces are equal, so for each choice of so many
   pieces a fingerprint enters the shard of those that agree with it there, and
   every linked pair meets in a shard. ``blocks`` is the least for which a
   shard of evenly spread fingerprints holds SHARD / 2 at most; every choice
   gives the same links.
3. Each shard is a BK-tree: the children of a node are keyed by their Hamming
   distance to it, and a search follows only the edges whose distance is within
   the radius of its own. A shard over SHARD fingerprints becomes several trees,
   and each of them is sent to every task that holds a part of the shard's
   queries. Trees travel with the shuffle, not through the driver, which must
   not hold the fingerprints of all documents.
4. Only a spanning forest of the links leaves a task; its components give the
   component of each fingerprint.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; a row belongs to the component of its own fingerprint, also where rows
repeat an id; a row with a null id has a fingerprint and no component (null),
and links nothing; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.components import components
from trialframe.llm.helpers import attach, checkpointed
from trialframe.llm.kernels import _IS_WORD_BYTE, Words, slices

BITS = 64
SEED = 42
SHARD = 4096
UNIT = 65_536
MAX_BLOCKS = 10
HASHED = 1 << 16
FRONTIER = 1 << 16


def _spaced(data: np.ndarray, w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space behind each, and their byte bounds."""
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = data[_IS_WORD_BYTE[data]]
    return out.tobytes(), ends - size, ends


def fingerprints(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text, A-Z lower-cased, as uint64."""
    out = np.zeros(len(texts), dtype=np.uint64)
    xxh64 = xxhash.xxh64_intdigest
    for i, j, data, offsets in slices(texts, lower=True):
        w = Words(data, offsets)
        raw, starts, ends = _spaced(data, w)
        words = np.diff(w.doc)
        n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(j - i), n)
        first = w.doc[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        a, b = starts[first], ends[np.minimum(first + shingle, w.doc[1:][doc]) - 1]
        ones = np.zeros((j - i, BITS), dtype=np.int64)
        for k in range(0, len(doc), HASHED):
            part = slice(k, k + HASHED)
            h = np.fromiter((xxh64(raw[x:y], SEED) for x, y in zip(a[part].tolist(), b[part].tolist())), np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            docs, at = np.unique(doc[part], return_index=True)
            ones[docs] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[i:j] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def grow(points: np.ndarray, tree: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of the points, ``tree`` the number of each one's tree.

    Returns sorted slots and the point that sits in each: slot t is the root of
    tree t, slot ``trees + 65 * p + d`` the child of point p at distance d. In
    each pass the first waiting point of a slot takes it, the others go on to
    one of its children.
    """
    slots, nodes = [], []
    waiting, at = np.arange(len(points)), tree.astype(np.int64)
    while len(waiting):
        taken, first, inverse = np.unique(at, return_index=True, return_inverse=True)
        slots.append(taken)
        nodes.append(waiting[first])
        rest = np.ones(len(waiting), dtype=bool)
        rest[first] = False
        parent, waiting = waiting[first][inverse[rest]], waiting[rest]
        at = trees + parent * (BITS + 1) + np.bitwise_count(points[waiting] ^ points[parent])
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot, node = np.concatenate(slots), np.concatenate(nodes)
    order = np.argsort(slot)
    return slot[order], node[order]


def search(
    points: np.ndarray, slots: np.ndarray, nodes: np.ndarray, trees: int, queries: np.ndarray, tree: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) numbers within the radius, in chunks; ``tree`` is the tree of each query."""
    at = np.searchsorted(slots, tree)
    found = (at < len(slots)) & (slots[np.minimum(at, len(slots) - 1)] == tree) if len(slots) else np.zeros(len(tree), bool)
    todo = [(np.flatnonzero(found), nodes[at[found]])]
    while todo:
        q, p = todo.pop()
        if len(q) > FRONTIER:
            todo += [(q[FRONTIER:], p[FRONTIER:])]
            q, p = q[:FRONTIER], p[:FRONTIER]
        d = np.bitwise_count(queries[q] ^ points[p]).astype(np.int64)
        near = d <= radius
        yield q[near], p[near]
        base = trees + p * (BITS + 1)
        a = np.searchsorted(slots, base + np.maximum(d - radius, 0))
        n = np.searchsorted(slots, base + np.minimum(d + radius, BITS), side="right") - a
        if n.any():
            child = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            todo.append((np.repeat(q, n), nodes[child]))


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a and b; parent holds each one's root before and after."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _link(radius: int):
    def run(unit: pa.Table) -> pa.Table:
        fp = unit["fp"].to_numpy().astype(np.int64).view(np.uint64)
        keys = np.column_stack([unit[c].to_numpy().astype(np.int64) for c in ("shard", "low", "high")])
        _, tree = np.unique(keys, axis=0, return_inverse=True)
        tree, trees = tree.ravel(), int(tree.max()) + 1
        # of two parts of a shard one is the tree and the other asks; a part alone is both
        asks = unit["part"].to_numpy() == keys[:, 2]
        planted = unit["part"].to_numpy() == keys[:, 1]
        own, number = np.unique(fp, return_inverse=True)
        parent = np.arange(len(own))
        points = np.flatnonzero(planted)
        slots, nodes = grow(fp[points], tree[points], trees)
        queries = np.flatnonzero(asks)
        for q, p in search(fp[points], slots, nodes, trees, fp[queries], tree[queries], radius):
            _unite(parent, number[queries[q]], number[points[p]])
        linked = np.flatnonzero(parent != np.arange(len(own)))
        return pa.table({"a": pa.array(own[linked].view(np.int64)), "b": pa.array(own[parent[linked]].view(np.int64))})

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of ``blocks - radius`` pieces, the mask of their bits, as a signed long."""
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    piece = [(1 << bounds[k + 1]) - (1 << bounds[k]) for k in range(blocks)]
    masks = [sum(piece[k] for k in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def blocks_for(fingerprint_count: int, radius: int) -> int:
    """The least number of pieces whose shards hold SHARD / 2 fingerprints on average."""
    for blocks in range(radius + 1, MAX_BLOCKS + 1):
        if fingerprint_count >> (BITS * (blocks - radius) // blocks) <= SHARD // 2:
            return blocks
    return MAX_BLOCKS


def linked(distinct: DataFrame, radius: int = 4, blocks: int | None = None, shard: int = SHARD) -> DataFrame:
    """(a, b) edges between the fingerprints (column fp, distinct longs) that
    span the components of the links."""
    spark = distinct.sparkSession
    count = distinct.count()
    blocks = blocks or blocks_for(count, radius)
    masks = block_masks(blocks, radius)
    assert len(masks) == comb(blocks, radius)
    shards: list[Column] = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)]
    entries = distinct.select("fp", F.explode(F.array(*shards)).alias("shard"))
    large = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > shard)
    entries = attach(entries, large.withColumn("rows", F.col("m")), "shard", "rows")
    bins = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), count * len(masks) // UNIT)
    parts = F.coalesce(F.ceil(F.col("m") / shard), F.lit(1)).cast("int")
    entries = entries.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts").cast("long")).cast("int"))
    entries = entries.select("fp", "shard", "parts", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    unit = F.when(F.col("parts") == 1, F.pmod("shard", F.lit(bins))).otherwise(F.xxhash64("shard", low, high))
    entries = entries.select("fp", "shard", "part", low.alias("low"), high.alias("high"), unit.alias("unit"))
    return entries.groupBy("unit").applyInArrow(_link(radius), "a long, b long")


def find(
    docs: DataFrame, radius: int = 4, shingle: int = 4, blocks: int | None = None, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs -> (id, fingerprint, component_id), one row for each of docs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = checkpointed(d.mapInArrow(sign, "doc_id long, fp long"))
    classes = signed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = checkpointed(classes)
    found = components(linked(classes.select("fp"), radius, blocks, shard)).withColumnRenamed("node", "fp")
    rooted = checkpointed(classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    roots = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = checkpointed(attach(rooted, roots, "root", "n").select("fp", "rows", "component_id"))
    out = attach(signed, of_class, "fp", "rows")
    return out.select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
