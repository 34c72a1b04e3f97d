"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Each of ``bands * rows / 2``
permutations of the shingle hashes keeps its minimum and its maximum, so one
evaluation gives two signature values; bands of ``rows`` values are hashed and
documents that share a band hash are candidates. A pair at the threshold t is
missed by all bands with probability (1 - t**rows)**bands: under 3e-7 at 0.85
with 32 bands of 6, and at 0.8 with 38 bands of 5.

1. Documents with equal sets are one class; only its smallest id goes on.
2. Candidates are linked to the smallest id of each of their band buckets (a
   star, never all pairs); the connected components of the stars contain every
   candidate pair.
3. In each such cluster the exact links are found on full sets with an inverted
   index. Small clusters share a task; a cluster over ``BLOCK`` documents is cut
   into blocks, and each pair of blocks is a task of its own, so that memory is
   bounded and no pair is left out. Only a spanning forest of the links leaves
   a task.
4. The components of the links give the component of each class.

Edge cases: null and empty texts have an empty set and link with nothing; rows
with the same id are one document; a null id is linked with nothing, its
component is null and it is kept; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.components import components
from trialframe.llm.helpers import attach, checkpointed
from trialframe.llm.kernels import Words, gram_hashes, mix64, slices

BLOCK = 2000
BIN = 1000
CHUNK = 4096
_SIGN = "doc_id long, n long, key binary, bands array<long>"


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for i, j, data, offsets in slices(texts, lower=True):
        w = Words(data, offsets)
        h = w.hashes()
        grams = gram_hashes(h, size)
        for k in range(j - i):
            a, b = w.doc[k], w.doc[k + 1]
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:  # fewer words than a shingle: the sequence is the only one
                yield gram_hashes(h[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the set under each permutation."""
    low = np.full(len(mult), np.iinfo(np.uint32).max, dtype=np.uint64)
    high = np.zeros(len(mult), dtype=np.uint64)
    for at in range(0, len(s), CHUNK):
        v = (s[None, at : at + CHUNK] * mult[:, None]) >> np.uint64(32)
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.concatenate([low, high])


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _multipliers((bands * rows + 1) // 2)
        place = np.uint64(0xD1342543DE82EF95) ** np.arange(rows, dtype=np.uint64)
        for batch in batches:
            n, keys, sigs = [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                keys.append(np.array([np.bitwise_xor.reduce(mix64(s)) if len(s) else 0, s.sum(dtype=np.uint64), len(s)], dtype=np.uint64).tobytes())
                sigs.append(signature(s, mult))
            v = np.array(sigs, dtype=np.uint64).reshape(len(sigs), -1)[:, : bands * rows].reshape(-1, bands, rows)
            hashed = mix64((v * place).sum(2, dtype=np.uint64) + mix64(np.arange(1, bands + 1, dtype=np.uint64))[None, :])
            flat = pa.array(hashed.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), flat)],
                names=["doc_id", "n", "key", "bands"],
            )

    return run


def link_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, smaller id) edges that span the components of the links
    100 * intersection >= percent * union among distinct sets."""
    sizes = np.array([len(s) for s in sets])
    grams = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1  # a shingle of one document adds to no intersection
    owner, inverse = owner[shared], inverse[shared]
    order = np.argsort(inverse, kind="stable")
    posting, bounds = owner[order], np.searchsorted(inverse[order], np.arange(len(values) + 1))
    own = np.bincount(owner, minlength=len(sets))
    at = np.concatenate([[0], np.cumsum(own)])
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in np.flatnonzero(100 * own >= percent * sizes):
        mine = inverse[at[a] : at[a + 1]]
        if not len(mine):
            continue
        met = np.bincount(np.concatenate([posting[bounds[g] : bounds[g + 1]] for g in mine]), minlength=len(sets))
        for b in np.flatnonzero(100 * met >= percent * (sizes + sizes[a] - met)):
            x, y = root(int(a)), root(int(b))
            if x != y:
                parent[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    return [(int(ids[k]), int(ids[root(k)])) for k in range(len(sets)) if root(k) != k]


def _link(shingle: int, percent: int):
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        ids, cluster = unit["doc_id"].to_numpy(), unit["cluster"].to_numpy()
        sets = list(shingle_sets(unit["_text"], shingle))
        edges: list[tuple[int, int]] = []
        for c in np.unique(cluster):
            rows = np.flatnonzero(cluster == c)
            edges += link_forest(ids[rows], [sets[r] for r in rows], percent)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def find(
    docs: DataFrame, percent: int = 85, shingle: int = 3, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs -> (id, n_shingles, component_id, kept), one row for each of docs."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    signed = checkpointed(d.mapInArrow(_sign(shingle, bands, rows), _SIGN))
    classes = checkpointed(
        signed.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    )
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    entries = reps.select("doc_id", F.explode("bands").alias("band"))
    stars = checkpointed(entries.groupBy("band").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    clusters = components(entries.join(stars, "band").select(F.col("doc_id").alias("a"), "b"))
    clusters = checkpointed(clusters)
    sizes = checkpointed(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m")))
    bins = max(1, (sizes.where(F.col("m") <= BLOCK).agg(F.sum("m")).first()[0] or 0) // BIN)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    # a document meets every other block of its cluster in one task for each pair of blocks
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), blocks - 1), lambda o: o != mine),
        lambda o: F.xxhash64("root", F.least(o, mine), F.greatest(o, mine)),
    )
    unit = F.when(F.col("m") <= BLOCK, F.array(F.pmod(F.xxhash64("root"), F.lit(bins)))).otherwise(pairs)
    todo = attach(clusters, sizes.withColumn("rows", F.col("m")), "root", "rows")
    todo = todo.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"), F.explode(unit).alias("unit"))
    # one text for an id, should rows repeat it
    texts = d.join(todo, "doc_id").dropDuplicates(["doc_id", "unit"])
    links = texts.groupBy("unit").applyInArrow(_link(shingle, percent), "a long, b long")
    found = components(links).withColumnRenamed("node", "rep")
    of_class = classes.join(found, "rep", "left").select("key", "rows", F.coalesce("root", "rep").alias("_c"))
    out = attach(signed.select("doc_id", "n", "key"), of_class, "key", "rows")
    # a null id belongs to no component
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), mine.alias("component_id"),
        F.coalesce(mine == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
