"""Hard negatives by angular triangle filtering.

Every vector stores its angles to REFERENCES fixed directions. The angle between
an anchor and a row lies between the largest difference and the smallest sum
(folded at pi) of their stored angles, so its cosine times both norms bounds the
inner product. The bounds are widened by SLACK, more than the rounding of the
stored angles. Only rows whose bounds overlap the scores that are still wanted
get their integer inner product computed.

1. The store: each row with its angles, ordered by its nearest reference (the
   cell) and the angle to it, range partitioned, so that no cell is hot.
2. Anchors go in blocks of about BLOCK, a stated query set; each block is sent to
   all partitions of the store. In a partition an anchor's wanted scores give a
   window of the stored angles of each cell, found by binary search; the other
   references thin it out.
3. First pass: the positives, the best rows of the anchor's label. Second pass:
   for each of them the best rows of other labels whose score lies between
   ``low`` and ``high`` percent of the positive's. The scores of a bounded sample
   (SAMPLE rows) start the thresholds; they rise with each batch. They only skip
   rows that cannot be among the best, so the result is exact.

Edge cases: rows with a null label, a null vector, or null or non-finite
components take no part, nor do rows with a null id. Rows that share an id are
each other's anchor, not each other's candidates; an anchor id's row is the one
with the least label, then vector, and of candidates equal in id and score one
counts. Vectors of unequal length are padded with zeros. A zero vector scores 0
with all. A negative positive score has no negatives, as no score is over 30 %
and under 90 % of it. An empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.helpers import checkpointed
from trialframe.llm.vectors import exact, integer_rows, matrix, spread

REFERENCES = 16
SAMPLE = 2048
BLOCK = 2048
SLACK = 2e-6
NOTHING = np.iinfo(np.int64).min


def angles_to(q: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows, and their angles to the references, (reference, row); of a zero vector 0."""
    x = q.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    unit = references / np.maximum(np.sqrt((references * references).sum(1)), 1e-300)[:, None]
    cosine = (unit @ x.T) / np.maximum(norm, 1e-300)
    return norm, np.arccos(np.clip(np.where(norm > 0, cosine, 1.0), -1, 1)).astype(np.float32)


def store(rows: DataFrame, references: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, q, cell, near, angles) in the order of cell and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, angles = angles_to(matrix(batch.column(2), width), references)
            cell = angles.argmin(0).astype(np.int32)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(references))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(angles[cell, np.arange(len(cell))]), pa.ListArray.from_arrays(offsets, pa.array(angles.T.ravel()))],
                names=["vec_id", "label", "q", "cell", "near", "angles"],
            )

    out = rows.mapInArrow(run, "vec_id long, label long, q array<int>, cell int, near float, angles array<float>")
    return checkpointed(out.repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id"))


class Best:
    """The best ``k`` (score, id) pairs: higher scores first, ties by smaller id."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """The score below which a row cannot be among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else NOTHING

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Repeated pairs count once."""
        take = self.k
        while True:
            s, i = scores, ids
            if len(s) > take:  # a cut that keeps all ties
                cut = np.partition(s, len(s) - take)[len(s) - take]
                i, s = i[s >= cut], s[s >= cut]
            all_in = len(s) == len(scores)
            s, i = np.concatenate([self.scores, s]), np.concatenate([self.ids, i])
            order = np.lexsort((i, -s))
            s, i = s[order], i[order]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
            if all_in or new.sum() >= self.k:
                break
            take *= 4
        self.scores, self.ids = s[new][: self.k], i[new][: self.k]


def overlapping(batch_angles: np.ndarray, norms: np.ndarray, angles: np.ndarray, norm: float, low: float, high: float) -> np.ndarray:
    """Which rows have score bounds that overlap low..high.

    batch_angles: (reference, row); angles, norm: of the anchor."""
    mine = angles[:, None]
    apart = np.abs(batch_angles - mine).max(0).astype(np.float64)
    scale = norms * norm
    margin = 1 + 1e-12 * scale
    keep = scale * np.cos(np.maximum(apart - SLACK, 0)) + margin >= low
    if high < np.inf:
        both = (batch_angles + mine).min(0)
        most = np.minimum(both, (np.float32(2 * np.pi) - batch_angles - mine).min(0)).astype(np.float64)
        keep &= scale * np.cos(np.clip(most + SLACK, 0, np.pi)) - margin <= high
    return np.flatnonzero(keep)


class Batch:
    """A batch of the store: runs of one cell, each ordered by the angle to it."""

    def __init__(self, batch: pa.RecordBatch, width: int, references: int):
        self.ids, self.labels = batch["vec_id"].to_numpy(), batch["label"].to_numpy()
        self.q = exact(matrix(batch["q"], width), width)
        self.norms = np.sqrt((self.q.astype(np.float64) ** 2).sum(1))
        self.near = batch["near"].to_numpy()
        flat = batch["angles"].flatten().to_numpy(zero_copy_only=False)
        self.angles = np.ascontiguousarray(flat.reshape(-1, references).T)
        cell = batch["cell"].to_numpy()
        self.bounds = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        self.cells = cell[self.bounds[:-1]]

    def wanted(self, angles: np.ndarray, norm: float, low: float, high: float) -> Iterator[np.ndarray]:
        """Rows whose bounds overlap low..high, of the window of each cell."""
        for cell, s, e in zip(self.cells, self.bounds[:-1], self.bounds[1:]):
            a, b = s, e
            if low > 0:
                most = norm * self.norms[s:e].max() + 1
                reach = np.arccos(min(1.0, low / most)) + 2 * SLACK if low <= most else -1.0
                a, b = s + np.searchsorted(self.near[s:e], [angles[cell] - reach, angles[cell] + reach])
            if a < b:
                yield a + overlapping(self.angles[:, a:b], self.norms[a:b], angles, norm, low, high)

    def scored(self, anchor: np.ndarray, angles: np.ndarray, norm: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, integer scores) of the rows whose bounds overlap low..high."""
        rows = list(self.wanted(angles, norm, low, high))
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        a = anchor.astype(self.q.dtype)
        score = (self.q @ a)[rows] if 2 * len(rows) > len(self.q) else self.q[rows] @ a
        return rows, score.astype(np.int64)


class Anchors:
    """A block of anchors: ids, labels, vectors, norms and stored angles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, references: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.norms, self.angles = angles_to(q, references)

    def of_same_label(self, k: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (labels == self.labels[k]) & (ids != self.ids[k])

    def of_other_label(self, k: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (labels != self.labels[k]) & (ids != self.ids[k])


def windows(positives: list[np.ndarray], low: int, high: int) -> list[tuple[int, int]]:
    """The score range of each positive's negatives: low% to high% of its score, both included."""
    return [(-((-low * p) // 100), (high * p) // 100) for p in positives]


def _search(anchors: Anchors, ranges: list[list[tuple[int, int]]], floors: list[list[int]], same: bool, k: int, width: int, references: int):
    """Finds, for each anchor and range, the best k rows of the store.

    ranges: wanted (lowest, highest) scores; floors: a lower bound of the k-th
    best score of each, or NOTHING. Emits (anchor, range, score, vec_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[Best(k) for _ in r] for r in ranges]
        for batch in batches:
            if not batch.num_rows:
                continue
            b = Batch(batch, width, references)
            for n, mine in enumerate(best):
                least = [max(r[0], f, w.least()) for r, f, w in zip(ranges[n], floors[n], mine)]
                open_ = [i for i, r in enumerate(ranges[n]) if least[i] <= r[1]]
                if not open_:
                    continue
                low, high = min(least[i] for i in open_), max(ranges[n][i][1] for i in open_)
                top = np.inf if high == np.iinfo(np.int64).max else float(high)
                rows, score = b.scored(anchors.q[n], anchors.angles[:, n], float(anchors.norms[n]), float(low), top)
                label = anchors.of_same_label if same else anchors.of_other_label
                fit = (score >= low) & label(n, b.ids[rows], b.labels[rows])
                rows, score = rows[fit], score[fit]
                for i in open_:
                    in_range = (score >= least[i]) & (score <= ranges[n][i][1])
                    if in_range.any():
                        mine[i].add(score[in_range], b.ids[rows[in_range]])
        out = [(n, i, s, v) for n, mine in enumerate(best) for i, w in enumerate(mine) for s, v in zip(w.scores.tolist(), w.ids.tolist())]
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "range", "score", "vec_id"])

    return run


_FOUND = "anchor int, range int, score long, vec_id long"


def _floors(anchors: Anchors, ranges: list[list[tuple[int, int]]], sample: tuple, same: bool, k: int) -> list[list[int]]:
    """The k-th best score that the sample's rows reach in each range: the best of all rows reach it too."""
    ids, labels, q = sample
    out = []
    for n, mine in enumerate(ranges):
        score = (q @ anchors.q[n].astype(q.dtype)).astype(np.int64) if len(q) else np.zeros(0, np.int64)
        fit = (anchors.of_same_label if same else anchors.of_other_label)(n, ids, labels)
        score, own = score[fit], ids[fit]
        floors = []
        for low, high in mine:
            w = Best(k)
            w.add(score[(score >= low) & (score <= high)], own[(score >= low) & (score <= high)])
            floors.append(w.least())
        out.append(floors)
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "range").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, references: int = REFERENCES, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """vectors -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    label and is_anchor are expressions of the columns of ``vectors``."""
    spark = vectors.sparkSession
    asked = vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False)))
    rows, width = integer_rows(asked, scale, id_col, vec_col, F.struct(label.cast("long").alias("label"), "__anchor"))
    rows = rows.where("label.label is not null and vec_id is not null")
    anchors = rows.where("label.__anchor").groupBy("vec_id").agg(F.min(F.struct(F.col("label.label").alias("label"), "q")).alias("x"))
    anchors = checkpointed(anchors.select("vec_id", "x.label", "x.q"))
    rows = rows.select("vec_id", F.col("label.label").alias("label"), "q")
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE).toArrow()
    q = matrix(few["q"], width)
    sample = (few["vec_id"].to_numpy(), few["label"].to_numpy(), exact(q, width))
    unit = q / np.maximum(np.sqrt((q.astype(np.float64) ** 2).sum(1)), 1e-300)[:, None]
    directions = q[spread(unit, references)].astype(np.float64)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    count = anchors.count()
    if not count or not len(directions):
        return spark.createDataFrame([], schema)
    stored = store(rows, directions, width)
    blocks = -(-count // block)
    results = []
    for part in range(blocks):
        got = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part).orderBy("vec_id").toArrow()
        if not got.num_rows:
            continue
        a = Anchors(got["vec_id"].to_numpy(), got["label"].to_numpy(), matrix(got["q"], width), directions)
        every = [[(NOTHING, np.iinfo(np.int64).max)] for _ in a.ids]
        find = _search(a, every, _floors(a, every, sample, True, n_positives), True, n_positives, width, len(directions))
        positives = _top(stored.mapInArrow(find, _FOUND), n_positives).orderBy("anchor", "rank").toArrow().to_pydict()
        chosen: list[list[tuple[int, int]]] = [[] for _ in a.ids]
        for n, score, vec_id in zip(positives["anchor"], positives["score"], positives["vec_id"]):
            chosen[n].append((score, vec_id))
        ranges = [windows([s for s, _ in c], low, high) for c in chosen]
        find = _search(a, ranges, _floors(a, ranges, sample, False, n_negatives), False, n_negatives, width, len(directions))
        negatives = _top(stored.mapInArrow(find, _FOUND), n_negatives)
        told = [(n, i, int(a.ids[n]), vec_id, score) for n, c in enumerate(chosen) for i, (score, vec_id) in enumerate(c)]
        told = spark.createDataFrame(told, "anchor int, range int, anchor_id long, positive_id long, positive_score long") if told else None
        if told is not None:
            # n_positives rows for each anchor of the block at most
            results.append(checkpointed(negatives.join(F.broadcast(told), ["anchor", "range"]).select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"),
            )))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], schema)
