"""Product codes of vectors, assigned exactly with LAESA pivots.

Vectors are cut into PARTS equal parts, each coded by the nearest entry of that
part's codebook. The distances of every part to PIVOTS fixed pivots are computed
once and kept beside the vector. In a round the distances between pivots and
entries are known too, and by the triangle inequality the largest difference
over the pivots is a lower bound of the distance of part and entry. The FIRST
entries with the lowest bounds are evaluated first; of the others only those
whose bound does not exceed the best distance so far get their exact integer
distance. Ties go to the lower index. Bounds are lowered by SLACK, more than
their rounding.

A round sums the parts of each entry inside the tasks, so at most
``parts * entries`` rows of sums reach the driver; the codebooks are that size
too. Rows are never shuffled but for the sums of their labels.

Edge cases: rows with a null vector or null or non-finite components are
dropped; rows with a null id are coded but start no codebook; of rows that
repeat an id the least vector may start one; with fewer ids than entries the
codebooks are smaller; vectors of unequal length are padded with zeros; null
labels are one label; an empty table returns no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.helpers import attach, checkpointed
from trialframe.llm.vectors import exact, integer_rows, matrix, spread

PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 8
FIRST = 8
ROWS = 1024
SLACK = 1e-9


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all points to all others, (point, other)."""
    return np.stack([((points - o) ** 2).sum(1) for o in others], axis=1)


class Codebook:
    """The entries of one part, and their distances to the part's pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries = entries
        self.to_pivots = np.sqrt(distances(entries, pivots).astype(np.float64))

    def nearest(self, points: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each point's nearest entry, and the number of exact evaluations."""
        index, squared, evaluated = [], [], 0
        for at in range(0, len(points), ROWS):
            i, s, n = self._nearest(points[at : at + ROWS], to_pivots[at : at + ROWS])
            index.append(i)
            squared.append(s)
            evaluated += n
        return np.concatenate(index), np.concatenate(squared), evaluated

    def _nearest(self, points: np.ndarray, to_pivots: np.ndarray):
        n, m = len(points), len(self.entries)
        bound = np.abs(to_pivots[:, :1] - self.to_pivots[None, :, 0])
        for k in range(1, to_pivots.shape[1]):
            np.maximum(bound, np.abs(to_pivots[:, k : k + 1] - self.to_pivots[None, :, k]), out=bound)
        bound -= SLACK * (1 + to_pivots.max(1, keepdims=True))
        np.maximum(bound, 0, out=bound)
        first = np.argpartition(bound, FIRST, axis=1)[:, :FIRST] if m > FIRST else np.broadcast_to(np.arange(m), (n, m))
        best = ((points[:, None, :] - self.entries[first]) ** 2).sum(2).min(1)
        rows, cols = np.nonzero(bound * bound <= best[:, None])
        squared = ((points[rows] - self.entries[cols]) ** 2).sum(1)
        # rows come in order, and each has a candidate: its nearest entry
        start = np.searchsorted(rows, np.arange(n))
        least = np.minimum.reduceat(squared, start)
        code = np.minimum.reduceat(np.where(squared == least[rows], cols, m), start)
        return code, least.astype(np.int64), len(rows) + first.size


def _parts(q: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(q, parts, axis=1)


def first_codebooks(rows: DataFrame, entries: int, width: int) -> np.ndarray:
    """The vectors of the smallest ids, ascending, one for each id."""
    ids = rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    last = ids.agg(F.max("vec_id")).first()[0]
    if last is None:
        return np.zeros((0, width), dtype=np.int64)
    got = rows.where(F.col("vec_id") <= last).groupBy("vec_id").agg(F.min("q").alias("q")).orderBy("vec_id").toArrow()
    return matrix(got["q"], width)


def encode(
    vectors: DataFrame, scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vectors -> (vec_id, label, code, error, label_error, codebooks_sha256)."""
    rows, width = integer_rows(vectors, scale, id_col, vec_col, F.col(label_col), parts)
    books = _parts(first_codebooks(rows, entries, width), parts)
    if not len(books[0]):
        # no id to start from: every code is empty, and there is no error to speak of
        none = F.lit(None).cast("long")
        return rows.select("vec_id", "label", F.lit("").alias("code"), none.alias("error"), none.alias("label_error"), F.sha2(F.lit(""), 256).alias("codebooks_sha256"))
    fixed = [b[spread(b, pivots)] for b in books]
    per_part = [len(f) for f in fixed]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _parts(matrix(batch["q"], width), parts)
            d = np.concatenate([np.sqrt(distances(x, f).astype(np.float64)) for x, f in zip(q, fixed)], axis=1)
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], names=[*batch.schema.names, "d"])

    kind = dict(rows.dtypes)["label"]
    stored = checkpointed(rows.mapInArrow(measure, f"vec_id long, label {kind}, q array<int>, d array<double>"))

    def coded(batch: pa.RecordBatch, now: list[Codebook]):
        d = batch["d"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        split = np.split(d, np.cumsum(per_part)[:-1], axis=1)
        q = matrix(batch["q"], width)
        return _parts(q, parts), [b.nearest(x, y)[:2] for b, x, y in zip(now, _parts(exact(q, width), parts), split)]

    def sums(now: list[Codebook]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros((parts, len(now[0].entries)), dtype=np.int64)
            total = np.zeros((*count.shape, width // parts), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    for k, (x, (code, _)) in enumerate(zip(*coded(batch, now))):
                        count[k] += np.bincount(code, minlength=count.shape[1])
                        np.add.at(total[k], code, x)
            part, entry = np.nonzero(count)
            values = np.column_stack([count[part, entry], total[part, entry]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), *(pa.array(values[:, k]) for k in range(values.shape[1]))],
                names=["part", "entry", *(f"s{k}" for k in range(values.shape[1]))],
            )

        return run

    size = width // parts + 1
    for _ in range(rounds):
        now = [Codebook(b, f) for b, f in zip(books, fixed)]
        found = stored.mapInArrow(sums(now), "part int, entry int, " + ", ".join(f"s{k} long" for k in range(size)))
        # parts * entries rows at most
        total = found.groupBy("part", "entry").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(size))).toArrow()
        at = total["part"].to_numpy(), total["entry"].to_numpy()
        values = np.column_stack([total[f"s{k}"].to_numpy() for k in range(size)])
        books = [b.copy() for b in books]
        for k in range(parts):
            mine = at[0] == k
            books[k][at[1][mine]] = values[mine, 1:] // values[mine, :1]
    now = [Codebook(b, f) for b, f in zip(books, fixed)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, found = coded(batch, now)
                codes = np.column_stack([c for c, _ in found]).astype(np.uint8)
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    out = checkpointed(stored.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"))
    of_label = checkpointed(out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    return attach(out, of_label, "label", "n").withColumn("codebooks_sha256", F.lit(digest))
