"""Integer vectors for the operators on embeddings."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 1 << 53  # whole numbers below it are exact in a double


def integer_rows(df: DataFrame, scale: int, id_col: str, vec_col: str, label: Column, parts: int = 1) -> tuple[DataFrame, int]:
    """(vec_id, label, q) of the rows whose vector has finite components only, and the width of q.

    q holds floor(scale * x) of each component x as a double. Shorter vectors
    are padded with zeros to the longest one, and that to a multiple of
    ``parts``. Components beyond the size whose squared differences might not
    fit a long (about 2**27 for 64 of them) are held at that size.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & finite)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    most = min(isqrt((1 << 60) // width), (1 << 31) - 1)
    q = F.transform("v", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * scale))).cast("int"))
    q = F.concat(q, F.array_repeat(F.lit(0), F.lit(width) - F.size("v")))
    return rows.select("vec_id", "label", q.alias("q")), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of equal length as an int64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def exact(m: np.ndarray, width: int) -> np.ndarray:
    """The integer matrix as doubles if products and squared differences of its rows stay exact in them."""
    most = int(np.abs(m).max(initial=0))
    return m.astype(np.float64) if 4 * width * most * most < EXACT else m


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Numbers of up to n of the points, each the farthest from those before it; the first is point 0."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)
