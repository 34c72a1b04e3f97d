"""Random-convolution time-series features (M14, M15), after the published
MiniROCKET method (Dempster, Schmidt & Webb, KDD 2021): 84 fixed kernels of
length 9 (weights -1, with +2 at three of the nine positions), a set of
dilations, per-(kernel, dilation) biases taken from quantiles of the
convolution output over the whole fit split, and PPV pooling (share of
positions where the output exceeds the bias). With several channels every
(dilation, kernel) has a subset of them, drawn by a hash with a size that is
exponentially less likely the larger it is, and their convolutions are summed
before the biases are taken.

Spark shape: one row per recording holding its equal-length series as an
array, one array column for each channel (M15, bounded by the resample length).
The fit picks, by hash, one recording for each (dilation, kernel) among all and
computes its quantiles in the tasks; only the biases reach the driver and go
back to the executors. The transform is a ``mapInPandas`` over Arrow batches of
recordings.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNEL_LEN = 9
BATCH = 256
# 84 kernels: every choice of 3 positions out of 9 that carry weight +2
KERNEL_INDICES = np.array(list(itertools.combinations(range(KERNEL_LEN), 3)), dtype=np.int64)


def _kernels() -> np.ndarray:
    w = -np.ones((len(KERNEL_INDICES), KERNEL_LEN), dtype=np.float32)
    for i, idx in enumerate(KERNEL_INDICES):
        w[i, idx] = 2.0
    return w


def dilations(length: int, n_features: int, n_kernels: int = 84, max_dilations: int = 32):
    """Exponentially spaced dilations and how many biases each one gets."""
    per_kernel = max(1, n_features // n_kernels)
    true_max = min(per_kernel, max_dilations)
    max_exp = np.log2(max(1.0, (length - 1) / (KERNEL_LEN - 1)))
    d, counts = np.unique(np.floor(np.logspace(0, max_exp, true_max, base=2)).astype(np.int64), return_counts=True)
    counts = counts * per_kernel // true_max
    counts[0] += per_kernel - counts.sum()
    return d, counts


def conv(x: np.ndarray, w: np.ndarray, dilation: int, pad: bool) -> np.ndarray:
    """Dilated convolution of one series with one kernel (same length when
    padded, valid part otherwise)."""
    L = x.shape[-1]
    half = (KERNEL_LEN // 2) * dilation
    if pad:
        xp = np.pad(x, (half, half))
        idx = np.arange(L)[:, None] + np.arange(KERNEL_LEN)[None, :] * dilation
    else:
        xp = x
        n = L - 2 * half
        if n <= 0:
            return np.zeros(0, dtype=np.float32)
        idx = np.arange(n)[:, None] + np.arange(KERNEL_LEN)[None, :] * dilation
    return xp[idx] @ w


@dataclass
class RocketParams:
    dilations: np.ndarray
    counts: np.ndarray
    biases: np.ndarray  # flattened per (dilation, kernel, quantile)
    channels: np.ndarray  # (dilation * kernel, channel): 1 for those that are summed

    @property
    def n_features(self) -> int:
        return int(self.biases.size)


def channel_subsets(n_pairs: int, n_channels: int, seed: int) -> np.ndarray:
    """(pair, channel) matrix of 0 and 1: each pair's subset has
    floor(2 ** u) channels, u uniform up to the logarithm of their number (9 at
    most), those of the smallest hash."""
    draw = np.random.Philox(key=[seed & (2**64 - 1), n_channels]).random_raw(n_pairs * (n_channels + 1)).reshape(n_pairs, -1)
    u = (draw[:, 0] >> np.uint64(11)) / float(1 << 53)
    size = np.floor(2 ** (u * np.log2(min(n_channels, KERNEL_LEN) + 1))).astype(np.int64).clip(1, n_channels)
    rank = draw[:, 1:].argsort(axis=1).argsort(axis=1)
    return (rank < size[:, None]).astype(np.float32)


def _series(series: str | Sequence[str]) -> list[str]:
    return [series] if isinstance(series, str) else list(series)


def _stacked(pdf, cols: Sequence[str]) -> np.ndarray:
    """(row, channel, position) values of a batch, missing ones as 0."""
    return np.stack([np.stack([np.nan_to_num(np.asarray(x, dtype=np.float32)) for x in pdf[c]]) for c in cols], axis=1)


def _quantiles(n: int) -> np.ndarray:
    # low-discrepancy quantile points, as in the method
    return np.array([(i * ((np.sqrt(5) + 1) / 2)) % 1 for i in range(1, n + 1)], dtype=np.float32)


def fit(df: DataFrame, series: str | Sequence[str], id_col: str, length: int, n_features: int = 840, seed: int = 42) -> RocketParams:
    """Biases from the whole of ``df``: every (dilation, kernel) takes the
    quantiles of one recording's convolution, that of the smallest hash of
    (id, dilation, kernel, seed). Each task proposes its smallest, with the
    quantiles; a min per pair decides. Only those quantiles reach the driver
    (``n_features`` numbers), whatever the number of recordings."""
    import pandas as pd

    cols = _series(series)
    d, counts = dilations(length, n_features)
    w = _kernels()
    pairs = [(di, k) for di in range(len(d)) for k in range(len(w))]
    salt = pd.util.hash_array(np.array([f"{di}:{k}:{seed}" for di, k in pairs], dtype=object))
    channels = channel_subsets(len(pairs), len(cols), seed)

    def propose(batches):
        best, rows = np.full(len(pairs), np.iinfo(np.uint64).max, dtype=np.uint64), [None] * len(pairs)
        for pdf in batches:
            ids = pd.util.hash_array(pdf[id_col].astype(str).to_numpy(dtype=object))
            for n, i in enumerate(ids):
                h = pd.util.hash_array(salt ^ i)
                for p in np.flatnonzero(h < best):
                    rows[p] = pdf[cols].iloc[n]
                best = np.minimum(best, h)
        out = []
        for p, (di, k) in enumerate(pairs):
            if rows[p] is not None:
                x = sum(np.nan_to_num(np.asarray(rows[p][c], dtype=np.float32)) for c, on in zip(cols, channels[p]) if on)
                c = conv(x, w[k], int(d[di]), pad=(di + k) % 2 == 0)
                q = np.quantile(c, _quantiles(int(counts[di]))) if c.size else np.zeros(int(counts[di]))
                out.append((p, int(best[p] >> np.uint64(1)), q.astype(float).tolist()))
        yield pd.DataFrame(out, columns=["p", "h", "q"])

    proposed = df.select(id_col, *cols).mapInPandas(propose, "p int, h long, q array<double>")
    chosen = {r["p"]: r["q"] for r in proposed.groupBy("p").agg(F.min_by("q", "h").alias("q")).collect()}
    if len(chosen) < len(pairs):
        raise ValueError("no recording to fit on")
    return RocketParams(d, counts, np.concatenate([chosen[p] for p in range(len(pairs))]).astype(np.float32), channels)


def transform_batch(X: np.ndarray, p: RocketParams) -> np.ndarray:
    """PPV features for a batch of equal-length series X (B, C, L) -> (B, F).

    Convolution is linear, so the channels of a pair are summed first and
    convolved once; one batched product for each (dilation, kernel)."""
    w = _kernels()
    B, C, L = X.shape
    out = np.zeros((B, p.n_features), dtype=np.float32)
    j = 0
    for di, (dil, cnt) in enumerate(zip(p.dilations, p.counts)):
        dil = int(dil)
        half = (KERNEL_LEN // 2) * dil
        at = np.arange(L)[:, None] + np.arange(KERNEL_LEN)[None, :] * dil        # (L, 9)
        subsets, of = np.unique(p.channels[di * len(w):(di + 1) * len(w)], axis=0, return_inverse=True)
        sums = np.pad(np.einsum("bcl,sc->bsl", X, subsets), ((0, 0), (0, 0), (half, half)))
        for k in range(len(w)):
            c = sums[:, of.ravel()[k]][:, at] @ w[k]                             # (B, L)
            c = c if (di + k) % 2 == 0 else c[:, half:L - half]
            if c.shape[1]:
                b = p.biases[j:j + cnt]
                out[:, j:j + cnt] = np.stack([(c > x).mean(axis=1) for x in b], axis=1)
            j += cnt
    return out


def transform_array(x: np.ndarray, p: RocketParams) -> np.ndarray:
    """Features of one recording, (L,) or (C, L)."""
    return transform_batch(np.atleast_2d(np.asarray(x, dtype=np.float32))[None], p)[0]


def transform(df: DataFrame, series: str | Sequence[str], p: RocketParams, keep: list[str], out: str = "rocket") -> DataFrame:
    """mapInPandas over Arrow batches; parameters travel in the closure
    (a few thousand floats)."""
    import pandas as pd

    cols = _series(series)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]) + f", `{out}` array<float>"

    def run(batches):
        for pdf in batches:
            # a slice at a time, so that the convolutions of a batch stay small
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at:at + BATCH]
                res = part[keep].copy()
                res[out] = pd.Series(list(transform_batch(_stacked(part, cols), p)), index=part.index)
                yield res

    return df.select(*dict.fromkeys([*keep, *cols])).mapInPandas(run, schema)


def stack_series(long: DataFrame, rec: list[str], pos: str, value: str, length: int, out: str = "series") -> DataFrame:
    """One row per recording with its values in position order, padded
    with nulls to ``length``. A longer recording raises an error: resample
    (W3) or truncate (W19) first."""
    g = long.groupBy(*rec).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("_s"))
    vals = F.transform("_s", lambda s: s["v"])
    pad = F.array_repeat(F.lit(None).cast("double"), F.lit(length) - F.size("_s"))
    long_one = F.raise_error(F.concat(F.lit(f"a recording is longer than {length}: "), F.size("_s").cast("string")))
    return g.select(*rec, F.when(F.size("_s") > length, long_one.cast("array<double>")).otherwise(F.concat(vals, pad)).alias(out))
