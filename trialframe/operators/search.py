"""Search over model families.

Candidates are (family, parameters) pairs. Random draws order all combinations
of a family's grid by a hash, so they are the same on every run and machine.
Every rung of the search fits its candidates on all folds but one, in one long
table of out-of-fold predictions; f1, AUC or r2 come from that table with the
same aggregates as any other predictions, so a ranking can be recomputed from
it. Successive halving starts on a share of the rows, chosen by hash, and sends
the best candidates on to more rows; the last rung has all rows.

The driver holds the candidates and their scores, one row each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.operators import metrics, models
from trialframe.operators.split import hash32
from trialframe.session import cut_lineage

Family = Callable[..., object]


@dataclass(frozen=True)
class Candidate:
    """A family with some of its parameters set; none for its defaults."""

    family: str
    parameters: tuple = ()
    name: str = field(init=False)

    def __post_init__(self):
        given = json.dumps(dict(self.parameters), sort_keys=True)
        object.__setattr__(self, "name", f"{self.family} {given}" if self.parameters else self.family)


def _combination(grid: dict[str, Sequence], index: int) -> tuple:
    out = []
    for name in sorted(grid):
        index, at = divmod(index, len(grid[name]))
        out.append((name, grid[name][at]))
    return tuple(out)


def draws(grids: dict[str, dict[str, Sequence]], n_iter: int | None, seed: int = 42) -> list[Candidate]:
    """Up to ``n_iter`` distinct combinations of each family's grid, those
    of the smallest hash (random search); all of them if it is None (grid search)."""
    out = []
    for family in sorted(grids):
        size = prod(len(v) for v in grids[family].values())
        index = range(size)
        if n_iter is not None and n_iter < size:
            index = sorted(index, key=lambda i: (hashlib.md5(f"{family}:{i}:{seed}".encode()).digest(), i))[:n_iter]
        out += [Candidate(family, _combination(grids[family], i)) for i in index]
    return out


def evaluate(df: DataFrame, label: str, fold: str, families: dict[str, Family], candidates: Sequence[Candidate], row_id: str = "row_id") -> DataFrame:
    """Long out-of-fold predictions of the candidates, written out once."""
    made = {c.name: (lambda c=c: families[c.family](**dict(c.parameters))) for c in candidates}
    return cut_lineage(models.out_of_fold(df, label, fold, made, row_id).withColumnRenamed("model", "candidate"))


def ranking(predictions: DataFrame, metric: str, by: Sequence[str] = (), regression: bool = False) -> DataFrame:
    """Scores of each candidate over all its out-of-fold predictions and its
    rank by ``metric`` (within ``by``), ties by name."""
    scores = models.prediction_scores(predictions, [*by, "candidate"], regression)
    order = [F.desc_nulls_last(metric), F.asc("candidate")]
    return metrics.top_k(scores, list(by), order, 2**31 - 1)


def shortlist(predictions: DataFrame, metric: str, k: int, regression: bool = False) -> list[str]:
    """K5: the k best candidates, best first."""
    best = ranking(predictions, metric, regression=regression).where(F.col("rank") <= k).orderBy("rank")
    return [r["candidate"] for r in best.select("candidate").collect()]


@dataclass
class Search:
    """predictions: (rung, candidate, row, fold, y_true, score, predicted);
    ranking: (rung, candidate, scores, rank, kept); best: the winner."""

    predictions: DataFrame
    ranking: DataFrame
    best: Candidate


def successive_halving(
    df: DataFrame, label: str, fold: str, families: dict[str, Family], candidates: Sequence[Candidate], metric: str = "auc", rungs: int = 3,
    eta: int = 3, row_id: str = "row_id", seed: int = 42, regression: bool = False,
) -> Search:
    """Each rung keeps the best 1 / eta of its candidates, one at
    least, and has eta times the rows; the last one has all rows."""
    left, told, ranked = list(candidates), [], []
    for rung in range(rungs):
        share = eta ** (rungs - 1 - rung)
        rows = df if share == 1 else df.where(F.pmod(hash32(row_id, seed), F.lit(share)) == 0)
        got = evaluate(rows, label, fold, families, left, row_id).withColumn("rung", F.lit(rung))
        keep = 1 if rung == rungs - 1 else max(1, ceil(len(left) / eta))
        order = ranking(got, metric, ["rung"], regression).withColumn("kept", F.col("rank") <= keep)
        best = order.where("kept").orderBy("rank").select("candidate").collect()
        by_name = {c.name: c for c in left}
        left = [by_name[r["candidate"]] for r in best]
        told.append(got)
        ranked.append(order)
    return Search(reduce(DataFrame.unionByName, told), cut_lineage(reduce(DataFrame.unionByName, ranked)), left[0])


def automatic(
    df: DataFrame, label: str, fold: str, families: dict[str, Family], grids: dict[str, dict[str, Sequence]], metric: str = "auc",
    top_models: int = 3, n_iter: int | None = 20, rungs: int = 2, eta: int = 3, row_id: str = "row_id", seed: int = 42, regression: bool = False,
) -> tuple[DataFrame, Search]:
    """All families with their defaults, the ``top_models`` best of them
    (K5) tuned by random draws, and the best of the tuned and default ones by
    ``metric``. Returns the default predictions and the search."""
    first = evaluate(df, label, fold, families, [Candidate(f) for f in sorted(families)], row_id)
    chosen = shortlist(first, metric, top_models, regression)
    todo = [Candidate(f) for f in chosen] + draws({f: grids[f] for f in chosen if f in grids}, n_iter, seed)
    return first, successive_halving(df, label, fold, families, todo, metric, rungs, eta, row_id, seed, regression)
