"""Long trial rows -> one wide row per session.

The reference loops over 140 trials x 7 features per file. Here the whole
long->wide step is ONE ``groupBy(session)`` whose aggregates are conditional
on the trial number (exactly what ``pivot`` rewrites to), so it is a single
shuffle with map-side partial aggregation: a session holding a third of all
rows is pre-reduced to one partial row per map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _order_key(order: Sequence[str] | Column) -> Column:
    """A single orderable key: a Column as given (prefer a primitive long so
    aggregates stay hash-based), or a struct of column names."""
    return order if isinstance(order, Column) else order_struct(order)


def _number_in(col: str, domain: Sequence, otherwise: Column) -> Column:
    """The 0-based number of a value in a short list."""
    return F.coalesce(*[F.when(F.col(col) == F.lit(v), F.lit(i)) for i, v in enumerate(domain)], otherwise)


def pivot_first(
    df: DataFrame,
    session: str,
    trial: str,
    domain: Sequence[int],
    features: dict[str, Column],
    order: Sequence[str] | Column,
    *,
    codes: dict[str, tuple[str, Sequence[str]]] | None = None,
    session_first: dict[str, Column] | None = None,
    name: str = "trial{t}_{f}",
    session_alias: str = "session_id",
) -> DataFrame:
    """Wide row per session.

    * ``features``: output feature name -> expression over the long row; for
      trial ``t`` the value comes from the *first* row (by ``order``) whose
      ``trial == t`` (A16); trials outside the data give null (A17).
    * ``codes``: output feature name -> (column, value domain); the value of
      the first row of each trial is label-encoded by *first appearance in
      the session* (W17: code = number of distinct values seen earlier).
    * ``session_first``: session-level columns taken from the session's first
      row (P10).

    One aggregate per (trial, feature): ``min_by(value, if(trial = t, key))``.
    Coded values enter it as their number in the domain, an int: with numeric
    features and a numeric key every buffer has a fixed width and the aggregate
    is a HashAggregate (a text in one would sort all rows). A value outside its
    domain is an error, as it would shift the codes of the others.
    """
    codes = codes or {}
    session_first = session_first or {}
    key = _order_key(order)
    payload = dict(features)
    for f, (c, dom) in codes.items():
        payload[f] = _number_in(c, dom, F.lit(None))

    aggs = [
        F.min_by(e, F.when(F.col(trial) == F.lit(t), key)).alias(f"_t{t}_{f}")
        for t in domain for f, e in payload.items()
    ]
    # first position of every code value (null when the session lacks it)
    code_cols = {}
    for f, (c, dom) in codes.items():
        for i, v in enumerate(dom):
            code_cols[(f, v)] = f"_f_{f}_{i}"
            aggs.append(F.min(F.when(F.col(c) == F.lit(v), key)).alias(code_cols[(f, v)]))
        aggs.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*dom)).alias(f"_unknown_{f}"))
    for k, e in session_first.items():
        aggs.append(F.min_by(e, key).alias(f"_first_{k}"))

    g = df.groupBy(F.col(session).alias(session_alias)).agg(*aggs)

    out = [F.col(session_alias)]
    for t in domain:
        for f in features:
            out.append(F.col(f"_t{t}_{f}").alias(name.format(t=t, f=f)))
        for f, (c, dom) in codes.items():
            v_here = F.col(f"_t{t}_{f}")
            first_here = F.coalesce(
                *[F.when(v_here == i, F.col(code_cols[(f, v)])) for i, v in enumerate(dom)]
            )
            earlier = sum(
                (F.when(F.col(code_cols[(f, u)]) < first_here, 1).otherwise(0) for u in dom),
                F.lit(0),
            )
            unknown = F.raise_error(F.concat(F.lit(f"{c} has values outside its domain in "), F.col(session_alias).cast("string")))
            code = F.when(first_here.isNotNull(), earlier).cast("int")
            out.append(F.when(F.col(f"_unknown_{f}") > 0, unknown.cast("int")).otherwise(code).alias(name.format(t=t, f=f)))
    for k in session_first:
        out.append(F.col(f"_first_{k}").alias(k))
    return g.select(*out)


def pivot_onehot(
    df: DataFrame,
    session: str,
    trial: str,
    domain: Sequence[int],
    column: str,
    values: Sequence[str],
    order: Sequence[str] | Column,
    *,
    name: str = "trial{t}_{f}_{v}",
    feature: str | None = None,
    session_alias: str = "session_id",
) -> DataFrame:
    """``trial{t}_{f}_{v}`` = 1 when the first row of trial ``t`` has
    value ``v`` else 0; null when the session has no such trial. The values are
    numbered first, so that no text is in an aggregate's buffer."""
    feature = feature or column
    key = _order_key(order)
    number = _number_in(column, values, F.when(F.col(column).isNotNull(), F.lit(-1)))
    aggs = [F.min_by(number, F.when(F.col(trial) == F.lit(t), key)).alias(f"_t{t}") for t in domain]
    aggs += [F.max(F.when(F.col(trial) == F.lit(t), 1)).alias(f"_p{t}") for t in domain]
    g = df.groupBy(F.col(session).alias(session_alias)).agg(*aggs)
    out = [F.col(session_alias)]
    for t in domain:
        for i, v in enumerate(values):
            out.append(
                F.when(F.col(f"_p{t}").isNotNull(), (F.col(f"_t{t}") == i).cast("int"))
                .alias(name.format(t=t, f=feature, v=v))
            )
    return g.select(*out)


def first_seen_codes(df: DataFrame, session: str, value: str, order: Sequence[str] | Column) -> DataFrame:
    """W17 as a table: (session, value, code) with code = rank of the value's
    first appearance in the session, 0-based. The window runs over distinct
    (session, value) pairs only, so its partitions are bounded by the number
    of distinct values, not by session size."""
    from pyspark.sql import Window

    firsts = df.groupBy(session, value).agg(F.min(_order_key(order)).alias("_o"))
    w = Window.partitionBy(session).orderBy("_o")
    return firsts.select(session, value, (F.dense_rank().over(w) - 1).cast("int").alias("code"))


def missing_trials(df: DataFrame, session: str, trial: str, domain: Sequence[int]) -> DataFrame:
    """(session, trial) pairs of the fixed domain that a session lacks.

    Expressed as array_except over the per-session set of present trials, so
    no session x domain cross product is ever materialised; the per-session
    set is bounded by the domain size."""
    present = df.groupBy(F.col(session).alias("session_id")).agg(
        F.collect_set(F.when(F.col(trial).isin(*[int(t) for t in domain]), F.col(trial).cast("int"))).alias("_have")
    )
    dom = F.array(*[F.lit(int(t)) for t in domain])
    return present.select(
        "session_id", F.explode(F.array_except(dom, F.col("_have"))).alias("trial")
    )


def reorder_ids_first(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Id columns first, the rest sorted by name."""
    rest = sorted(c for c in df.columns if c not in ids)
    return df.select(*ids, *rest)
