"""Table access for the driver-provided parquet fixtures, plus the stand-in
roles the operators are written against (see FIXTURES.md §3).

Every reader is lazy and column-pruned: callers pass the columns they need so
the parquet scan's ReadSchema only carries those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


# ---------------------------------------------------------------- stand-ins
# The fixtures carry no nulls, so the frame stand-in injects them the same way
# the oracle SQL does: every 7th event's value is missing. No row is dropped.
NULL_EVERY = 7


def frames(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """events as a per-frame series: subject=user_id, recording=(user_id,
    event_type), order=(ts, event_id), feature=value (with injected nulls)."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", *extra)
    return ev.withColumn(
        "value",
        F.when(F.col("event_id") % NULL_EVERY == 0, F.lit(None).cast("double")).otherwise(F.col("value")),
    )


def trials(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """lineitem as per-session trial rows: session=l_orderkey, trial=l_linenumber."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", *extra]
    return table(spark, sf_dir, "lineitem", *dict.fromkeys(cols))


# Row order inside a session (the reference's "file order"): trial number,
# then a tie-break that makes rows unique.
TRIAL_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


def trial_row_key():
    """The stand-in's file order as ONE long: trial number in the top bits,
    then 56 bits of md5 over the tie-break columns. A primitive ordering
    keeps ``min_by`` buffers fixed-width, so the long->wide aggregate runs as
    a HashAggregate (a struct ordering forces a sort-based aggregate that
    sorts every input row). Same value in SQL: ``TRIAL_ROW_KEY_SQL``."""
    from trialframe.operators.ordered import epoch_micros

    tie = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                      epoch_micros("l_shipdate").cast("string"),
                      (F.col("l_quantity") * 100).cast("long").cast("string"))
    h = F.conv(F.substring(F.md5(tie), 1, 14), 16, 10).cast("long")
    return F.shiftleft(F.col("l_linenumber").cast("long"), 56) + h


TRIAL_ROW_KEY_SQL = ("((CAST(l_linenumber AS BIGINT) << 56) + CAST(('0x' || substr(md5(concat_ws(':', "
                     "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(epoch_us(l_shipdate) AS VARCHAR), "
                     "CAST(CAST(l_quantity * 100 AS BIGINT) AS VARCHAR))), 1, 14)) AS BIGINT))")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, subject_id, score, cohort): orders joined to customer."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("c_acctbal").alias("score"),
        F.col("c_nationkey").alias("cohort"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels ⋈ documents: y_true=quality, score=n_chars squashed monotonically
    into (0,1) as n/(n+SCORE_SCALE), group=source. One row per labelled doc."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    doc = table(spark, sf_dir, "documents", "doc_id", "n_chars", "source")
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("double").alias("y_true"),
        F.col("toxic").cast("double").alias("y_true2"),
        F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(SCORE_SCALE)), 6).alias("score"),
        F.col("source").alias("group"),
    )


SCORE_SCALE = 5000.0
