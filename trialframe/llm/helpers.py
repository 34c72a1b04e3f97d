"""Readers and joins shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared folder (spark.checkpoint.dir).

    The setting is read from the session. Only a local master, where driver
    and executors are one machine, gets a folder of its own if it is unset.
    """
    from trialframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1 (null ids are not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def attach(big: DataFrame, small: DataFrame, key: str, weight: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left join of ``big`` with one row per key of ``small``, safe for hot keys.

    ``small[weight]`` is the key's number of rows in ``big``. Up to
    ``max_rows`` keys (counted, not estimated) the small side is broadcast.
    Beyond that the keys with at least 1/1000 of all rows, 1000 at most, are
    broadcast and the others go through a shuffle join, where none is hot.
    Null keys join with the null key of ``small``.
    """
    right = small.drop(weight).withColumnRenamed(key, "__k")
    on = F.col(key).eqNullSafe(F.col("__k"))
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(right), on, "left").drop("__k")
    total = small.agg(F.sum(weight)).scalar()
    hot = F.col(weight) * 1000 >= total
    heavy = small.where(hot).drop(weight).withColumnRenamed(key, "__k")
    rest = small.where(~hot).drop(weight).withColumnRenamed(key, "__k")
    keys = F.broadcast(heavy.select("__k"))
    return (
        big.join(F.broadcast(heavy), on, "inner").drop("__k")
        .unionByName(big.join(keys, on, "left_anti").join(rest, on, "left").drop("__k"))
    )


def need(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Only the named columns, so extra columns of any name do not clash."""
    return df.select(*cols)
