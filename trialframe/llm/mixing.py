"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate ``repeat * share * N / n_source``. A
document's number of copies is a Poisson draw with that mean, found by
inverting the distribution at a uniform number hashed from the document's id
and a seed: the same on every run, partitioning and retry. Copies are exploded
and sorted by another hash, a global shuffle.

Means above ``PART`` are drawn as a sum of independent Poisson parts, so the
inverted table stays short whatever the rate.

Edge cases: a null source is a source of its own; a null id hashes as the text
'null'; rows with the same id get the same count; a share that is missing or
zero gives no copies; null and empty texts are copied like others; an empty
table returns no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.helpers import attach

PART = 32.0


def hashed_uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _cdf(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... until they reach 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c"),
        ),
        lambda a: F.transform(a["c"], lambda x: F.round(x, 12)),
    )
    return step


def source_rates(docs: DataFrame, shares: dict[str, float] | None, repeat: float, source_col: str) -> DataFrame:
    """(source, n, rate, parts, cdf) of every source; equal shares if None."""
    counts = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("sources"))).scalar()
    if shares is None:
        share = F.lit(1.0) / totals["sources"]
    else:
        share = F.lit(0.0)
        for name, w in shares.items():
            share = F.when(F.col(source_col) == name, F.lit(float(w))).otherwise(share)
    rate = F.round(F.lit(repeat) * share * totals["rows"] / F.col("n"), 9)
    return (
        counts.withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
        .withColumn("cdf", _cdf(F.col("rate") / F.col("parts")))
    )


def replicate(
    docs: DataFrame,
    shares: dict[str, float] | None = None,
    repeat: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs -> a row for each copy, globally shuffled, with copy_no (from 1),
    the source's rate as mix_rate, and shuffle_key, the order of the rows.

    Own columns of docs with these three names are replaced.
    """
    docs = docs.drop("copy_no", "mix_rate", "shuffle_key")
    rates = source_rates(docs, shares, repeat, source_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    known = rates.select(F.col(source_col), "n", F.struct("rate", "parts", "cdf").alias("__mix"))
    # no copies of what cannot be drawn: the smallest k whose cumulative probability exceeds u
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("__mix.parts")), F.lit(0),
        lambda acc, part: acc + F.size(F.filter(F.col("__mix.cdf"), lambda c: c <= hashed_uniform(key, part.cast("string"), F.lit(seed)))),
    )
    one = F.size(F.filter(F.col("__mix.cdf"), lambda c: c <= F.col("__u")))
    out = attach(docs, known, source_col, "n").withColumn("__u", hashed_uniform(key, F.lit("1"), F.lit(seed)))
    out = out.withColumn("__copies", F.when(F.col("__mix.parts") == 1, one).otherwise(draw)).where("__copies > 0")
    out = out.withColumn("mix_rate", F.col("__mix.rate")).drop("__mix", "__u")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")
    digits = F.substring(F.md5(F.concat_ws(":", key, F.col("copy_no").cast("string"), F.lit(seed), F.lit("order"))), 1, 15)
    out = out.withColumn("shuffle_key", F.conv(digits, 16, 10).cast("bigint"))
    return out.orderBy("shuffle_key", id_col, "copy_no")
