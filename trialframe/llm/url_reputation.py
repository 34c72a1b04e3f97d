"""URL filter: rule list first, else an empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain
and suffix. Each level gets a beta prior centred on the posterior mean of the
level above; its strength comes from the overdispersion that the level shows
(beta-binomial moments). A page passes if the lower posterior bound
``mean - z * sd`` of its host reaches ``min_good``.

Edge cases: a null url or one without ``://`` has empty host and path and is
judged by the empty host's posterior; repeated rows are all counted and all
returned; a page with several outcomes counts its worst; no outcomes at all
leave the uniform prior's mean everywhere; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.helpers import attach

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_RHO, MAX_RHO = 1e-4, 0.99


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (verdict, 'host/path') rule that fits, as a struct or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _domain(host: Column) -> Column:
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(F.substring_index(host, ".", -2))


def _rho(level: DataFrame) -> DataFrame:
    """Overdispersion of the counts (n, k) of a level around the means m."""
    seen, noise = F.col("n") > 0, F.col("m") * (1 - F.col("m"))
    spread = F.sum(F.when(seen, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)))
    rho = (spread - F.sum(F.when(seen, noise))) / F.nullif(F.sum(F.when(seen, (F.col("n") - 1) * noise)), F.lit(0.0))
    return level.agg(F.round(F.greatest(F.lit(MIN_RHO), F.least(F.lit(MAX_RHO), F.coalesce(rho, F.lit(0.0)))), 6).alias("rho"))


def _shrunk(level: DataFrame) -> DataFrame:
    """Posterior mean of each row of a level (columns n, k, m)."""
    strength = F.lit(1.0) / _rho(level).scalar() - 1
    return level.withColumn("strength", strength).withColumn(
        "mean", F.round((F.col("k") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength")), 9)
    )


def host_reputation(hosts: DataFrame) -> DataFrame:
    """hosts (host, n_pages, n, k) -> the same with posterior mean and sd."""
    hosts = hosts.withColumn("domain", _domain(F.col("host"))).withColumn("suffix", F.substring_index("host", ".", -1))
    total = hosts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m")).scalar()
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = _shrunk(suffixes.withColumn("m", F.round(total, 9))).select("suffix", F.col("mean").alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = _shrunk(domains.join(suffixes, "suffix")).select("domain", "suffix", F.col("mean").alias("m"))
    found = _shrunk(hosts.join(domains, ["domain", "suffix"]))
    size = F.col("n") + F.col("strength")
    return found.select("host", "n_pages", "n", "k", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)).alias("sd"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    min_good: float = 0.6,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """pages -> (id, host, path, rule, verdict, good_mean, good_bound).

    outcomes: (id, good 0/1). rules: ('allow' | 'block', 'host/path').
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    worst = outcomes.select(F.col(outcomes.columns[0]).alias("page_id"), F.col(outcomes.columns[1]).alias("good"))
    worst = worst.groupBy("page_id").agg(F.min("good").alias("good"))
    hosts = (
        parsed.select("page_id", "host").join(worst, "page_id", "left").groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    )
    known = host_reputation(hosts).select("host", "n_pages", "mean", F.round(F.col("mean") - z * F.col("sd"), 6).alias("bound"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return (
        attach(parsed, known, "host", "n_pages").withColumn("_r", rule)
        .select(
            F.col("page_id").alias(id_col), "host", "path", F.col("_r.rule").alias("rule"),
            F.coalesce(F.col("_r.verdict"), F.when(F.col("bound") >= min_good, "allow").otherwise("block")).alias("verdict"),
            F.col("mean").alias("good_mean"), F.col("bound").alias("good_bound"),
        )
    )
