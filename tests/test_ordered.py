"""The chunked (skew-safe) scan must equal plain windows, including across
chunk boundaries, empty chunks, nulls and a hot group."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialframe.operators import ordered, series


def _rows(n_hot=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    i = 0
    for g, n in [("hot", n_hot), ("a", 7), ("b", 1), ("c", 30)]:
        for _ in range(n):
            v = None if rnd.random() < 0.3 else round(rnd.uniform(-5, 5), 3)
            rows.append((g, i, rnd.randint(0, 10_000), v))
            i += 1
    return rows


def test_scan_matches_plain_windows(spark):
    df = spark.createDataFrame(_rows(), "g string, id long, t long, v double")
    chunk = F.floor(F.col("t") / 37)  # many small chunks, some empty
    got = ordered.scan(df, "g", ["t", "id"], chunk, pos="pos", cumsum={"cs": "v"}, ffill={"ff": "v"},
                       bfill={"bf": "v"}, lag={"lg": "v"}, lead={"ld": "v"},
                       totals={"n": ("count", None), "mx": ("max", "v")})
    w = Window.partitionBy("g").orderBy("t", "id")
    exp = df.select(
        "id",
        (F.row_number().over(w) - 1).alias("pos"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ff"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("bf"),
        F.lag("v").over(w).alias("lg"), F.lead("v").over(w).alias("ld"),
        F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"),
        F.max("v").over(Window.partitionBy("g")).alias("mx"),
    )
    cols = ["id", "pos", "cs", "ff", "bf", "lg", "ld", "n", "mx"]

    def norm(rows):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)

    assert norm(got.select(*cols).collect()) == norm(exp.select(*cols).collect())


def test_rolling_blocks_match_plain_window(spark):
    df = spark.createDataFrame(_rows(), "g string, id long, t long, v double")
    d = ordered.scan(df, "g", ["t", "id"], F.floor(F.col("t") / 100), pos="p")
    got = series.centred_rolling_mean(d, "g", "p", "v", width=6, out="r", block=8)  # tiny blocks: halos matter
    w = Window.partitionBy("g").orderBy("p").rowsBetween(-3, 2)
    exp = d.select("id", F.when(F.count("v").over(w) == 6, F.avg("v").over(w)).otherwise(0.0).alias("r"))
    g = {r.id: round(r.r, 9) for r in got.select("id", "r").collect()}
    e = {r.id: round(r.r, 9) for r in exp.collect()}
    assert g == e


def test_resample_nearest_formula(spark):
    import numpy as np

    vals = [float(x) for x in range(11)]
    df = spark.createDataFrame([("r", i, v, 4) for i, v in enumerate(vals)], "g string, i long, v double, n long")
    df = df.unionByName(spark.createDataFrame([("s", i, v, 25) for i, v in enumerate(vals)],
                                              "g string, i long, v double, n long"))
    out = series.resample_nearest(df, "g", ["i"], F.col("i") / 3, ["v"], "n", index="k")
    got = {(r.g, r.k): r.v for r in out.collect()}
    for g, n in [("r", 4), ("s", 25)]:
        L = len(vals)
        for k in range(n):
            assert got[(g, k)] == vals[int(np.floor(k * L / n))]
        assert len([1 for key in got if key[0] == g]) == n
