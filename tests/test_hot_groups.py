"""Hot recordings, state analysers and the lightest-fold deal."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialframe import plugins
from trialframe.operators import ordered, series, split

DAY = dt.datetime(2024, 5, 1)


def frames(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3000):  # one recording, all in one day
        rows.append((k, "hot", DAY + dt.timedelta(milliseconds=rng.randrange(3_600_000)), rng.choice([None, float(rng.randrange(50))])))
    for k in range(3000, 3300):
        rows.append((k, rng.choice(["a", "b", None]), DAY + dt.timedelta(hours=rng.randrange(200)), float(rng.randrange(9))))
    return spark.createDataFrame(rows, "id long, rec string, ts timestamp_ntz, v double").repartition(6)


def test_a_hot_day_is_split_with_the_same_answers(spark):
    df = frames(spark)
    d = ordered.even_chunks(df, ["rec"], "ts", most=100)
    sizes = d.groupBy("rec", ordered.CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert sizes.where("rec = 'hot'").count() >= 30
    ck, order = F.col(ordered.CHUNK), ["ts", "id"]
    w = Window.partitionBy("rec").orderBy(*order)
    want = df.withColumns({
        "pos": F.row_number().over(w) - 1, "run": F.sum("v").over(w), "last": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "prev": F.lag("v").over(w),
        "dt_s": ordered.micros_between(F.lag("ts").over(w), "ts") / 1e6,
    })
    want = {r["id"]: (r["pos"], r["run"], r["prev"], r["dt_s"]) for r in want.collect()}
    got = ordered.scan(d, ["rec"], order, ck, pos="pos", cumsum={"run": "v"}, lag={"prev": "v"})
    got = series.intervals(got, ["rec"], order, ck, "ts")
    assert {r["id"]: (r["pos"], r["run"], r["prev"], r["dt_s"]) for r in got.collect()} == want
    filled = series.fill_forward_backward(d, ["rec"], order, ck, ["v"])
    plain = series.fill_forward_backward(df, ["rec"], order, ordered.time_chunk("ts"), ["v"])
    assert sorted(map(str, filled.select("id", "v").collect())) == sorted(map(str, plain.select("id", "v").collect()))


def test_small_buckets_are_left_alone(spark):
    d = ordered.even_chunks(frames(spark), ["rec"], "ts")
    assert dict(d.dtypes)[ordered.CHUNK] == "bigint"
    assert ordered.even_chunks(frames(spark).limit(0), ["rec"], "ts").collect() == []


def _moments(spark):
    return plugins.state_analyser(
        "moments", "n long, mean double, sd double, biggest double",
        init=lambda: (0, 0.0, 0.0, None),
        update=lambda s, p: _merge(s, (int(p["v"].notna().sum()), p["v"].sum() / max(1, p["v"].notna().sum()), float(((p["v"] - p["v"].mean()) ** 2).sum()), p["v"].max())),
        merge=_merge, finish=lambda s: {"n": s[0], "mean": s[1] if s[0] else None, "sd": (s[2] / s[0]) ** 0.5 if s[0] else None, "biggest": s[3]},
    )


def _merge(a, b):
    n = a[0] + b[0]
    if not b[0]:
        return a
    if not a[0]:
        return b
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, max(a[3], b[3])


@pytest.mark.parametrize("held", [10_000, 1])
def test_state_analyser_of_a_hot_recording(spark, monkeypatch, held):
    monkeypatch.setattr(plugins, "MAX_HELD_STATES", held)
    df = frames(spark)
    a = _moments(spark)
    got = {r["rec"]: r for r in plugins.run_state_analyser(df, ["rec"], a).collect()}
    want = df.groupBy("rec").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max("v").alias("biggest")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r["rec"]]["n"] == r["n"] and got[r["rec"]]["biggest"] == r["biggest"]
        assert np.isclose(got[r["rec"]]["mean"], r["mean"]) and np.isclose(got[r["rec"]]["sd"], r["sd"])
    both = plugins.run_analysers(df.withColumn("detected", F.col("v").isNotNull()), ["rec"], ["detection", "moments"]).collect()
    assert {r["rec"]: r["n"] for r in both} == {r["rec"]: r["valid_detections"] for r in both}


def greedy(sizes, k):
    weight, out = [0] * k, []
    for s in sizes:
        i = weight.index(min(weight))
        weight[i] += s
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_deal_equals_the_sequential_one(seed):
    rng = random.Random(seed)
    k = rng.randrange(1, 8)
    sizes = sorted((rng.choice([1, 1, 1, 2, 3, 7, 40, 1000]) for _ in range(rng.randrange(0, 400))), reverse=True)
    runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    got = [turn[i % len(turn)] for _, _, n, turn in split.greedy_deal(runs, k) for i in range(n)]
    assert got == greedy(sizes, k)


def test_deal_of_very_many_groups():
    deal = split.greedy_deal([(10**9, 1), (3, 10**10), (1, 10**12)], 5)
    assert sum(n for _, _, n, _ in deal) == 1 + 10**10 + 10**12 and len(deal) <= 15


def test_group_folds(spark):
    rng = random.Random(2)
    rows = [(f"g{g}" if g else None, i) for g in range(60) for i in range(rng.choice([1, 2, 2, 5, 30]))]
    got = split.group_kfold(spark.createDataFrame(rows, "g string, i int"), "g", 4).collect()
    assert len(got) == len(rows)
    fold = {}
    for r in got:
        assert fold.setdefault(r["g"], r["fold"]) == r["fold"]
    size = {g: sum(1 for x, _ in rows if x == g) for g in fold}
    weight = [sum(size[g] for g in fold if fold[g] == f) for f in range(4)]
    sizes = sorted(size.values(), reverse=True)
    want = [0] * 4
    for s, f in zip(sizes, greedy(sizes, 4)):
        want[f] += s
    assert weight == want


def test_value_scores_and_ranks(spark):
    rows = [("a", 1.0, 1.0, 0.9), ("a", 0.0, 1.0, 0.6), ("b", 1.0, 1.0, 0.8), ("b", 0.0, 0.0, 0.1), ("c", None, None, None)]
    p = spark.createDataFrame(rows, "model string, y_true double, predicted double, score double")
    s = plugins.score_values(p, ["model"], ["mae", "brier", "r2"])
    by = {r["model"]: r for r in s.collect()}
    assert by["a"]["mae"] == 0.5 and by["b"]["mae"] == 0.0 and by["b"]["r2"] == 1.0 and np.isclose(by["b"]["brier"], 0.025)
    assert [r["model"] for r in plugins.rank_by(s, "mae", "model").orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r["model"] for r in plugins.rank_by(s, "r2", "model").orderBy("rank").collect()] == ["b", "a", "c"]
