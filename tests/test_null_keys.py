"""No row is lost to a null key, a null order value or a wide frame; hot and
packed values give the same answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.operators import joins, metrics, ordered, prep, series, split, summary


@pytest.fixture()
def rows(spark):
    data = [("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 2, 9.0), ("a", None, 7.0), ("b", 4, None)]
    return spark.createDataFrame(data, "g string, t long, v double")


def _chunk():
    return ordered.int_chunk("t", 1)


OPERATORS = {
    "fill": lambda d: series.fill_forward_backward(d, "g", ["t"], _chunk(), ["v"]),
    "zscore": lambda d: series.zscore(d, "g", ["v"], "_z"),
    "minmax": lambda d: series.minmax_scale(d, "g", ["v"], "_s"),
    "detrend": lambda d: series.detrend(d, "g", "t", "v"),
    "cumsum": lambda d: series.cumsum_clip(d, "g", ["t"], _chunk(), "v", 0.0, 100.0),
    "intervals_position": lambda d: ordered.scan(d, "g", ["t"], _chunk(), pos="p", totals={"n": ("count", None)}),
    "truncate": lambda d: series.truncate(d, "g", ["t"], _chunk(), n=10),
    "mirror": lambda d: joins.mirror_by_group_range(d, "g", "v", "m"),
    "factorize": lambda d: series.factorize(d, "g", ["v", "t"]),
    "group_kfold": lambda d: split.group_kfold(d, "g", 2),
    "logo": lambda d: split.leave_one_group_out(d, "g"),
    "split": lambda d: split.train_test_split(d.withColumn("i", F.coalesce("t", F.lit(0))), "i", stratify="g").drop("i"),
    "stratified": lambda d: split.stratified_kfold(d.withColumn("i", F.coalesce("t", F.lit(0))), "i", "g", 2).drop("i"),
    "quality": lambda d: series.quality_filter(d, "g", ["v"], 1.1),
    "rolling": lambda d: series.rolling(d.withColumn("t", F.coalesce("t", F.lit(3))), "g", "t", -1, 1, {"s": F.sum("v")}),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_keys_stay(rows, name):
    got = OPERATORS[name](rows).collect()
    assert sorted(str(r["g"]) for r in got) == ["None", "None", "a", "a", "a", "b"]
    assert sorted(str(r["v"]) for r in got if r["g"] is None) == ["5.0", "9.0"]


def test_null_group_is_one_group(rows):
    got = ordered.scan(rows, "g", ["t"], _chunk(), pos="p", cumsum={"c": "v"}, lag={"l": "v"}, totals={"n": ("count", None)})
    assert sorted((r["p"], r["c"], r["l"], r["n"]) for r in got.where("g is null").collect())[1] == (1, 14.0, 5.0, 2)
    h = summary.histogram(rows, "v", 2, ["g"]).where("g is null").collect()
    assert sorted((r["bin"], r["n"]) for r in h) == [(0, 1), (1, 1)]


def test_frame_wider_than_a_block(spark):
    d = spark.range(8).select(F.lit("r").alias("rec"), F.col("id").alias("p"), F.col("id").cast("double").alias("x"))
    wide = series.centred_rolling_mean(d, "rec", "p", "x", 8, block=2)
    whole = series.centred_rolling_mean(d, "rec", "p", "x", 8)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, whole.collect()))
    assert [r["x_roll"] for r in wide.orderBy("p").collect()] == [0, 0, 0, 0, 3.5, 0, 0, 0]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    groups = {"hot": rng.normal(size=4000), "ties": np.repeat([1.0, 2.0, 5.0], 40), "one": np.array([3.0]), "packed": 0.5 + rng.random(500) * 1e-9}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("hot", None), (None, 2.0), (None, 4.0), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "odd": 0.37, "hi": 1.0}
    got = {r["g"]: r for r in summary.exact_quantiles(df, ["g"], "v", probs).collect()}
    groups[None] = np.array([2.0, 4.0])
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        assert np.allclose([got[g][n] for n in probs], np.quantile(v, list(probs.values())), atol=1e-12)
    whole = summary.exact_quantiles(df, [], "v", {"mid": 0.5}).first()["mid"]
    assert np.isclose(whole, np.median(np.concatenate(list(groups.values()))))


def test_impute_scale_by_moments(spark):
    rows = [("f", True, x) for x in (1.0, None, 4.0, 10.0, None)] + [("f", False, 99.0), ("c", True, 2.0), ("c", True, 2.0), ("n", True, None)]
    got = {r["feature"]: r for r in prep.fit_impute_scale(spark.createDataFrame(rows, "feature string, tr boolean, value double"), F.col("tr")).collect()}
    x = np.array([1.0, 4.0, 4.0, 10.0, 4.0])
    assert np.isclose(got["f"]["mean"], x.mean()) and np.isclose(got["f"]["std"], x.std()) and got["f"]["median"] == 4.0
    assert got["c"]["scale"] == 1.0 and got["n"]["mean"] is None


def test_mode_of_text(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", None), ("y", "c"), ("y", "c"), ("y", "a")], "g string, v string")
    assert dict(map(tuple, summary.mode_smallest(df, "v", ["g"]).collect())) == {"x": "a", "y": "c"}


def test_ranking_metrics_with_packed_scores(spark):
    rng = np.random.default_rng(1)
    s = 0.5 + rng.random(600) * 1e-9
    y = (rng.random(600) < s / s.max() * 0.4).astype(int)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, s)], "m string, y_true int, score double")
    auc = metrics.roc_auc(df, "m").first()["auc"]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert np.isclose(auc, want)


def test_splitter_by_name():
    with pytest.warns(UserWarning):
        assert split.cv_splitter("other") is split.kfold
    assert split.cv_splitter("logo") is split.leave_one_group_out


def test_good_bad_columns(spark):
    df = spark.createDataFrame([("good", "good", None), ("", "other", None), (None, "bad", None)], "a string, b string, c string")
    assert prep.good_bad_columns(df, ["a", "b", "c"]) == ["a", "c"] and prep.good_bad_columns(df, []) == []


def test_detect_task_and_coercion(spark):
    df = spark.createDataFrame([(float(k % 2), k + 0.5, "1.5" if k else "x") for k in range(12)], "a double, b double, c string")
    assert prep.detect_task(df, "a") == "classification" and prep.detect_task(df, "b") == "regression"
    assert [r[0] for r in df.select(prep.coerce_numeric("c")).limit(2).collect()] == [None, 1.5]


def test_column_families_and_schema_diff(spark):
    from trialframe.operators import quality

    df = spark.createDataFrame([(1, 1.0, 2.0, "x")], "id long, trial0_a double, trial12_a double, trial3_b_c string")
    assert dict(map(tuple, summary.column_families(df).collect())) == {"a": 2, "b_c": 1}
    want = {"id": "bigint", "trial0_a": "int", "gone": "string", "trial12_a": "double"}
    assert quality.schema_diff(df, want) == [("gone", "missing", "string", None), ("trial0_a", "type", "int", "double"), ("trial3_b_c", "extra", None, "string")]


def test_wide_merge_keeps_null_keys(spark):
    a = spark.createDataFrame([(1, 10), (None, 20)], "k long, v int")
    b = spark.createDataFrame([(None, 30), (2, 40)], "k long, v int")
    assert sorted(map(str, map(tuple, joins.wide_merge({"a_": a, "b_": b}, ["k"]).collect()))) == ["(1, 10, None)", "(2, None, 40)", "(None, 20, 30)"]
