"""Operator semantics on small literal frames (nulls, ties, edge cases)."""

import math

from pyspark.sql import functions as F

from trialframe.functions import names, scalar
from trialframe.operators import clean, metrics, series, significance, split, wide


def test_band_exclusion_keeps_missing(spark):
    df = spark.createDataFrame([(1, 24.0), (2, 25.0), (3, 41.0), (4, 42.0), (5, None)], "id int, s double")
    kept = sorted(r.id for r in clean.band_exclude(df, "s", 33, 8).collect())
    assert kept == [1, 4, 5]


def test_pivot_first_row_and_missing_trial(spark):
    rows = [(1, 1, 10, 1.0, "bad"), (1, 1, 5, 2.0, "good"), (1, 3, 7, 3.0, "good"), (2, 2, 1, 4.0, "bad")]
    df = spark.createDataFrame(rows, "s long, t int, o long, x double, q string")
    w = wide.pivot_first(df, "s", "t", [1, 2, 3], {"x": F.col("x")}, F.col("o"),
                         codes={"q": ("q", ["good", "bad"])})
    r = {row.session_id: row for row in w.collect()}
    assert r[1].trial1_x == 2.0 and r[1].trial2_x is None and r[1].trial3_x == 3.0
    # session 1 sees 'good' first (o=5) -> code 0; session 2 only 'bad' -> 0
    assert r[1].trial1_q == 0 and r[1].trial3_q == 0 and r[2].trial2_q == 0
    assert len(w.columns) == 1 + 3 * 2


def test_missing_trials(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "s long, t int")
    got = sorted((r.session_id, r.trial) for r in wide.missing_trials(df, "s", "t", [1, 2, 3]).collect())
    assert got == [(1, 2), (2, 1), (2, 3)]


def test_zscore_constant_series_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    out = {(r.g, r.v): r.v_z for r in series.zscore(df, "g", ["v"], "_z").collect()}
    assert out[("a", 1.0)] is None
    assert out[("b", 1.0)] == -1.0 and out[("b", 3.0)] == 1.0


def test_velocity_previous_valid_and_dt(spark):
    rows = [("r", 1, 0, 1.0), ("r", 2, 1_000_000, None), ("r", 3, 2_000_000, 5.0), ("r", 4, 2_000_000, 9.0)]
    df = spark.createDataFrame(rows, "g string, id long, us long, v double").withColumn(
        "ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    out = series.lag_velocity(df, "g", ["ts", "id"], F.lit(0), "ts", ["v"], valid=F.col("v").isNotNull())
    got = {r.id: r.v_velocity for r in out.collect()}
    assert got == {1: 0.0, 3: 2.0, 4: 0.0}  # first -> 0, skips invalid, dt = 0 -> 0


def test_fill_forward_backward(spark):
    rows = [("r", i, v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])] + [("z", 0, None)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    out = series.fill_forward_backward(df, "g", ["i"], F.floor(F.col("i") / 2), ["v"])
    got = {(r.g, r.i): r.v for r in out.collect()}
    assert [got[("r", i)] for i in range(6)] == [2.0, 2.0, 2.0, 2.0, 5.0, 5.0]
    assert got[("z", 0)] is None


def test_auc_ap_with_ties(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.9, 0.7, 0.4, 0.4, 0.2, 0.2, 0.1]
    df = spark.createDataFrame([("m", float(a), b) for a, b in zip(y, s)], "model string, y_true double, score double")
    auc = metrics.roc_auc(df, "model").first().auc
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - exp) < 1e-12
    ap = metrics.average_precision(df, "model").first().ap
    th = sorted(set(s), reverse=True)
    P = sum(y)
    exp_ap, prev_r = 0.0, 0.0
    for t in th:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        exp_ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert abs(ap - exp_ap) < 1e-12


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([("m", 0.0, 0.1), ("m", 0.0, 0.2)], "model string, y_true double, score double")
    r = metrics.from_confusion(metrics.confusion(df, "model")).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0 and r.mcc == 0.0 and r.accuracy == 1.0


def test_binomial_golden_pvalues(spark):
    """Published p-values (n_test=97, majority 52/97) reproduced with the
    reference's truncated counts int(acc * n) (T10)."""
    acc = [0.5773195876288659, 0.5463917525773195, 0.5154639175257731, 0.4742268041237113, 0.5360824742268041]
    p_maj = [0.30613293960054166, 0.5414734243424238, 0.7622341481450013, 0.9069851864690449, 0.5414734243424238]
    p_half = [0.11143882729168793, 0.2713050790229375, 0.5, 0.7286949209770626, 0.2713050790229375]
    df = spark.createDataFrame([(a,) for a in acc], "acc double")
    n = F.lit(97)
    k = significance.truncated_correct(F.col("acc"), n)
    got = df.select(k.alias("k"), significance.binom_sf(k, n, F.lit(0.5360824742268041)).alias("pm"),
                    significance.binom_sf(k, n, F.lit(0.5)).alias("ph")).collect()
    assert [r.k for r in got] == [55, 52, 49, 46, 52]
    for r, a, b in zip(got, p_maj, p_half):
        assert abs(r.pm - a) < 1e-9 and abs(r.ph - b) < 1e-9


def test_permutation_p_matches_enumeration(spark):
    import itertools

    y = [1, 1, 1, 0, 0, 0, 0]
    pred = [1, 0, 1, 1, 0, 0, 0]
    obs = sum(a == b for a, b in zip(y, pred))
    perms = set(itertools.permutations(y))
    exact = sum(sum(a == b for a, b in zip(p, pred)) >= obs for p in perms) / len(perms)
    df = spark.createDataFrame([(7, obs, sum(y), sum(pred))], "n long, c long, pt long, pp long")
    got = df.select(significance.permutation_p(F.col("n"), F.col("c"), F.col("pt"), F.col("pp")).alias("p")).first().p
    assert abs(got - exact) < 1e-12


def test_erfc_and_mcnemar(spark):
    xs = [0.0, 0.3, 1.0, 2.5, -0.7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.e for r in df.select(significance.erfc(F.col("x")).alias("e")).collect()]
    for x, e in zip(xs, got):
        assert abs(e - math.erfc(x)) < 2e-7
    m = spark.createDataFrame([(3, 9), (0, 0)], "b long, c long").select(
        significance.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    assert abs(m[0].p - math.erfc(math.sqrt(((9 - 3 - 1) ** 2 / 12) / 2))) < 2e-7 and m[1].p == 1.0


def test_folds_deterministic_and_balanced(spark):
    df = spark.range(103).withColumnRenamed("id", "rid").withColumn("y", (F.col("rid") % 3 == 0).cast("int"))
    a = {r.rid: r.fold for r in split.stratified_kfold(df, "rid", "y", 5, 7).collect()}
    b = {r.rid: r.fold for r in split.stratified_kfold(df, "rid", "y", 5, 7).collect()}
    assert a == b
    sizes = [list(a.values()).count(f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 2
    k = split.kfold(df, "rid", 5, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in k) == [20, 20, 21, 21, 21]


def test_group_kfold_no_leak(spark):
    df = spark.createDataFrame([(i, f"g{i % 11}") for i in range(200)], "rid long, grp string")
    f = split.group_kfold(df, "grp", 4)
    assert f.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_split_test_size_rounds_up(spark):
    df = spark.range(481).withColumnRenamed("id", "rid").withColumn("y", (F.col("rid") % 2).cast("int"))
    t = split.train_test_split(df, "rid", 0.2, 42, stratify="y")
    assert t.where("split = 'test'").count() == 97


def test_task_names_and_encoders(spark):
    df = spark.createDataFrame([("PLR_view",), ("aiv",), ("face_pairs_task_1",), ("Attention_2",), ("x",)], "t string")
    got = [r.n for r in df.select(names.normalise_task("t").alias("n")).collect()]
    assert got == ["plr", "affective_image_set", "face_pairs", "attention_bias", "x"]
    e = spark.createDataFrame([("mab", "engagement", "sad", "top", "bottom", "top")],
                              "task string, mab_engagement string, mab_emotion string, mab_emo_location string, "
                              "mab_dot_location string, mab_cue_location string")
    fields = {f: F.col(f) for f in scalar.MAB_FIELDS}
    fields.update({f: F.lit(None).cast("string") for f in scalar.MCK_FIELDS})
    assert e.select(scalar.task_code_vector("task", fields).alias("c")).first().c == [2, 1, 2, 1, 0, 1]


def test_name_functions(spark):
    df = spark.createDataFrame([("a/b/sess_1699999999999_clip_30fps.MP4",), ("x_1700000000.json",), ("n.txt",)], "p string")
    r = df.select(names.base_name("p").alias("b"), names.epoch_from_name("p").alias("e"),
                  names.fps_from_name("p").alias("f"), names.has_extension("p", [".mp4"]).alias("m")).collect()
    assert r[0].b == "sess_1699999999999_clip_30fps.MP4" and r[0].e == 1699999999999 and r[0].f == 30 and r[0].m
    assert r[1].e == 1700000000 and r[1].f is None and r[2].e == 0 and not r[2].m
    x = spark.createDataFrame([("base_a_analysis_20240101_120000.json",)], "n string")
    got = x.select(names.drop_last_tokens("n", 3, "_", ".mp4").alias("d"),
                   names.insert_token("n", "unified", 3, "_", ".csv").alias("i")).first()
    assert got.d == "base_a.mp4" and got.i == "base_a_unified_analysis_20240101_120000.csv"
