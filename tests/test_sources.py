"""File sources/sinks, cohort config and plugins on small temp files."""

import json

import pytest
from pyspark.sql import functions as F

from trialframe import plugins
from trialframe.sources import config, files


def test_dir_scan_keys_corrupt_and_listing(spark, tmp_path):
    d = tmp_path / "sessions"
    d.mkdir()
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "trial int, x double")
    b = spark.createDataFrame([(0, 3.0, "good")], "trial int, x double, q string")  # extra column
    for name, df in [("s1_1700000000000_x", a), ("s2_1700000000001_y", b)]:
        df.coalesce(1).write.parquet(str(tmp_path / name))
        part = [p for p in (tmp_path / name).iterdir() if p.suffix == ".parquet"][0]
        part.rename(d / f"{name}.parquet")
    (d / "s3_broken.parquet").write_bytes(b"not a parquet file")
    data = files.read_dir_with_key(spark, str(d), glob="*.parquet")
    got = sorted((r.session_key, r.trial, r.q) for r in data.collect())
    assert got == [("s1", 0, None), ("s1", 1, None), ("s2", 0, "good")]
    bad = [r.name for r in files.failed_files(spark, str(d), data, glob="*.parquet").collect()]
    assert bad == ["s3_broken.parquet"]
    lst = files.list_files(spark, str(d), glob="*.parquet")
    assert lst.count() == 3
    assert files.newest_file(lst).count() == 1
    keys = files.key_from_listing(lst, r"/(s[0-9])_[0-9]+_").collect()
    assert sorted(r.session_id for r in keys) == ["s1", "s2"]


def test_recording_stats_and_paired_csv(spark, tmp_path):
    ok = {"metadata": {"video_path": "v1.mp4"}, "algorithm_results": {"FaceMeshIMUAnalysis": {
        "total_frames": 3, "orientation_stats": {"roll": {"mean": 1.5, "std": 0.5}}}}}
    err = {"metadata": {"video_path": "v2.mp4"}, "algorithm_results": {"FaceMeshIMUAnalysis": {"error": "no face"}}}
    (tmp_path / "v1_analysis_20240101_120000.json").write_text(json.dumps(ok, indent=1))
    (tmp_path / "v2_analysis_20240101_120000.json").write_text(json.dumps(err, indent=1))
    (tmp_path / "v1_unified_analysis_20240101_120000.csv").write_text(
        "frame_number,timestamp,BasicVideoAnalysis_brightness\n0,0.0,10\n1,0.1,20\n")
    st = files.read_recording_stats(spark, str(tmp_path))
    rows = {r.json_name: r for r in st.collect()}
    r1, r2 = rows["v1_analysis_20240101_120000.json"], rows["v2_analysis_20240101_120000.json"]
    assert r1.face_detected == 1 and r1.orientation_stats_roll_mean == 1.5 and r1.position_stats_x_mean is None
    assert r2.face_detected == 0 and r2.orientation_stats_roll_mean is None
    p = {r.json_name: r for r in files.read_paired_frames(spark, str(tmp_path), st).collect()}
    assert p["v1_analysis_20240101_120000.json"].basic_brightness_mean == 15.0
    assert p["v2_analysis_20240101_120000.json"].basic_brightness_mean is None


def test_run_metadata_first_name_wins(spark, tmp_path):
    for folder, fname, auc in [("run1", "run_metadata.json", 0.6), ("run1", "results.json", 0.1),
                               ("run2", "results.json", 0.7)]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / fname).write_text(json.dumps({"auc": auc}))
    r = {x.run_folder: x.auc for x in files.read_runs(spark, str(tmp_path)).collect()}
    assert r == {"run1": 0.6, "run2": 0.7}


def test_sinks_and_model_roundtrip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(0, "a", 1.0, 0.0), (1, "b", 2.0, 1.0), (2, "a", 3.0, 1.0)],
                               "id int, cohort string, x double, label double")
    files.write_dataset(df, str(tmp_path / "pq"), ["cohort"], csv_copy=str(tmp_path / "csv"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("cohort = 'a'").count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    missing = files.write_run_metadata(spark, {"target": "y", "folds": 5}, str(tmp_path / "meta"),
                                       ["target", "folds", "seed"])
    assert missing == ["seed"]
    pm = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                          LogisticRegression(maxIter=5)]).fit(df)
    files.save_model(pm, str(tmp_path / "model"))
    assert files.load_model(str(tmp_path / "model")).transform(df).count() == 3


def test_cohort_config_and_task_lookup(spark):
    cfg = {"default": config.DEFAULT_CONFIG["default"], "c7": {"cohort_id": 7, "processing": {"buffer": 5}}}
    c = config.cohort_config("c7", cfg)
    assert c["cohort_id"] == 7 and c["processing"]["buffer"] == 5 and c["processing"]["threshold"] == 33
    assert config.cohort_config("nope", cfg)["cohort_id"] == 5
    assert config.fill_path("{root}/x/{session_id}.parquet", root="/d", session_id="s1") == "/d/x/s1.parquet"
    with pytest.raises(KeyError):
        config.fill_path("{root}/{cohort}", root="/d")
    df = spark.createDataFrame([("plr",), ("face_pairs",), ("other",)], "task string")
    out = {r.task: r.n for r in config.with_task_value(df, spark, {"plr": 480, "face_pairs": 1650}, "n",
                                                       factor=0.5).collect()}
    assert out == {"plr": 240, "face_pairs": 825, "other": None}


def test_plugins(spark):
    fr = spark.createDataFrame([("r", True, 150.0, 0.1), ("r", False, 10.0, 0.3), ("s", True, 50.0, 0.01)],
                               "rec string, detected boolean, total_velocity double, face_size_percentage double")

    @plugins.pandas_analyser("n_rows_pd", "rec string, n_pd long")
    def _n(pdf):
        import pandas as pd

        return pd.DataFrame({"rec": [pdf["rec"].iloc[0]], "n_pd": [len(pdf)]})

    out = {r.rec: r for r in plugins.run_analysers(fr, ["rec"], ["detection", "movement", "n_rows_pd"]).collect()}
    assert out["r"].valid_detections == 1 and out["r"].high_movement_frames == 1 and out["r"].n_pd == 2
    conf = spark.createDataFrame([(3, 1, 4, 2, 10)], "tp long, fp long, tn long, fn long, n long")
    s = plugins.score(conf, ["accuracy", "balanced_accuracy"]).first()
    assert s.accuracy == 0.7 and abs(s.balanced_accuracy - (0.6 + 0.8) / 2) < 1e-12

    def step(k):
        if k == "bad":
            raise ValueError("boom")

    st = {r.k: (r.status, r.error) for r in plugins.run_with_status(
        spark.createDataFrame([("a",), ("bad",)], "k string"), "k", step).collect()}
    assert st["a"] == ("success", None) and st["bad"][0] == "error" and "boom" in st["bad"][1]
