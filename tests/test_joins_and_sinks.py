"""Semi and anti joins, cohort filter, metric sinks, half-read files, fixed
lookups."""

import os

import pytest

from trialframe.operators import clean, joins
from trialframe.sources import config, files


@pytest.fixture()
def listing(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3)], "name string, size long")


def test_incremental_joins(spark, listing):
    local = spark.createDataFrame([("a", 1), ("b", 9)], "name string, size long")
    assert sorted(r["name"] for r in joins.changed_or_new(listing, local).collect()) == ["b", "c", "c"]
    assert sorted(r["name"] for r in joins.not_yet_processed(listing, local, ["name"]).collect()) == ["c", "c"]
    assert sorted(r["name"] for r in joins.restrict_to(listing, local.select("name"), "name").collect()) == ["a", "b"]


def test_filter_cohorts(listing):
    sizes = lambda c: sorted(r["size"] for r in clean.filter_cohorts(listing, "size", c).collect())
    assert sizes("all") == sizes(None) == [1, 2, 3, 3] and sizes(2) == [2] and sizes([1, 3]) == [1, 3, 3]
    with pytest.raises(TypeError):
        clean.filter_cohorts(listing, "size", 1.5)


def test_include_exclude(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "n string")
    names = lambda **k: [r["n"] for r in clean.include_exclude(df, "n", **k).collect()]
    assert names() == ["a", "b", None] and names(include=["a"], exclude=["a"]) == ["a"] and names(exclude=["a"]) == ["b", None]


def test_metric_tables(spark, tmp_path, listing):
    files.write_metric_tables(listing, listing.limit(1), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m" / "detailed")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "m" / "summary")).columns == ["name", "size"]


def test_half_read_files_are_reported(spark, tmp_path):
    d = str(tmp_path / "d")
    spark.range(10).coalesce(1).write.parquet(d)
    name = [f for f in os.listdir(d) if f.endswith(".parquet")][0]
    data = files.read_dir_with_key(spark, d)
    assert files.failed_files(spark, d, data, "*.parquet").collect() == []
    part = files.failed_files(spark, d, data.where("id < 7"), "*.parquet").collect()  # as if the read had stopped
    assert [(r["name"], r["error"]) for r in part] == [(name, "read 7 of 10 rows")]


def test_fixed_lookups(spark):
    cfg = config.cohort_config("none such")
    df = spark.createDataFrame([("plr",), ("other",)], "task string")
    got = dict(map(tuple, config.with_task_value(df, spark, cfg["resample_60fps"], "n").collect()))
    assert got == {"plr": 480, "other": None}
