"""File sources and sinks.

One distributed read per dataset (never a per-file driver loop): the file a
row came from is the ``_metadata.file_path`` / ``file_name`` column, listings
are ``binaryFile`` scans that never read file contents (only ``path``,
``length`` and ``modificationTime`` are selected, so the content column is
pruned), and sinks are plain DataFrame writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.functions import names

# ------------------------------------------------------------------ S5/S6


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet when the name ends with .parquet, else CSV with header
    (explicit schema when given; no inference on the hot path)."""
    if path.rstrip("/").endswith(".parquet"):
        r = spark.read
        return (r.schema(schema) if schema else r).parquet(path)
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


# ------------------------------------------------------------------ S7/S8
def read_dir_with_key(spark: SparkSession, directory: str, fmt: str = "parquet", schema: T.StructType | None = None,
                      glob: str | None = None, ignore_corrupt: bool = True, merge_schema: bool = True) -> DataFrame:
    """Every file of a folder as one dataset, with ``file_name`` and the
    session key (file stem up to the first '_'). Empty files contribute no
    rows; files with different columns are merged by name; corrupt files are
    skipped (S8) when ``ignore_corrupt``; :func:`failed_files` then reports
    them, and those that broke half-way."""
    r = spark.read.format(fmt).option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    if fmt == "parquet":
        r = r.option("mergeSchema", str(merge_schema).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(directory)
    fname = F.col("_metadata.file_name")
    return df.withColumns({"file_name": fname, "session_key": names.first_token(names.strip_ext(fname))})


def list_files(spark: SparkSession, directory: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, name, length, modified) of files under a folder;
    contents are never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(directory).select("path", "length", "modificationTime")
    return df.withColumns({"name": names.base_name("path")}).withColumnRenamed("modificationTime", "modified")


def failed_files(spark: SparkSession, directory: str, data: DataFrame, glob: str | None = None) -> DataFrame:
    """Listed files that produced no readable row (corrupt or empty), or
    fewer rows than their footer promises (broken half-way), as a side table
    - the job itself continues. ``data`` is the output of
    :func:`read_dir_with_key` on parquet files, before any filter; the
    promised counts come from the footers alone."""
    listed = list_files(spark, directory, glob).select("path", "name")
    read = data.groupBy(F.col("file_name").alias("name")).agg(F.count(F.lit(1)).alias("_rows"))
    r = spark.read.option("ignoreCorruptFiles", "true")
    footers = (r.option("pathGlobFilter", glob) if glob else r).schema(T.StructType()).parquet(directory)
    promised = footers.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("_promised"))
    j = listed.join(read, "name", "left").join(promised, "name", "left")
    error = F.when(F.col("_rows").isNull(), F.lit("unreadable or empty")).when(
        F.col("_rows") < F.col("_promised"), F.concat_ws(" ", F.lit("read"), "_rows", F.lit("of"), "_promised", F.lit("rows")))
    return j.withColumn("error", error).where("error is not null").select("name", "path", "error")


def newest_file(listing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest path (by modification time, then name) overall or per group."""
    ordx = F.struct(F.col("modified"), F.col("path"))
    return listing.groupBy(*by).agg(F.max_by("path", ordx).alias("path"), F.max("modified").alias("modified"))


def key_from_listing(listing: DataFrame, pattern: str, group: int = 1, out: str = "session_id") -> DataFrame:
    """Regex on the object key -> (session_id, key, size)."""
    return listing.select(F.regexp_extract("path", pattern, group).alias(out), F.col("path").alias("key"),
                          F.col("length").alias("size")).where(F.col(out) != "")


# ------------------------------------------------------------------ S9/S10/X15
STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in
                      ["mean", "std", "min", "max", "median", "q25", "q75", "range"]])


def stats_struct(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, STATS) for f in fields])


# fixed values: the fields of the statistics documents
RECORDING_STATS_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("video_path", T.StringType()), T.StructField("analysis_timestamp", T.StringType()),
        T.StructField("total_frames_processed", T.LongType())])),
    T.StructField("algorithm_results", T.StructType([T.StructField("FaceMeshIMUAnalysis", T.StructType([
        T.StructField("error", T.StringType()),
        T.StructField("total_frames", T.LongType()),
        T.StructField("valid_detections", T.LongType()),
        T.StructField("detection_rate", T.DoubleType()),
        T.StructField("orientation_stats", stats_struct(["roll", "pitch", "yaw"])),
        T.StructField("position_stats", stats_struct(["x", "y", "z_depth"])),
        T.StructField("velocity_stats", stats_struct(["roll", "pitch", "yaw", "total"])),
        T.StructField("face_size_stats", stats_struct(["percentage", "bbox_width", "bbox_height"])),
    ]))])),
])

# fixed values: their groups
STAT_FIELDS = [("orientation_stats", f) for f in ("roll", "pitch", "yaw")] + \
              [("position_stats", f) for f in ("x", "y", "z_depth")] + \
              [("velocity_stats", f) for f in ("roll", "pitch", "yaw", "total")]


def read_recording_stats(spark: SparkSession, directory: str) -> DataFrame:
    """S9 + X15: nested per-recording JSON documents -> one flat row each:
    ``face_detected`` 0 on the error branch (all statistics null), else 1;
    a missing statistic is null (explicit schema, no inference)."""
    j = (spark.read.schema(RECORDING_STATS_SCHEMA).option("multiLine", True)
         .option("pathGlobFilter", "*.json").json(directory))
    base = F.col("algorithm_results.FaceMeshIMUAnalysis")
    err = base["error"].isNotNull()
    cols = [F.col("_metadata.file_name").alias("json_name"),
            F.when(err, 0).otherwise(1).alias("face_detected")]
    for cat, stat in STAT_FIELDS:
        for m in ("mean", "std"):
            cols.append(F.when(~err, base[cat][stat][m]).alias(f"{cat}_{stat}_{m}"))
    return j.select(*cols)


def read_paired_frames(spark: SparkSession, directory: str, stats: DataFrame) -> DataFrame:
    """Per-frame CSVs paired with their JSON by the derived name (X5:
    'unified' inserted before the 3rd-from-last token, .json -> .csv); mean
    and sample std of brightness per recording (A10), left-joined."""
    schema = T.StructType([T.StructField("frame_number", T.IntegerType()), T.StructField("timestamp", T.DoubleType()),
                           T.StructField("BasicVideoAnalysis_brightness", T.DoubleType())])
    csv = (spark.read.option("header", True).option("pathGlobFilter", "*.csv")
           .option("enforceSchema", False).schema(schema).csv(directory)
           .withColumn("csv_name", F.col("_metadata.file_name")))
    agg = csv.groupBy("csv_name").agg(F.avg("BasicVideoAnalysis_brightness").alias("basic_brightness_mean"),
                                      F.stddev_samp("BasicVideoAnalysis_brightness").alias("basic_brightness_std"))
    s = stats.withColumn("csv_name", names.insert_token("json_name", "unified", 3, "_", ".csv"))
    return s.join(agg, "csv_name", "left").drop("csv_name")


# ------------------------------------------------------------------ S11
def read_runs(spark: SparkSession, root: str, preferred: str = "run_metadata.json",
              fallback: str = "results.json", schema: T.StructType | str | None = None) -> DataFrame:
    """One metadata row per run folder; ``preferred`` wins over
    ``fallback`` when a folder has both. Only files of the two names are
    opened, in one scan (two if the schema has to be inferred)."""
    r = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    r = r.option("pathGlobFilter", f"{{{preferred},{fallback}}}")
    df = (r.schema(schema) if schema is not None else r).json(root).withColumn("_path", F.col("_metadata.file_path"))
    df = df.withColumns({"file_name": names.base_name("_path"),
                         "run_folder": F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)})
    df = df.where(F.col("file_name").isin(preferred, fallback))
    rank = F.when(F.col("file_name") == preferred, 0).otherwise(1)
    rest = [c for c in df.columns if c not in ("run_folder",)]
    g = df.groupBy("run_folder").agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return g.select("run_folder", *[F.col("_r")[c].alias(c) for c in rest if c != "_path"])


# ------------------------------------------------------------------ sinks
def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = (), csv_copy: str | None = None,
                  mode: str = "overwrite") -> None:
    """Parquet (optionally partitioned, e.g. by cohort and task so
    readers prune) plus an optional CSV copy written from the same
    materialised data."""
    if csv_copy:
        df = df.persist()
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    if csv_copy:
        df.write.mode(mode).option("header", True).csv(csv_copy)
        df.unpersist()


def dataset_name(cohort: int | str, n_sessions: int, stamp: str, suffix: str) -> str:
    """Name carrying cohort, session count and time."""
    return f"cohort_{cohort}_{n_sessions}sessions_{stamp}_{suffix}"


def write_run_metadata(spark: SparkSession, meta: dict, path: str, expected_keys: Sequence[str] = ()) -> list[str]:
    """One nested metadata row written as JSON; returns settings that
    were expected but not recorded (the reference warns about those)."""
    import json

    spark.read.json(spark.sparkContext.parallelize([json.dumps(meta)])).coalesce(1).write.mode("overwrite").json(path)
    return [k for k in expected_keys if k not in meta]


def write_metric_tables(metrics_long: DataFrame, summary: DataFrame, path: str) -> None:
    """Detailed (model, metric, fold, value) and summary tables as CSV."""
    metrics_long.write.mode("overwrite").option("header", True).csv(f"{path}/detailed")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def save_model(model, path: str) -> None:
    """Persist a fitted PipelineModel (preprocessing + model)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
